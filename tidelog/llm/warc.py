"""Legacy ARC archives, converted to WARC.

``read_arc`` parses ARC files of version 1 and 2: the version block of a file names its header fields, and each record's
header line ends with the declared length of its block. ``convert`` makes the equivalent WARC records: identifiers
(name-based UUIDs of file and offset), timestamps, types and SHA-1 digests, with ``revisit`` records for repeated
payloads. ``write_records`` and ``read_warc`` go through Spark's own file readers and writers, so archives may be
on any store that Spark reaches.

Archives are written as gzip files that hold about ``FILE_BYTES`` before compression, and are read by one task each, which
inflates them piece by piece and holds one record at a time; blocks are cut out by declared lengths, never by searching for separators.
Spark reads a file's (compressed) bytes as one value, so that foreign archives must have less than 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, shared_path

#: Payloads from this size on are stored once; equal ones become revisits.
REVISIT_BYTES = 1000
#: Bytes of an archive before compression: a file is closed when it has so many.
FILE_BYTES = 32 << 20
#: Bytes of records in one Arrow batch, about; bytes that are inflated at a time, and of a header at most.
_BATCH, _STEP, _HEAD = 8 << 20, 1 << 16, 1 << 20
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Archives are read as often as written; the fastest level costs a tenth more room.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SCHEMA = "file string, at long, version int, url string, ip string, date string, content_type string, block binary"
WARC_SCHEMA = "file string, at long, headers map<string,string>, block binary"


class Archive:
    """Reads on through the content of a plain file, or of a gzip file of any number of members, ``at`` counting the inflated bytes.

    A member that ends before its trailer is an error: no archive that was cut is taken for a whole one.
    """

    def __init__(self, content: bytes):
        self.at, self._held, self._from = 0, b"", 0
        self._pieces = self._members(memoryview(content)) if content[:2] == b"\x1f\x8b" else iter([content])

    @staticmethod
    def _members(content: memoryview):
        here = 0
        while here < len(content):
            if content[here] == 0:  # padding between members
                here += 1
                continue
            member = zlib.decompressobj(31)
            while not member.eof:
                fed = content[here : here + _STEP]
                if not fed and not member.unconsumed_tail:
                    raise ValueError("the file ends inside a gzip member")
                here += len(fed)
                piece = member.decompress(member.unconsumed_tail + fed, 16 * _STEP)
                while piece:
                    yield piece
                    piece = member.decompress(member.unconsumed_tail, 16 * _STEP) if member.unconsumed_tail and not member.eof else b""
            here -= len(member.unused_data)

    def _more(self) -> bool:
        piece = next(self._pieces, None)
        if piece is None:
            return False
        rest = self._held[self._from :] if self._from else self._held
        self._held, self._from = (rest + piece if rest else piece), 0
        return True

    def _ahead(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        if len(self._held) - self._from >= n:
            return True
        parts, have = [self._held[self._from :]], len(self._held) - self._from
        while have < n and (piece := next(self._pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        self._held, self._from = b"".join(parts), 0
        return have >= n

    def peek(self) -> bytes:
        return self._held[self._from : self._from + 1] if self._ahead(1) else b""

    def read(self, n: int) -> bytes | None:
        """The next ``n`` bytes; None if there are fewer."""
        if not self._ahead(n):
            return None
        self._from += n
        self.at += n
        return self._held[self._from - n : self._from]

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``, which is skipped; None if there is none within the length of a header."""
        while (end := self._held.find(mark, self._from)) < 0:
            if len(self._held) - self._from > _HEAD or not self._more():
                return None
        out = self._held[self._from : end]
        self.at += len(out) + len(mark)
        self._from = end + len(mark)
        return out


def _batched(rows, schema: pa.Schema, weight: int):
    """Record batches of ``rows`` (tuples), cut by the bytes in column ``weight``."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"") + 200
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# --- ARC


def arc_header(version: int, url: str, ip: str, date: str, content_type: str, length: int, status: int = 200, offset: int = 0, name: str = "-") -> str:
    if version == 1:
        return f"{url} {ip} {date} {content_type} {length}"
    return f"{url} {ip} {date} {content_type} {status} - - {offset} {name} {length}"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tidelog\n{_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name).encode() + b"\n" + body


def parse_arc(name: str, content: bytes):
    """(at, version, url, ip, date, content type, block) of each record but the version block."""
    file, version, at = Archive(content), 0, 0
    try:
        while first := file.peek():
            if first in b"\r\n":
                file.read(1)
                continue
            at = file.at
            line = (file.until(b"\n") or b"").decode("utf-8", "replace").rstrip("\r")
            length = int(line.rsplit(" ", 1)[1])
            block = file.read(length) if length >= 0 else None
            if block is None:
                raise ValueError("the block is shorter than declared")
            if line.startswith("filedesc:"):
                version = int(block.split(None, 1)[0])
                if version not in _FIELDS:
                    raise ValueError(f"version {version}")
                continue
            if not version:
                raise ValueError("no version block")
            url, ip, date, kind, *_ = line.rsplit(" ", len(_FIELDS[version].split()) - 1)
            yield at, version, url, ip, date, kind, block
    except (IndexError, ValueError, zlib.error) as e:
        raise ValueError(f"{name}, offset {at}: no valid ARC record: {e}") from e


def _filed(heads, records, between: bytes, file_bytes: int):
    """One value for each file: its head, then records up to ``file_bytes``. ``heads`` gives the head of the n-th file."""
    n, held, size = 0, [heads(0)], 0
    for r in records:
        if size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["value"])
            n, size = n + 1, 0
            held = [heads(n)]
        held.append(r)
        size += len(r)
    yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["value"])


def write_arc(records: DataFrame, path: str, versions: tuple[int, ...] = (1,), file_bytes: int = FILE_BYTES) -> None:
    """``records`` (url, ip, date, content_type, block) as ARC files in a new folder; tasks take ``versions`` in turn.

    White space in an URL is escaped, as the format needs; null fields become ``-``, a null block an empty one.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]

        def rows():
            for b in batches:
                for url, ip, date, kind, block in zip(*(b.column(i) for i in range(5))):
                    block = block.as_py() or b""
                    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in url.as_py() or "-")
                    yield arc_header(version, url, ip.as_py() or "-", date.as_py() or "-", (kind.as_py() or "-").replace(" ", ""), len(block)).encode() + b"\n" + block

        yield from _filed(lambda n: arc_version_block(version, f"part-{part:05d}-{n:05d}.arc", "20240101000000"), rows(), b"\n", file_bytes)

    files = records.select("url", "ip", "date", "content_type", "block").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).options(**_GZIP).text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files in a folder; ``file`` and ``at``, the offset, tell them apart.

    An ill-formed header line, a block shorter than declared or a gzip member that was cut is an error that names the file and the offset.
    """
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("block", pa.binary())])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                name = name.rsplit("/", 1)[-1]
                yield from _batched(((name, *r) for r in parse_arc(name, content.as_py())), schema, 7)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ARC_SCHEMA)


# --- WARC


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, body) of an HTTP response; a block that is none is all body."""
    if block[:5] == b"HTTP/":
        head, gap, body = block.partition(b"\r\n\r\n")
        if gap:
            return head + gap, body
    return b"", block


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def warc_date(date: str) -> str:
    """ARC's 14 digits (or fewer, or none) as WARC writes it."""
    d = "".join(c for c in date if c.isdigit())[:14]
    d += "19700101000000"[len(d) :] if len(d) >= 4 else "19700101000000"[len(d) :] if not d else "0101000000"[-(14 - len(d)) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file}#{at}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def describe(records: DataFrame) -> DataFrame:
    """(file, at, record_id, url, warc_date, digest: hex, payload_bytes, fields: of the HTTP header) of ``read_arc`` rows."""
    names = ["file", "at", "record_id", "url", "warc_date", "digest", "payload_bytes", "fields"]

    def run(batches):
        for b in batches:
            rows = []
            for file, at, url, date, block in zip(*(b.column(i).to_pylist() for i in range(5))):
                head, body = split_http(block)
                rows.append((file, at, record_id(file, at), url, warc_date(date), hashlib.sha1(body).hexdigest(), len(body), list(http_fields(head).items())))
            types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names)

    return records.select("file", "at", "url", "date", "block").mapInArrow(run, "file string, at long, record_id string, url string, warc_date string, digest string, payload_bytes long, fields map<string,string>")


def convert(records: DataFrame, rank: str | None = None, revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``read_arc`` rows to WARC files (value: binary, a file in each row, for ``write_records``).

    Of records with equal payloads of at least ``revisit_bytes`` bytes, the last one by the numeric HTTP field ``rank`` (then by
    file and offset) stays a response, the others become revisits that keep the HTTP header alone. Other URLs than
    HTTP responses become resource records. Null dates and types are written as those of no record; repeated records stay, each with
    an identifier of its own place; no records give files of a warcinfo record alone. Columns of other names are not read.
    """
    seen = materialize(describe(records).withColumn("rank", F.col("fields")[rank].cast("long") if rank else F.lit(None).cast("long")).drop("fields"), "arc")
    large = seen.where(F.col("payload_bytes") >= revisit_bytes)
    best = large.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("rank", "file", "at", "record_id", "url", "warc_date")).alias("best"))
    best = materialize(best.where("n > 1").select("digest", "best"), "payloads")
    revisits = large.join(best, "digest").where("record_id <> best.record_id").select("file", "at", F.col("best.record_id").alias("to_id"), F.col("best.url").alias("to_url"), F.col("best.warc_date").alias("to_date"))
    joined = records.join(materialize(revisits, "revisits"), ["file", "at"], "left")
    discard(seen, best)

    def run(batches):
        part = TaskContext.get().partitionId()

        def head(n):
            info = f"software: tidelog\r\nformat: WARC File Format 1.1\r\npart: {part}-{n}\r\n".encode()
            return _record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'info:{part}-{n}')}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info)

        def rows():
            for b in batches:
                for row in zip(*(b.column(i) for i in range(10))):
                    file, at, url, ip, date, kind, block, to_id, to_url, to_date = (x.as_py() for x in row)
                    date, block = date or "", block or b""
                    head, body = split_http(block)
                    fields = {"WARC-Type": "revisit" if to_id else "response" if head else "resource", "WARC-Record-ID": record_id(file, at), "WARC-Date": warc_date(date), "WARC-Target-URI": url or "-", "WARC-IP-Address": ip or "-", "WARC-Payload-Digest": _sha1(body)}
                    if to_id:
                        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": to_id, "WARC-Refers-To-Target-URI": to_url, "WARC-Refers-To-Date": to_date}
                        block = head
                    yield _record(fields | {"WARC-Block-Digest": _sha1(block), "Content-Type": "application/http; msgtype=response" if head else kind or "application/octet-stream"}, block)

        yield from _filed(head, rows(), b"\r\n\r\n", file_bytes)

    return joined.select("file", "at", "url", "ip", "date", "content_type", "block", "to_id", "to_url", "to_date").mapInArrow(run, "value binary")


def _record(fields: dict[str, str], block: bytes) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block


def write_records(records: DataFrame, path: str) -> None:
    """``convert``'s rows as .gz files in a new folder; the writer closes each with two empty lines, as the records in them are."""
    records.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").options(**_GZIP).text(path)


def parse_warc(name: str, content: bytes):
    """(at, headers with lower-case names, block) of each record."""
    file, at = Archive(content), 0
    try:
        while file.peek():
            at = file.at
            head = file.until(b"\r\n\r\n")
            lines = (head or b"").decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = fields.get("content-length", "")
            block = file.read(int(length)) if lines[0].startswith("WARC/") and length.isdigit() else None
            if block is None or file.read(4) is None:
                raise ValueError("the header or the block is not whole")
            yield at, fields, block
    except (ValueError, zlib.error) as e:
        raise ValueError(f"{name}, offset {at}: no valid WARC record: {e}") from e


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in a folder, warcinfo among them."""
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                name = name.rsplit("/", 1)[-1]
                yield from _batched(((name, at, list(h.items()), block) for at, h, block in parse_warc(name, content.as_py())), schema, 3)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, WARC_SCHEMA)


# --- pages


def pages_as_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """Rows for ``write_arc``: each page as an HTTP response whose ``X-Page-Id`` field carries the id, if there is one."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    mark = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), mark, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("url", F.lit("0.0.0.0").alias("ip"), F.lit(date).alias("date"), F.lit("text/html").alias("content_type"), F.concat(head.cast("binary"), body).alias("block"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through legacy archives of both versions to WARC files and back: page_id, payload_bytes, payload_digest
    (hex), record_type, refers_to (the response's page_id).

    A null html is an empty payload, a null page_id the smallest, and stays null. Rows may repeat: of equal payloads one
    record is the response. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages_as_arc(pages), arc, (1, 2))
    write_records(convert(read_arc(spark, arc), "x-page-id"), out)
    discard(arc)
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, to_id string"
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for headers, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = dict(headers)
                if h["warc-type"] == "warcinfo":
                    continue
                head, body = split_http(block)
                http = http_fields(head)
                declared = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                if h["warc-type"] == "revisit":
                    n, digest = int(http["content-length"]), declared
                else:
                    n, digest = len(body), hashlib.sha1(body).hexdigest()
                    if digest != declared:
                        raise ValueError(f"{h['warc-record-id']}: the payload's digest is not the declared one")
                page = http.get("x-page-id")
                rows.append((int(page) if page is not None else None, n, digest, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to")))
            types = [pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names)

    back = materialize(read_warc(spark, out).select("headers", "block").mapInArrow(run, fields), "pages")
    discard(out)
    targets = back.where("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    return back.join(targets, "to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
