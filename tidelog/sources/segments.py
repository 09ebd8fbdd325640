"""A Spark data source over segment files: ``{root}/{topic}-{partition}/{base offset, 20 digits}.log`` and ``.index``.

Reading: a task for each segment. Filters on topic, partition and offset skip whole segments (a segment ends where the
next begins) and, with the sparse index, bytes before the wanted offset: the file is read from there on. Rows go to Spark in Arrow
batches. Streaming: offsets are the next offset of each partition; a micro-batch reads up to what was the end. To find the ends the
driver reads each active segment behind its last index entry only. Writing: rows sorted by topic, partition and offset; a segment is
closed before the record that finds it full, its index full or, with a limit, too old; files appear under their names only when the whole
job commits.

Files are reached through pyarrow's file systems, so the root may be a local path or an URI that they know.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.codec import CodecError, Record, encode_record, record_fields
from ..schema import INDEX_ENTRY_BYTES, RECORD, index_max_bytes

NAME = "tidelog"
_FOLDER = re.compile(r"^(.+)-(\d+)$")
_FILE = re.compile(r"^(\d{20})\.log$")
#: Rows and bytes of an Arrow batch, about; bytes that are read from a file at a time.
_ROWS, _BYTES, _CHUNK = 10_000, 4 << 20, 8 << 20
_ARROW = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.int64()), ("attributes", pa.int8()), ("key", pa.binary()), ("value", pa.binary())])


def _filesystem(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


@dataclass(frozen=True)
class Segment:
    topic: str
    partition: int
    base: int
    path: str
    next_base: int | None  # of the segment after it; None for the active one


def list_segments(root: str) -> list[Segment]:
    """All segments, ordered; files of other names are no segments."""
    from pyarrow import fs

    system, path = _filesystem(root)
    found: dict[tuple[str, int], list[tuple[int, str]]] = {}
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
        parts = info.path.rsplit("/", 2)
        folder, file = _FOLDER.match(parts[-2]), _FILE.match(parts[-1])
        if info.type == fs.FileType.File and folder and file:
            found.setdefault((folder[1], int(folder[2])), []).append((int(file[1]), info.path))
    out = []
    for (topic, partition), files in sorted(found.items()):
        files.sort()
        for (base, p), after in zip(files, [*files[1:], None]):
            out.append(Segment(topic, partition, base, p, after[0] if after else None))
    return out


def _read(root: str, path: str) -> bytes:
    system, _ = _filesystem(root)
    with system.open_input_stream(path) as f:
        return f.read()


def _index(root: str, s: Segment) -> bytes:
    try:
        return _read(root, s.path.removesuffix(".log") + ".index")
    except FileNotFoundError:
        return b""


def floor_position(index: bytes, relative: int) -> int:
    """Position of the greatest indexed offset <= ``relative``; 0 if there is none. Trailing zero entries are no entries."""
    n = len(index) // 8
    while n > 1 and index[8 * n - 8 : 8 * n] == bytes(8):
        n -= 1
    low, high, best = 0, n - 1, 0
    while low <= high:
        mid = (low + high) // 2
        at, position = struct.unpack_from(">II", index, 8 * mid)
        if at <= relative:
            low, best = mid + 1, position
        else:
            high = mid - 1
    return best


def read_segment(root: str, s: Segment, first: int = 0, before: int | None = None):
    """offset, timestamp, attributes, key, value of a segment's records from offset ``first`` on: those before its floor in the index are not
    read. An active segment ends at its first invalid record, as recovery would cut it there; in a closed one that is an error."""
    start = floor_position(_index(root, s), first - s.base) if first > s.base else 0
    system, _ = _filesystem(root)
    with system.open_input_file(s.path) as f:
        f.seek(start)
        data, at, more = f.read(_CHUNK), 0, True
        while at < len(data) or more:
            try:
                if more and len(data) - at < _CHUNK // 2:
                    piece = f.read(_CHUNK)
                    more = bool(piece)
                    data, at = data[at:] + piece, 0
                    continue
                *fields, at = record_fields(data, at)
            except CodecError:
                if s.next_base is None:
                    return
                raise
            if before is not None and fields[0] >= before:
                return
            if fields[0] >= first:
                yield fields


def segment_end(root: str, s: Segment) -> int:
    """The offset after the last record of an active segment, found behind its last index entry."""
    start = floor_position(_index(root, s), 1 << 32)
    system, _ = _filesystem(root)
    with system.open_input_file(s.path) as f:
        f.seek(start)
        data, at, last = f.read(), 0, s.base - 1
    try:
        while at < len(data):
            last, *_, at = record_fields(data, at)
    except CodecError:
        pass  # a torn end
    return last + 1


def _batches(s: Segment, rows):
    """``read_segment``'s rows as Arrow batches."""
    held, size = [], 0

    def batch():
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([s.topic] * len(held), pa.string()), pa.array([s.partition] * len(held), pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[2:]))], schema=_ARROW)

    for r in rows:
        held.append(r)
        size += len(r[3] or b"") + len(r[4] or b"")
        if len(held) >= _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Part(InputPartition):
    def __init__(self, segment: Segment, first: int, before: int | None):
        self.segment, self.first, self.before = segment, first, before


def _parts(segments: list[Segment], ranges: dict | None = None, first: int = 0, before: int | None = None) -> list[_Part]:
    out = []
    for s in segments:
        lo, hi = ranges.get((s.topic, s.partition), (0, 0)) if ranges is not None else (first, before)
        if (s.next_base is None or s.next_base > lo) and (hi is None or s.base < hi):
            out.append(_Part(s, lo, hi))
    return out


class SegmentReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.first, self.before, self.equal = root, 0, None, {}

    def pushFilters(self, filters):
        """Bounds of offset, and equality of topic and partition, are used; all others are left to Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if isinstance(f, EqualTo) and name in ("topic", "partition"):
                self.equal[name] = value
            elif name == "offset" and isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, value)
            elif name == "offset" and isinstance(f, GreaterThan):
                self.first = max(self.first, value + 1)
            elif name == "offset" and isinstance(f, EqualTo):
                self.first, self.before = max(self.first, value), min(value + 1, self.before if self.before is not None else value + 1)
            elif name == "offset" and isinstance(f, LessThan):
                self.before = min(value, self.before if self.before is not None else value)
            elif name == "offset" and isinstance(f, LessThanOrEqual):
                self.before = min(value + 1, self.before if self.before is not None else value + 1)
            else:
                yield f
                continue

    def partitions(self):
        segments = [s for s in list_segments(self.root) if all(getattr(s, k) == v for k, v in self.equal.items())]
        return _parts(segments, first=self.first, before=self.before) or [_Part(Segment("", 0, 0, "", None), 0, 0)]

    def read(self, part: _Part):
        if part.segment.path:
            yield from _batches(part.segment, read_segment(self.root, part.segment, part.first, part.before))


class SegmentStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, options: dict):
        self.root, self.latest, self.visible = root, options.get("startingoffsets") == "latest", options.get("highwatermarks")

    def _ends(self) -> dict[str, int]:
        ends = {f"{s.topic}-{s.partition}": segment_end(self.root, s) for s in list_segments(self.root) if s.next_base is None}
        if self.visible:
            marks = json.loads(_read(self.visible, _filesystem(self.visible)[1]))
            ends = {k: min(v, marks.get(k, v)) for k, v in ends.items()}
        return ends

    def initialOffset(self):
        return self._ends() if self.latest else {k: 0 for k in self._ends()}

    def latestOffset(self):
        return self._ends()

    def partitions(self, start, end):
        ranges = {}
        for k, hi in end.items():
            m = _FOLDER.match(k)
            ranges[m[1], int(m[2])] = (start.get(k, 0), hi)
        return _parts(list_segments(self.root), ranges) or [_Part(Segment("", 0, 0, "", None), 0, 0)]

    def read(self, part: _Part):
        if part.segment.path:
            yield from _batches(part.segment, read_segment(self.root, part.segment, part.first, part.before))

    def commit(self, end):
        pass


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SegmentWriter(DataSourceWriter):
    def __init__(self, root: str, options: dict, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.segment_bytes = int(options.get("segmentbytes", 128 << 20))
        self.interval = int(options.get("indexintervalbytes", 4096))
        self.entries = int(options.get("indexmaxbytes", index_max_bytes(self.segment_bytes, self.interval))) // INDEX_ENTRY_BYTES
        self.max_age = int(options.get("segmentms", 0))

    def write(self, rows):
        system, path = _filesystem(self.root)
        files, tag = [], uuid.uuid4().hex
        here, log, index, size, since, base, born = None, [], [], 0, 0, 0, 0

        def close():
            if log:
                folder = f"{path}/{here[0]}-{here[1]}"
                system.create_dir(folder, recursive=True)
                for data, end in ((log, "log"), (index, "index")):
                    target = f"{folder}/{base:020d}.{end}"
                    with system.open_output_stream(f"{target}.{tag}") as f:
                        f.write(b"".join(data))
                    files.append((f"{target}.{tag}", target))

        for row in rows:
            r = Record(row["offset"], row["timestamp"], *(None if row[k] is None else bytes(row[k]) for k in ("key", "value")), row["attributes"] or 0)
            old = self.max_age > 0 and size and r.timestamp - born >= self.max_age
            if here != (row["topic"], row["partition"]) or size >= self.segment_bytes or len(index) >= self.entries or old:
                close()
                here, base, log, index, size, since, born = (row["topic"], row["partition"]), r.offset, [], [], 0, 0, r.timestamp
            data = encode_record(r)
            since += len(data)
            if not index or since >= self.interval:
                index.append(struct.pack(">II", r.offset - base, size))
                since = 0
            log.append(data)
            size += len(data)
        close()
        return _Written(files)

    def commit(self, messages):
        system, path = _filesystem(self.root)
        if self.overwrite:
            keep = {temp for m in messages if m for temp, _ in m.files}
            for s in list_segments(self.root):
                for old in (s.path, s.path.removesuffix(".log") + ".index"):
                    if old not in keep:
                        system.delete_file(old)
        for m in messages:
            for temp, target in m.files if m else ():
                system.move(temp, target)

    def abort(self, messages):
        system, _ = _filesystem(self.root)
        for m in messages:
            for temp, _ in m.files if m else ():
                system.delete_file(temp)


class SegmentSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return RECORD

    def reader(self, schema):
        return SegmentReader(self.options["path"])

    def streamReader(self, schema):
        return SegmentStreamReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("tidelog")``, and SQL's decode_record_set, available."""
    from .record_sets import DecodeRecordSet, DecodeRecordSetLenient

    spark.dataSource.register(SegmentSource)
    spark.udtf.register("decode_record_set", DecodeRecordSet)
    spark.udtf.register("decode_record_set_lenient", DecodeRecordSetLenient)


def write_segments(log: DataFrame, root: str, segment_bytes: int = 128 << 20, interval: int = 4096, mode: str = "append", segment_ms: int = 0, index_bytes: int | None = None) -> None:
    """``log`` (RECORD columns) as segment files, rolled as ``layout`` rolls them; the age of a segment is taken from its records' times."""
    register(log.sparkSession)
    rows = log.select("topic", "partition", "offset", "timestamp", "attributes", "key", "value").repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    writer = rows.write.format(NAME).mode(mode).option("segmentBytes", segment_bytes).option("indexIntervalBytes", interval).option("segmentMs", segment_ms)
    (writer if index_bytes is None else writer.option("indexMaxBytes", index_bytes)).save(root)
