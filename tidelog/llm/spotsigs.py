"""SpotSigs document fingerprints (Theobald et al., "SpotSigs: Robust and Efficient Near Duplicate Detection", 2008).

A signature is a common-word anchor with the chain of content words that follows it. A document is the set of its
signatures, hashed; boiler-plate without common words leaves no trace. Two documents are as alike as the Jaccard
coefficient of their sets, which cannot exceed the ratio of the set sizes: near-duplicate search therefore partitions
by set length, and compares neighbouring partitions only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import discard, id_key, materialize, text_bytes
from .similar import check_links, missing_links, parities

# Common words of four languages, the anchors, then words that are skipped in chains as well.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on that the this to was with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "al con de del el en es la las los para por que se su un una y "
    "au ce dans des du est et il la le les ne par pas pour qui sur une".encode().split()
)
#: Content words in a chain.
CHAIN = 2
#: Characters at the edges of words that don't count.
_TRIM = b".,;:!?\"'()[]|#*$%&<>"
#: After so many content words without an anchor (lists, tables, foreign languages) each further one is an anchor itself.
GAP = 12


def signatures(text: bytes, chain: int = CHAIN, anchors: frozenset = ANCHORS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a UTF-8 text's signatures.

    A text without any is represented by the hash of its words, so that only equal ones are alike.
    """
    words = [w.strip(_TRIM) for w in text.lower().split()]
    content = [w for w in words if w and w not in anchors]
    found, at, last, gap = set(), 0, len(content) - chain + 1, 0
    chains = [b" ".join(c) for c in zip(*(content[k:] for k in range(chain)))]
    for w in words:
        if w in anchors:
            gap = 0
            if at < last:
                found.add(w + b" " + chains[at])
        elif w:
            at += 1
            gap += 1
            if gap > GAP and at < last:
                found.add(w + b" " + chains[at])
    if not found:
        found.add(b"\n" + b" ".join(words))
    return np.unique(np.fromiter(map(xxh32_intdigest, found), np.uint32, len(found)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode(sigs: np.ndarray) -> str:
    """8 hex digits for each signature, ascending."""
    return sigs.astype(">u4").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, size, sigs: array<long> ascending) for each row; a null text is an empty one."""

    def run(batches):
        for b in batches:
            sigs = [signatures(x.as_py(), chain) for x in b.column(1)]
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            flat = np.concatenate(sigs).astype(np.int64) if sigs else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), lists], ["id", "size", "sigs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, "id long, size int, sigs array<long>")


def memberships(prints: DataFrame) -> DataFrame:
    """(id, key) for each row of ``fingerprints``: key is the representative of its signature set, the smallest id with an equal one."""
    sets = prints.groupBy("sigs").agg(F.min(id_key("id")).alias("key"))
    return prints.join(sets, "sigs").select("id", "key")


def length_edges(threshold: float, upto: int) -> list[int]:
    """Lower bounds of set-length partitions such that sets alike to ``threshold`` are in one or in neighbours."""
    edges, at = [1], 1
    while at <= upto:
        at = int(np.ceil(at / threshold)) + 1
        edges.append(at)
    return edges


def _with_parities(rows: DataFrame) -> DataFrame:
    """``rows`` (node, n, p, sigs) with ``parities`` m in the place of sigs."""

    def run(batches):
        for b in batches:
            m = pa.array([parities(x.values.to_numpy().view(np.uint64)) for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), m], ["node", "n", "p", "m"])

    return rows.mapInArrow(run, "node long, n int, p array<long>, m binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(a, b, jaccard): pairs of representatives of equal signature sets with similarity of ``threshold`` or more; a < b.

    Equal sets are folded first; ``memberships`` says whom a representative, their smallest id, stands for. Sets are then
    partitioned by length; each stands in its own partition and in the one above. Inside a partition the sets meet by prefix:
    of sets alike to ``threshold``, the rarest ``size - ceil(threshold * size) + 1`` signatures share one, so only sets that do are
    compared. A frequent signature's list is dealt to blocks, pairs are filtered by size and parities where they meet,
    and the sets of what is left are sent about once, in families; so neither a list nor a family has to fit one task.

    Sets that only rows without ids have are represented by the largest long, whatever their number. Empty tables give empty results.
    """
    each = fingerprints(docs, id_col, text_col, chain)
    sets = materialize(each.groupBy("sigs", "size").agg(F.min(id_key("id")).alias("key")).withColumn("node", F.xxhash64("sigs")), "sets")
    longest = sets.agg(F.max("size")).first()[0] or 1
    edges = F.array(*[F.lit(x) for x in length_edges(threshold, longest)])
    part = F.size(F.filter(edges, lambda e: e <= F.col("size")))
    rarity = materialize(sets.select(F.explode("sigs").alias("sig")).groupBy("sig").count(), "rarity")
    terms = sets.select("node", "size", part.alias("part"), F.explode("sigs").alias("sig")).join(rarity, "sig")
    ordered = terms.groupBy("node", "size", "part").agg(F.sort_array(F.collect_list(F.struct("count", "sig")))["sig"].alias("s"))
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1
    meets = F.flatten(F.transform(F.slice("s", F.lit(1), keep), lambda x: F.array(F.xxhash64(x, "part"), F.xxhash64(x, F.col("part") + 1))))
    rooted = materialize(_with_parities(ordered.select("node", F.col("size").alias("n"), meets.alias("p"), F.col("s").alias("sigs"))).withColumn("root", F.col("node")), "prefix")
    links = missing_links(rooted, threshold)
    alike = check_links(links, sets.select("node", F.col("sigs").alias("h")), threshold, scored=True)
    names = [sets.select(F.col("node").alias(c), F.col("key").alias(f"key{c}")) for c in "uv"]
    pairs = alike.join(names[0], "u").join(names[1], "v")
    out = materialize(pairs.select(F.least("keyu", "keyv").alias("a"), F.greatest("keyu", "keyv").alias("b"), "jaccard"), "pairs")
    discard(sets, rarity, rooted, links, alike)
    return out


# --- fingerprints beside those of the edited text and of the next document


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 500, most_buckets: int = 4_096) -> DataFrame:
    """(bucket, ahead, key, id, t): the documents dealt by ranges of the id, with the head of each range's successor.

    There are ``most_buckets`` at most; a larger one is sorted with spills and streams through its task, which holds two texts.
    Within a bucket, ordered by (ahead, key, t), each row but those marked ``ahead`` is followed by the next document; the
    last bucket is followed by the first document of all. Ids are dealt by quantiles of their column alone; only one
    text for each bucket is sent twice.
    """
    rows = docs.select(id_key(id_col).alias("key"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    total = rows.count()
    n = min(most_buckets, max(1, -(-total // rows_per_bucket)))
    cuts = rows.select("key").agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if cuts:
        steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(edges, at + s - 1) <= F.col("key"), F.lit(False)), at + s).otherwise(at))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    heads = sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.min("key")).collect())
    if not heads:
        return rows.select("bucket", F.lit(False).alias("ahead"), "key", "id", "t")
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}
    target = F.element_at(F.create_map(*[F.lit(x) for k, b in before.items() for x in (k, b)]), F.col("key"))
    ahead = rows.where(F.col("key").isin(list(before))).withColumn("bucket", target)
    return rows.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True))).select("bucket", "ahead", "key", "id", "t")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points replaced by as many (or all) from the front of the next
    document, by ascending id; rows with equal ids follow each other by their text, those with null ids come last. The
    last document is followed by the first, a single one by itself. Null texts are empty; an empty table gives an empty result.
    """
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held, out = None, []

        def judge(row, then):
            doc, raw, sigs = row
            text = raw.decode("utf-8", "replace")
            cut = len(text) // 4
            edited = (text[: len(text) - cut] + then[1].decode("utf-8", "replace")[:cut]).encode("utf-8", "replace")
            changed = signatures(edited, chain)
            return doc, len(text), hashlib.sha256(edited).hexdigest(), encode(sigs), encode(changed), jaccard(sigs, changed), jaccard(sigs, then[2])

        for b in batches:
            for bucket, ahead, doc, raw in zip(*(b.column(i) for i in range(4))):
                bucket, ahead, raw = bucket.as_py(), ahead.as_py(), raw.as_py()
                now = (doc.as_py(), raw, signatures(raw, chain))
                if held and held[0] == bucket:
                    out.append(judge(held[1], now))
                held = None if ahead else (bucket, now)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = with_next(docs, id_col, text_col).repartition("bucket").sortWithinPartitions("bucket", "ahead", "key", "t")
    return rows.select("bucket", "ahead", "id", "t").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
