"""SimHash near-duplicates: vantage-point shards over 64-bit fingerprints.

Equal fingerprints are folded first (map-side minimum), so the search sees each value once. A vantage-point tree is
fitted on a bounded sample (``SAMPLE``): every inner node has a vantage fingerprint and a radius. All fingerprints are
routed down the tree. The triangle inequality bounds how far two linked fingerprints can differ in distance to the
vantage, so only those within ``max_bits`` inside the radius are copied to the outer shard too; every linked pair
therefore meets in a shard, and all other branches are pruned. Where the sample is too thin for the tree to reach ``SHARD``, the
task that gets a shard grows the tree further from the shard's own fingerprints, down to ``LEAF``. Within a leaf a
breadth-first search joins what is linked, and gives one link per fingerprint instead of all pairs; ``components`` joins them.

The tree only decides where pairs meet, never whether they are found: links are exact for any sample. A leaf of the sampled
tree has 16 sampled fingerprints or more, so of 10^10 (10^11) distinct fingerprints a shard has some 600,000 (6 million): 5 (50) MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, from_key, hash_sample, id_key, materialize, text_bytes
from .components import components

#: Fingerprints that the tree is fitted on, at most.
SAMPLE = 1 << 18
#: Fingerprints a shard should hold, and those that are searched together in its task.
SHARD, LEAF = 16_384, 2_048
#: Sampled fingerprints that a part must have to be cut.
_LEAST = 32
#: Rows of shards that a task should get.
_TASK = 1 << 19
#: Rows that are routed together.
_ROUTED = 1 << 17
#: Shingles whose bits are counted at a time.
_CHUNK = 65_536


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of the ``size``-word shingles of a UTF-8 text; zero if it has no word."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        h = np.fromiter((xxh64_intdigest(b" ".join(x), 42) for x in zip(*(part[k:] for k in range(size)))), np.uint64, len(part) - size + 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, rid, fp: longs): fp has the fingerprint's bits, rid is the text's hash. A null text has fingerprint zero."""

    def run(batches):
        for b in batches:
            h = np.fromiter((fingerprint(x.as_py(), size) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h.view(np.int64))], ["id", "rid", "fp"])

    text = text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("rid"), text.alias("t")).mapInArrow(run, "id long, rid long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Routes fingerprints to shards such that any two within ``max_bits`` share one."""

    def __init__(self, sample: np.ndarray, total: int, max_bits: int, shard: int = SHARD):
        self.max_bits, self.nodes, self.n_leaves = max_bits, [], 0
        #: Rows that all shards together should get, copies over borders included.
        self.rows = 0.0
        self._scale, self._shard = total / max(1, len(sample)), shard
        self._rng = np.random.default_rng(7)
        self._grow(sample)

    def _cut(self, part: np.ndarray):
        """(vantage, radius, distances) of the cut that leaves the least pairs to compare; None if all leave a part all but whole."""
        best = None
        radius = np.arange(64)
        for v in self._rng.choice(part, min(8, len(part)), replace=False):
            d = _distance(part, v)
            reach = np.bincount(d, minlength=66).cumsum()
            inner = reach[:64]
            outer = len(part) - np.where(radius >= self.max_bits, reach[np.maximum(radius - self.max_bits, 0)], 0)
            cost = np.where((inner > 0) & (outer > 0) & (np.maximum(inner, outer) < 0.97 * len(part)), inner.astype(float) ** 2 + outer.astype(float) ** 2, np.inf)
            mu = int(cost.argmin())
            if np.isfinite(cost[mu]) and (best is None or cost[mu] < best[0]):
                best = (cost[mu], v, mu, d)
        return best and best[1:]

    def _grow(self, sample: np.ndarray) -> None:
        todo = [(sample, None, 0)]
        while todo:
            part, parent, side = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            cut = self._cut(part) if len(part) * self._scale > self._shard and len(part) >= _LEAST else None
            if cut:
                v, mu, d = cut
                self.nodes.append([v, mu, None, None])
                todo += [(part[d > mu - self.max_bits], me, 3), (part[d <= mu], me, 2)]
            else:
                self.nodes.append(self.n_leaves)
                self.n_leaves += 1
                self.rows += len(part) * self._scale

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, fingerprint) rows; a fingerprint near a border has several."""
        leaves, values, todo = [], [], [(0, fps)]
        while todo:
            at, part = todo.pop()
            node = self.nodes[at]
            if not len(part):
                continue
            if isinstance(node, int):
                leaves.append(np.full(len(part), node, np.int32))
                values.append(part)
            else:
                v, mu, inner, outer = node
                d = _distance(part, v)
                todo += [(inner, part[d <= mu]), (outer, part[d > mu - self.max_bits])]
        return (np.concatenate(leaves), np.concatenate(values)) if leaves else (np.empty(0, np.int32), np.empty(0, np.uint64))


def shard_links(fps: np.ndarray, max_bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """``linked`` for a shard of any size: cut further by vantage points of its own until parts hold ``leaf``, or no cut helps."""
    if len(fps) <= leaf:
        return linked(fps, max_bits)
    tree = VantageTree(fps, len(fps), max_bits, leaf)
    shard, value = tree.route(fps)
    order = np.argsort(shard, kind="stable")
    found = [linked(part, max_bits) for part in np.split(value[order], np.searchsorted(shard[order], np.arange(1, tree.n_leaves)))]
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def linked(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for each fingerprint that reaches another of ``fps`` (distinct): to the smallest it reaches.

    Breadth-first search: what is left is sorted by distance to one vantage, so that the triangle inequality leaves a
    band of it to compare. Memory is linear in the shard, however dense it is.
    """
    if len(fps) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d = _distance(fps, fps[0]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    rest = np.split(fps[order], np.searchsorted(d[order], np.arange(1, 65)))
    left, right = [], []
    for ring in range(65):
        while len(rest[ring]):
            queue, group = [(ring, rest[ring][0])], []
            rest[ring] = rest[ring][1:]
            while queue:
                at, x = queue.pop()
                group.append(x)
                for k in range(max(0, at - max_bits), min(64, at + max_bits) + 1):
                    if len(rest[k]) and (near := _distance(rest[k], x) <= max_bits).any():
                        queue += [(k, y) for y in rest[k][near]]
                        rest[k] = rest[k][~near]
            if len(group) > 1:
                g = np.sort(np.array(group, np.uint64).view(np.int64))
                left.append(g[1:])
                right.append(np.full(len(g) - 1, g[0]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _gathered(batches):
    """The first columns of several batches at a time: the tree's nodes are visited once for each."""
    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n >= _ROUTED:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fps`` (fp: long, distinct) to links (u, v) that connect exactly what is within ``max_bits`` of each other."""
    total = fps.count()
    sample = hash_sample(fps.select("fp"), "fp", total, SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    built = VantageTree(np.sort(sample).view(np.uint64), total, max_bits)
    tree = fps.sparkSession.sparkContext.broadcast(built)

    def route(batches):
        for part in _gathered(batches):
            leaf, fp = tree.value.route(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp.view(np.int64))], ["shard", "fp"])

    def search(table: pa.Table) -> pa.Table:
        u, v = shard_links(table.column("fp").to_numpy().view(np.uint64), max_bits)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    routed = fps.select("fp").mapInArrow(route, "shard int, fp long").repartition(int(built.rows) // _TASK + min(built.n_leaves, 8), "shard")
    return routed.groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, rid (hash of the text), fp (long), component_id: the smallest id reachable over links.

    Texts whose fingerprints differ in at most ``max_bits`` bits are linked. Null texts and texts without words have
    fingerprint zero and are linked like others. A row with a null id takes part; it is never the smallest unless its
    class has no other. Repeated rows stay repeated. An empty table gives an empty result.
    """
    each = materialize(fingerprints(docs, id_col, text_col, size), "fp")
    distinct = materialize(each.groupBy("fp").agg(F.min(id_key("id")).alias("first")), "fps")
    roots = materialize(components(fingerprint_links(distinct, max_bits)), "roots")
    named = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    lowest = materialize(named.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    classes = materialize(named.join(lowest, "root").select("fp", "component"), "classes")
    discard(roots, named, lowest, distinct)
    return each.join(classes, "fp").select("id", "rid", "fp", from_key("component").alias("component_id"))
