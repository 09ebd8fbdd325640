"""SimHash near-duplicates by similarity: texts whose word shingles overlap by a Jaccard coefficient of 0.8 or more.

A 64-bit fingerprint with two differing bits finds only the closest copies. Here each text has a long SimHash sketch (512
bits over 3-word shingles). Copies with a coefficient of 0.8 over 5-word shingles differ in about ``FLIPS`` of the bits,
others in half. The sketch is read as several short views; in each view a vantage-point tree deals the sketches to shards, with
copies over the borders as the triangle inequality bounds them, so that all sketches within ``RADIUS`` bits of a view
meet. In a shard each sketch gives a link to the closest sketch, and to the closest of a smaller hash: two rows for
each view, however dense the shard is. Links are then checked by the exact coefficient of the 5-word shingles.

The views only join most of what is alike at a low price; they decide nothing. ``missing_links`` then looks at every pair that they
left in different classes: each text has ``BANDS`` keys, each of ``WIDTH`` minima of its shingles under hashes of their own, so that two
texts at the threshold agree in one of them but for one pair in a billion, at any size of the table. All pairs of a key's list are
compared; a list that would not fit a task is dealt to blocks, of which those of its largest class need not meet each other. What sketches
leave possible is decided by the exact coefficient, in families of texts that may be alike, so that each text's shingles are sent
about once, however many pairs it is in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import discard, from_key, hash_sample, id_key, materialize, release, text_bytes
from .components import components

WORDS, FLIPS, RADIUS, MISS = 8, 0.094, 1, 0.002
#: Differing bits of another word of the sketch that a link may have before it is checked: four deviations over the expected ones.
_NEAR = 16
#: Sketches that the trees are fitted on, at most, and those that a shard of a view should hold.
SAMPLE, SHARD = 16_384, 65_536
_CHUNK = 16_384
#: Keys of a text, and minima in each: of pairs at a coefficient of 0.8, (1 - 0.8 ** 4) ** 40 = 7e-10 agree in none.
BANDS, WIDTH = 40, 4
#: Postings of a key that are compared in one piece; longer lists are dealt out as pairs of blocks. Postings of a task.
LIST, POSTINGS = 4_096, 200_000
#: One node in so many tells which lists are long; lists that the driver deals out, the longest first (a shorter one goes to one task).
_ONE_IN, _LONG = 32, 1 << 20
#: Shingles of a family that are checked in one piece.
FAMILY = 1 << 20
#: Rows and pairs that a worker holds at a time.
_ROWS, _PAIRS = 1_024, 1 << 17
#: Bits of the bitmap that texts are looked up in before they are shuffled, as a power of two: half a megabyte.
MARKS = 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    return np.fromiter((xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(n)), np.uint64, n)


def sketch(h: np.ndarray) -> np.ndarray:
    """``WORDS`` words of 64 bits: the first is the plain fingerprint of the shingle hashes, the others of mixed ones."""
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        for k in range(WORDS):
            g = part
            if k:
                g = (part ^ (part >> np.uint64(31))) * _ODD[k]
                g = g ^ (g >> np.uint64(29))
            ones[k] += np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel()


_SKETCH = [f"s{k}" for k in range(WORDS)]


_SEEDS = np.random.default_rng(41).integers(0, 2**64, (2, BANDS * WIDTH), dtype=np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of the distinct shingles ``h``: each mixes the minima under ``WIDTH`` hashes; none for no shingles."""
    if not len(h):
        return np.empty(0, np.uint64)
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        x = (h[at : at + 1024] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[5]
    for column in low.reshape(BANDS, WIDTH).T:
        out = _mix(out ^ column)
    return out


def parities(h: np.ndarray) -> bytes:
    """For each of 512 cells, whether an odd number of the shingles falls into it: two sets differ in as many shingles as cells, or more."""
    return np.packbits((np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(id, rid: hash of the text, node: hash of its words, n: its distinct shingles, p: their ``band_keys``, m: ``parities``,
    s0 ... s7) for each row; without words the sketch is zero and there are no shingles."""

    def run(batches):
        for b in batches:
            s, node, n, first = np.zeros((b.num_rows, WORDS), np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), []
            m = []
            for i, x in enumerate(b.column(2)):
                words = x.as_py().lower().split()
                s[i], node[i] = sketch(_shingles(words, 3)), xxh64_intdigest(b" ".join(words), 7)
                h = np.unique(_shingles(words, size))
                n[i] = len(h)
                m.append(parities(h))
                first.append(band_keys(h).view(np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))
            del first
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node.view(np.int64)), pa.array(n), p, pa.array(m, pa.binary()), *(pa.array(np.ascontiguousarray(s[:, k]).view(np.int64)) for k in range(WORDS))], ["id", "rid", "node", "n", "p", "m", *_SKETCH])
        release()

    text = text_bytes(text_col)
    columns = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("rid"), text.alias("t")]
    return docs.select(*columns).mapInArrow(run, "id long, rid long, node long, n int, p array<long>, m binary, " + ", ".join(f"{c} long" for c in _SKETCH))


def view_plan(total: int) -> tuple[int, int]:
    """(bits of a view, views) for so many sketches. What the views miss, as they do more often where an edit changes more bits
    than ``FLIPS`` says or where the sketch has no bits for more views, is left to ``missing_links``."""
    bits = max(16, math.ceil(math.log2(max(2, total))) + 6)
    hit = sum(math.comb(bits, k) * FLIPS**k * (1 - FLIPS) ** (bits - k) for k in range(RADIUS + 1))
    return bits, max(1, min(64 * WORDS // bits, math.ceil(math.log(MISS) / math.log(1 - hit))))


def view(s: np.ndarray, at: int, bits: int) -> np.ndarray:
    """Bits ``at * bits`` and on of the sketches (rows of words), as one number each."""
    word, shift = divmod(at * bits, 64)
    out = s[:, word] >> np.uint64(shift)
    if shift + bits > 64:
        out = out | (s[:, word + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << bits) - 1)


def other_word(at: int, bits: int) -> int:
    """A word of the sketch that view ``at`` does not read; it changes from view to view, so that each judges closeness anew."""
    used = {at * bits // 64, ((at + 1) * bits - 1) // 64}
    return next(w % WORDS for w in range(3 * at + 1, 3 * at + 1 + WORDS) if w % WORDS not in used)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class ViewTree:
    """A vantage-point tree over one view. Where a part's views are all but equal (a large group of copies), it is split by
    distance over the whole sketch, with a border of two bits or, failing that, none; where even those are equal, by a hash of
    the node that differs from view to view. So no group has to fit one task. Pairs that this parts in all views are found by ``missing_links``."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, total: int, at: int, bits: int, shard: int = SHARD):
        self.at, self.bits, self.nodes, self.n_leaves = at, bits, [], 0
        self._scale, self._shard, self._rng = total / max(1, len(sample)), shard, np.random.default_rng(11 + at)
        self._grow(sample, view(sample, at, bits), ids, 0)

    def _coin(self, ids: np.ndarray, depth: int) -> np.ndarray:
        h = (ids ^ np.uint64(977 * self.at + depth)) * _ODD[1]
        return (h ^ (h >> np.uint64(33))) * _ODD[2] >> np.uint64(63) == 0

    def _cut(self, d: np.ndarray, border: int, top: int):
        """(cost, radius) of the best cut of distances; None if no cut makes both parts smaller."""
        reach = np.bincount(d, minlength=top + 1).cumsum()
        mu = np.arange(top)
        inner = reach[:top]
        outer = len(d) - np.where(mu >= border, reach[np.maximum(mu - border, 0)], 0)
        cost = np.where((inner > 0) & (outer > 0) & (np.maximum(inner, outer) < 0.9 * len(d)), inner.astype(float) ** 2 + outer.astype(float) ** 2, np.inf)
        best = int(cost.argmin())
        return (cost[best], best) if np.isfinite(cost[best]) else None

    def _grow(self, s: np.ndarray, x: np.ndarray, ids: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(s) * self._scale > self._shard and len(s) >= 32 and depth < 64:
            picks = self._rng.choice(len(s), min(8, len(s)), replace=False)
            for whole, border, top in ((False, RADIUS, self.bits), (True, 2, 64 * WORDS), (True, 0, 64 * WORDS)):
                best = None
                for p in picks:
                    d = _apart(s, s[p]) if whole else np.bitwise_count(x ^ x[p]).astype(np.int64)
                    found = self._cut(d, border, top)
                    if found and (best is None or found[0] < best[0]):
                        best = (*found, p, d)
                if best:
                    _, mu, p, d = best
                    inner, outer = d <= mu, d > mu - border
                    self.nodes[me] = (whole, border, s[p] if whole else x[p], mu, self._grow(s[inner], x[inner], ids[inner], depth + 1), self._grow(s[outer], x[outer], ids[outer], depth + 1))
                    return me
            if len(s) * self._scale > 2 * self._shard:
                inner = self._coin(ids, depth)
                self.nodes[me] = (None, depth, None, 0, self._grow(s[inner], x[inner], ids[inner], depth + 1), self._grow(s[~inner], x[~inner], ids[~inner], depth + 1))
                return me
        # a part that the sample is too thin to cut is dealt by the last bits of its views
        parts = 1 << math.ceil(math.log2(max(1.0, len(s) * self._scale / (2 * self._shard))))
        self.nodes[me] = (self.n_leaves, parts)
        self.n_leaves += parts
        return me

    def route(self, s: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, rows of ``s``) pairs."""
        x, out, todo = view(s, self.at, self.bits), [], [(0, np.arange(len(s)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if len(node) == 2:
                leaf, parts = node
                side = (x[rows] & np.uint64(parts - 1)).astype(np.int64)
                out += [(leaf + k, rows[side == k]) for k in np.unique(side).tolist()]
                continue
            whole, border, v, mu, inner, outer = node
            if whole is None:
                heads = self._coin(ids[rows], border)
                todo += [(inner, rows[heads]), (outer, rows[~heads])]
                continue
            d = _apart(s[rows], v) if whole else np.bitwise_count(x[rows] ^ v)
            todo += [(inner, rows[d <= mu]), (outer, rows[d.astype(np.int64) > mu - border])]
        return out


def closest(x: np.ndarray, y: np.ndarray, rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j): for each row the closest other one (by ``y``) within one bit of its view ``x``, and the closest of a smaller rank.

    Rows are sorted by view; for each bit, a row's partners are the run of the view with that bit flipped. Short runs are
    paired at once, long ones compared block by block, so memory stays bounded and all partners count.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    y, rank = y[order], rank[order]
    runs, start, count = np.unique(x[order], return_index=True, return_counts=True)
    low = np.full((2, n), np.iinfo(np.int64).max)  # distance * n + partner: of any partner, of one of a smaller rank

    def pairs(i, j):
        d = np.bitwise_count(y[i] ^ y[j]).astype(np.int64)
        keep = (i != j) & (d <= _NEAR)
        i, j, d = i[keep], j[keep], d[keep]
        np.minimum.at(low[0], i, d * n + j)
        keep = rank[j] < rank[i]
        np.minimum.at(low[1], i[keep], (d * n + j)[keep])

    def block(i, j):
        step = max(1, (1 << 21) // len(j))
        for at in range(0, len(i), step):
            r = i[at : at + step]
            d = np.bitwise_count(y[r][:, None] ^ y[j][None, :])
            d[r[:, None] == j[None, :]] = 255
            for k in range(2):
                if k:
                    d = np.where(rank[j][None, :] < rank[r][:, None], d, 255)
                best = d.argmin(1)
                least = d[np.arange(len(r)), best].astype(np.int64)
                low[k, r] = np.where(least <= _NEAR, np.minimum(low[k, r], least * n + j[best]), low[k, r])

    for flip in (0, *(1 << b for b in range(bits))):
        want = runs ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(runs, want), len(runs) - 1)
        mine = np.flatnonzero((runs[at] == want) & ((count > 1) | (flip > 0)))
        other = at[mine]
        size = count[mine] * count[other]
        short = size <= 4096
        cuts = np.flatnonzero(np.diff(np.cumsum(size[short]) >> 21)) + 1
        for p, q in zip(np.split(mine[short], cuts), np.split(other[short], cuts)):
            if len(p):
                m = count[p] * count[q]
                first = np.repeat(np.cumsum(m) - m, m)
                k = np.arange(m.sum()) - first
                width = np.repeat(count[q], m)
                pairs(np.repeat(start[p], m) + k // width, np.repeat(start[q], m) + k % width)
        for p, q in zip(mine[~short].tolist(), other[~short].tolist()):
            block(np.arange(start[p], start[p] + count[p]), np.arange(start[q], start[q] + count[q]))
    left = [np.flatnonzero(k < np.iinfo(np.int64).max) for k in low]
    i = np.concatenate(left)
    j = np.concatenate([low[k, r] % n for k, r in enumerate(left)])
    return order[i], order[j]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, s0 ... s7) to links (u, v) of nodes that may be alike; distinct, u < v."""
    total = nodes.count()
    bits, views = view_plan(total)
    sample = hash_sample(nodes.select("node", *_SKETCH), "node", total, SAMPLE).toPandas()
    ids, sample = sample["node"].to_numpy(np.int64).view(np.uint64), np.ascontiguousarray(sample[_SKETCH].to_numpy(np.int64)).view(np.uint64)
    trees, first = [], [0]
    for k in range(views):
        trees.append(ViewTree(sample, ids, total, k, bits))
        first.append(first[-1] + trees[-1].n_leaves)
    shared = nodes.sparkSession.sparkContext.broadcast((trees, first))
    names = ["shard", "x", "node", "y"]

    def route(batches):
        trees, first = shared.value
        for b in batches:
            s = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(WORDS)], 1)
            ids = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                x = view(s, k, bits).view(np.int64)
                parts = tree.route(s, ids)
                rows = np.concatenate([r for _, r in parts]) if parts else np.empty(0, np.int64)
                shard = np.concatenate([np.full(len(r), first[k] + leaf, np.int32) for leaf, r in parts]) if parts else np.empty(0, np.int32)
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(x[rows]), b.column(0).take(picked), b.column(1 + other_word(k, bits)).take(picked)], names)

    def search(table: pa.Table) -> pa.Table:
        x, node, y = (table.column(c).to_numpy() for c in ("x", "node", "y"))
        i, j = closest(x.view(np.uint64), y.view(np.uint64), node, bits)
        return pa.table({"u": pa.array(np.minimum(node[i], node[j]), pa.int64()), "v": pa.array(np.maximum(node[i], node[j]), pa.int64())})

    routed = nodes.select("node", *_SKETCH).mapInArrow(route, "shard int, " + ", ".join(f"{n} long" for n in names[1:]))
    return routed.groupBy("shard").applyInArrow(search, "u long, v long").distinct()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[4]
    return h ^ (h >> np.uint64(29))


def _from_to(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``count[i]`` rows of each i: i, and the row's number among them."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def _slices(batches):
    return (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))


def list_pairs(g: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (u, v), u < v, of nodes of different roots in one group ``g`` whose numbers of shingles ``n`` and ``parities`` ``m`` (a row of
    words each) leave the coefficient possible."""
    order = np.lexsort((root, g))
    g, node, root, n, m = g[order], node[order], root[order], n[order], m[order]
    found = [np.empty((2, 0), np.int64)]
    most = (1 - threshold) / (1 + threshold)

    def pairs(i, j):
        keep = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6
        i, j = i[keep], j[keep]
        keep = _apart(m[i], m[j]) <= most * (n[i] + n[j]) + 1e-6
        u, v = node[i[keep]], node[j[keep]]
        found.append(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1))

    # each row meets those of its group with larger roots
    last = np.searchsorted(g, g, "right")
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (root[1:] != root[:-1])])) if len(g) else np.empty(0, np.int64)
    sizes = np.diff(np.append(new, len(g)))
    same = np.repeat(new + sizes, sizes)
    row = np.flatnonzero(same < last)
    after = (last - same)[row]
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(after) // _PAIRS)) + 1):
        i, step = _from_to(after[part])
        pairs(row[part][i], same[row[part]][i] + step)
    u, v = np.unique(np.concatenate(found, axis=1), axis=1)
    return u, v


def _long_lists(rooted: DataFrame) -> tuple[np.ndarray, ...]:
    """(key, root of its largest class, blocks of that class, blocks of all others) of the keys with more than ``LIST`` nodes, by key."""
    one_in = rooted.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(_ONE_IN)) == 0).select(F.explode("p").alias("t"))
    likely = one_in.groupBy("t").count().where(F.col("count") > LIST // (2 * _ONE_IN)).orderBy(F.desc("count")).limit(_LONG).toPandas()["t"]
    shared = rooted.sparkSession.sparkContext.broadcast(np.sort(likely.to_numpy(np.int64)))

    def among(batches):
        for b in _slices(batches):
            (row, _), p = _from_to(b.column(1).value_lengths().to_numpy().astype(np.int64)), b.column(1).flatten()
            keep = np.flatnonzero(_held(shared.value, p.to_numpy())[1]) if len(shared.value) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([p.take(pa.array(keep)), b.column(0).take(pa.array(row[keep]))], ["t", "root"])

    classes = rooted.select("root", "p").mapInArrow(among, "t long, root long").groupBy("t", "root").agg(F.count("*").alias("n"))
    lists = classes.groupBy("t").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("root"))
    found = (lists.where(F.col("all") > LIST).toPandas() if len(likely) else lists.limit(0).toPandas()).sort_values("t")
    t, every, most, root = (found[c].to_numpy(np.int64) for c in ("t", "all", "most", "root"))
    return t, root, -(-most // LIST), -(-(every - most) // LIST)


def _held(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each ``x`` in the sorted ``keys``, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
    return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)


def _groups(token, node, root, lists):
    """(posting, group, label) rows: where each posting is compared, and as what. Those of one label in a group are not compared.

    A long list's largest class is dealt to its blocks, and each of these meets all blocks of the others; the others meet among themselves in
    pairs of their blocks. Where there are no others, nothing is compared.
    """
    keys, largest, main, rest = lists
    at, long = _held(keys, token)
    k = np.ones(len(token), np.int64)
    if long.any():
        mine = long & (largest[at] == root)
        k = np.where(mine, rest[at], np.where(long, main[at] + rest[at], 1))
    for part in np.split(np.arange(len(token)), np.flatnonzero(np.diff(np.cumsum(k) // _PAIRS)) + 1):
        i, step = _from_to(k[part])
        i = part[i]
        group, label = token[i].view(np.uint64).copy(), root[i].copy()
        if long.any():
            x, h = at[i], _mix(node[i].view(np.uint64)) >> np.uint64(1)
            side = np.where(mine[i], 0, np.where(step < main[x], 1, 2))
            of = lambda blocks: (h % np.maximum(blocks[x], 1).astype(np.uint64)).astype(np.int64)
            own, other = np.where(side == 0, of(main), of(rest)), np.where(side == 2, step - main[x], step)
            a = np.where(side == 0, own, np.where(side == 1, other, np.minimum(own, other)))
            b = np.where(side == 0, other, np.where(side == 1, own, np.maximum(own, other)))
            place = ((side == 2).astype(np.int64) << 62 | a << 31 | b).view(np.uint64)
            group = np.where(long[i], _mix(group ^ _mix(place + np.uint64(1))), group)
            label = np.where(long[i] & (side == 1), largest[x] ^ 1, label)
        yield i, group, label


def of_several_roots(g: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether a row's group has rows of another root."""
    order = np.lexsort((root, g))
    g, root = g[order], root[order]
    first, last = np.searchsorted(g, g, "left"), np.searchsorted(g, g, "right") - 1
    out = np.empty(len(g), bool)
    out[order] = root[first] != root[last]
    return out


def missing_links(rooted: DataFrame, threshold: float) -> DataFrame:
    """``rooted`` (node, root, n, p, m) to links (u, v), distinct, u < v: pairs of different roots that share a key, and that ``n`` and ``m`` leave
    possible. Most lists have nodes of one root alone and end in a first pass; only the rows of the others get their ``m``."""
    lists = _long_lists(rooted)
    dealt = rooted.sparkSession.sparkContext.broadcast(lists)
    total = rooted.agg(F.sum(F.size("p"))).first()[0] or 0
    tasks = max(1, -(-total // POSTINGS))

    def deal(batches):
        for b in _slices(batches):
            node, root, n = (b.column(c).to_numpy().astype(np.int64) for c in range(3))
            row, _ = _from_to(b.column(3).value_lengths().to_numpy().astype(np.int64))
            token = b.column(3).flatten().to_numpy()
            for i, group, label in _groups(token, node[row], root[row], dealt.value):
                columns = [(group % np.uint64(tasks)).astype(np.int32), group.view(np.int64), node[row[i]], label, n[row[i]].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["task", "g", "node", "root", "n"])

    def mixed(table: pa.Table) -> pa.Table:
        keep = of_several_roots(table.column("g").to_numpy(), table.column("root").to_numpy())
        return table.filter(pa.array(keep))

    def search(table: pa.Table) -> pa.Table:
        g, node, root, n = (table.column(c).to_numpy() for c in ("g", "node", "root", "n"))
        m = np.frombuffer(b"".join(table.column("m").to_pylist()), np.uint64).reshape(-1, 8)
        u, v = list_pairs(g, node, root, n.astype(np.int64), m, threshold)
        release()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    schema = "task int, g long, node long, root long, n int"
    rows = rooted.select("node", "root", "n", "p").mapInArrow(deal, schema).groupBy("task").applyInArrow(mixed, schema)
    known = materialize(rows, "mixed")
    found = known.join(rooted.select("node", "m"), "node").groupBy("task").applyInArrow(search, "u long, v long").distinct()
    out = materialize(found, "missing")
    discard(known)
    return out


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, h: distinct hashes of the text's shingles) for ``wanted`` (node, key, rid)."""

    def run(batches):
        for b in batches:
            sets = [np.unique(_shingles(x.as_py().lower().split(), size)).view(np.int64) for x in b.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "h"])

    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(marks.value, b.column(1).to_numpy())))

    text = text_bytes(text_col)
    rows = docs.select(id_key(id_col).alias("key"), F.xxhash64(text).alias("rid"), text.alias("t")).mapInArrow(likely, "key long, rid long, t binary")
    return rows.join(wanted, ["key", "rid"]).dropDuplicates(["node"]).select("node", "t").mapInArrow(run, "node long, h array<long>")


def _slot(rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = (rid.view(np.uint64) * _ODD[3]) >> np.uint64(64 - MARKS)
    return (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


def _marked(marks: np.ndarray, rid: np.ndarray) -> np.ndarray:
    at, bit = _slot(rid)
    return (marks[at] & bit) != 0


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the wanted texts' hashes. It only spares texts a shuffle: what it lets through is joined exactly."""

    def mark(batches):
        bits = np.zeros(1 << (MARKS - 6), np.uint64)
        for b in batches:
            at, bit = _slot(b.column(0).to_numpy())
            np.bitwise_or.at(bits, at, bit)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    rows = wanted.select("rid").mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (MARKS - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def possible_links(links: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The links whose texts' parities (``nodes``: node, n, m) leave the coefficient ``threshold`` possible: spares the others' sets a shuffle."""
    ends = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("m").alias(f"m{c}")) for c in "uv"]
    most = (1 - threshold) / (1 + threshold)

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, 8) for c in (4, 5))
            yield b.select(["u", "v"]).filter(pa.array(_apart(x, y) <= most * n + 1e-6))

    return links.join(ends[0], "u").join(ends[1], "v").select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(run, "u long, v long")


def check_links(links: DataFrame, sets: DataFrame, threshold: float, scored: bool = False) -> DataFrame:
    """The ``links`` (u, v) whose nodes' shingle sets (``sets``: node, h) have a Jaccard coefficient of ``threshold`` or more; with it if ``scored``.

    Links are checked in families, the connected components that they form: each set is sent to its family's task once. A
    family of more than ``FAMILY`` shingles is dealt to blocks, and each pair of blocks with links gets the sets that these need.
    """
    family = materialize(components(links), "family")
    sized = family.join(sets.select("node", F.size("h").alias("n")), "node")
    parts = sized.groupBy("root").agg(F.sum("n").alias("all")).select("root", F.ceil(F.col("all") / FAMILY).alias("parts"), "all")
    placed = materialize(sized.join(parts, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).alias("block")), "placed")
    shingles = parts.agg(F.sum("all")).first()[0] or 0
    ends = [placed.select(F.col("node").alias(c), F.col("root").alias(f"root{c}"), F.col("block").alias(f"block{c}")) for c in "uv"]
    group = F.pmod(F.xxhash64("rootu", F.least("blocku", "blockv"), F.greatest("blocku", "blockv")), F.lit(int(shingles) // FAMILY + 1)).cast("int")
    pairs = materialize(links.join(ends[0], "u").join(ends[1], "v").select(group.alias("task"), "u", "v"), "pairs")
    wanted = pairs.select("task", F.col("u").alias("node")).union(pairs.select("task", "v")).distinct()

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        node = right.column("node").to_numpy()
        h = right.column("h").combine_chunks()
        values, ends = h.values.to_numpy(), h.offsets.to_numpy()
        order = np.argsort(node)
        u, v = (left.column(c).to_numpy() for c in "uv")
        keep, score = np.zeros(len(u), bool), np.zeros(len(u))
        for k, (i, j) in enumerate(zip(order[np.searchsorted(node[order], u)].tolist(), order[np.searchsorted(node[order], v)].tolist())):
            a, b = values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[k] = both >= threshold * (len(a) + len(b) - both) - 1e-9
            score[k] = both / (len(a) + len(b) - both)
        release()
        return pa.table({"u": pa.array(u[keep]), "v": pa.array(v[keep])} | ({"jaccard": pa.array(score[keep])} if scored else {}))

    sent = wanted.join(sets, "node").select(F.col("task").alias("of"), "node", "h")
    out = materialize(pairs.groupBy("task").cogroup(sent.groupBy("of")).applyInArrow(verify, "u long, v long" + ", jaccard double" * scored), "alike")
    discard(family, placed, pairs)
    return out


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, size: int) -> DataFrame:
    """id, rid, root (the same for all rows of a class, and for no others) and component, the smallest ``id_key`` of the class."""
    each = materialize(sketches(docs, id_col, text_col, size), "sketches")
    grouped = each.groupBy("node", *_SKETCH).agg(F.min(F.struct(id_key("id").alias("key"), "rid", "n", "p", "m")).alias("low"))
    nodes = materialize(grouped.select("node", F.col("low.key").alias("first"), F.col("low.rid").alias("rid"), F.col("low.n").alias("n"), F.col("low.p").alias("p"), F.col("low.m").alias("m"), *_SKETCH), "nodes")
    slim = materialize(each.select("id", "rid", "node"), "rows")
    discard(each)

    def checked(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
        wanted = materialize(ends.join(nodes, "node").select("node", F.col("first").alias("key"), "rid"), "wanted")
        sets = materialize(_shingle_sets(docs, wanted, id_col, text_col, size), "shingles")
        alike = check_links(links, sets, threshold)
        discard(links, wanted, sets)
        return alike

    found = materialize(candidate_links(nodes), "candidates")
    alike = checked(materialize(possible_links(found, nodes, threshold), "possible"))
    discard(found)
    roots = materialize(components(alike), "roots")
    rooted = materialize(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "p", "m"), "rooted")
    discard(roots)
    missing = missing_links(rooted, threshold)
    discard(rooted)
    more = checked(missing)
    roots = materialize(components(alike.union(more)), "roots")
    rooted = materialize(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    classes = materialize(rooted.join(lowest, "root").select("node", "root", "component"), "classes")
    discard(alike, more, roots, rooted, lowest, nodes)
    out = materialize(slim.join(classes, "node").select("id", "rid", "root", "component"), "classified")
    discard(slim, classes)
    return out


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, rid, component_id: the smallest id reachable over links.

    Linked are texts of equal words (A-Z in lower case), and those found alike by ``threshold`` over ``size``-word shingles.
    Texts without words are alike. Rows with null ids take part; they are never the
    smallest unless their class has no other. Repeated rows stay repeated; an empty table gives an empty result.
    """
    return _classified(docs, id_col, text_col, threshold, size).select("id", "rid", from_key("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with one row of each class of ``similar_classes``: that with the smallest id, a null one being the largest.

    Of several rows with that id, or with null ids in a class that has no others, that with the smallest hash of its text stays; of rows
    with equal id and text, any one. Texts without words are one class. An empty table gives an empty result.
    """
    found = _classified(docs, id_col, text_col, threshold, size).select("root", id_key("id").alias("__key"), F.col("rid").alias("__rid"))
    pairs = found.groupBy("root", "__key", "__rid").agg(F.count("*").alias("__n"))
    firsts = pairs.groupBy("root").agg(F.min(F.struct("__key", "__rid")).alias("__first"))
    judged = pairs.join(firsts, "root").select("__key", "__rid", (F.struct("__key", "__rid") == F.col("__first")).alias("__stays"), "__n")
    judged = materialize(judged.where("not __stays or __n > 1"), "judged")
    keyed = docs.withColumns({"__key": id_key(id_col), "__rid": F.xxhash64(text_bytes(text_col))})
    out = keyed.join(judged.select("__key", "__rid"), ["__key", "__rid"], "left_anti").select(*docs.columns)
    if judged.where("__stays").isEmpty():
        return out
    repeated = keyed.join(judged.where("__stays").select("__key", "__rid"), ["__key", "__rid"]).dropDuplicates(["__key", "__rid"])
    return out.union(repeated.select(*docs.columns))
