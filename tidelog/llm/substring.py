"""Exact substring de-duplication by level-wise doubling.

A window of ``length`` words can only repeat if the windows of half that length in it do. So the levels are ``length`` halved
until it is ``FIRST`` words or fewer (13, 25 and 50 words for the default), and only what repeats at one level is extended to the next:

1.  A level. Of the windows of the level's length inside each full window, the one with the smallest hash stands for it
    (the leftmost, if tied). Equal full windows choose alike, so nothing is lost, and few are sent. Neighbouring full windows that
    share it form a run, which carries a hash of all its words. What occurs in one document alone ends here, with its runs.
2.  Runs that survive: if an equal run starts in a smaller document, all its windows are repeats. If all runs of a
    window are equal, that settles them. The others are extended to twice the length, by the same rule: at the last level each
    full window is a run of its own.
3.  When no candidates are left, each document gets its repeated windows, and the words they cover are removed.

Every aggregate combines before its shuffle, and every join back is between plain tables, so Spark can split hot keys. Rows are
told apart by their id and a 64-bit hash of their text: rows with both equal have the same windows, and the same result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, id_key, materialize, release, text_bytes

#: Words of a window at the first level, at most.
FIRST = 16
#: Words hashed at a time; longer documents go in overlapping pieces.
_PIECE = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(int(_C), -1, 1 << 64))
_COLUMNS = ["anchor", "span", "dk", "rid", "at"]
_RUN = ", ".join(f"{c} long" for c in _COLUMNS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from each position on, by doubling."""
    out, have, power, size = None, 0, h, 1
    parts = []
    while size <= length:
        if length & size:
            parts.append((size, power))
        power, size = _mix(power[: max(0, len(power) - size)] * _A + power[size:]), 2 * size
    for size, x in reversed(parts):
        if out is None:
            out, have = x, size
        else:
            n = max(0, len(h) - have - size + 1)
            out, have = _mix(out[:n] * _A + x[have : have + n]), have + size
    return out


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_C, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def _span_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``h[start : start + size]`` for each pair: a polynomial by prefix sums, the same wherever the words stand."""
    up, down = _powers.upto(len(h) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return _mix((prefix[start + size] - prefix[start]) * down[start] + size.astype(np.uint64) * _A)


def levels(length: int) -> list[int]:
    """Window lengths from the first level to ``length``; each is at most twice the one before."""
    out = [length]
    while out[0] > FIRST:
        out.insert(0, (out[0] + 1) // 2)
    if len(out) == 1 and length > 2:
        out.insert(0, (length + 1) // 2)
    return out


def runs(h: np.ndarray, ends: np.ndarray, length: int, level: int | None = None) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, span) of each run in the word hashes ``h`` of several texts that end at ``ends``; the level is half the length by default."""
    level = level or (length + 1) // 2
    empty = np.empty(0, np.int64)
    if len(h) < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    parts = _windows(h, level)
    low = np.uint64((1 << 24) - 1)
    least = _smallest((parts & ~low) | np.arange(len(parts), dtype=np.uint64), length - level + 1) & low
    n = len(h) - length + 1
    begins = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(len(h) + 1, np.int64)
    holds = ends - begins >= length
    np.add.at(edge, begins[holds], 1)
    np.add.at(edge, ends[holds] - length + 1, -1)
    fits = np.cumsum(edge[:n]) > 0
    least = least[:n]
    fresh = fits.copy()
    fresh[1:] &= ~fits[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    windows = np.add.reduceat(fits, start, dtype=np.int64)
    return start, windows, parts[least[start].astype(np.int64)], _span_hash(h, start, windows + length - 1)


def _pieces(keys, texts, length: int):
    """Batches of (word hashes, ends, key of each text, offset of each) of at most some ``_PIECE`` words."""
    hs, owner, offset, total = [], [], [], 0
    for key, text in zip(keys, texts):
        words = text.split()
        if len(words) < length:
            continue
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        for at in range(0, len(h) - length + 1, _PIECE):
            part = h[at : at + _PIECE + length - 1]
            hs.append(part)
            owner.append(key)
            offset.append(at)
            total += len(part)
            if total >= _PIECE:
                yield np.concatenate(hs), np.cumsum([len(x) for x in hs]), np.array(owner), np.array(offset)
                hs, owner, offset, total = [], [], [], 0
    if hs:
        yield np.concatenate(hs), np.cumsum([len(x) for x in hs]), np.array(owner), np.array(offset)


def _pack(windows: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (windows.astype(np.int64) << 32) | start.astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """dk orders documents; with rid, the text's hash, it tells rows apart that share an id, or have none."""
    text = text_bytes(text_col)
    return [id_key(id_col).alias("dk"), F.xxhash64(text).alias("rid"), text.alias("t")]


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).view(np.int64)) for x in columns], _COLUMNS)


def _find_runs(length: int, level: int):
    """The runs of whole texts at the first level."""

    def run(batches):
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for h, ends, owner, offset in _pieces(keys, (x.as_py() for x in b.column(2)), length):
                start, windows, anchor, span = runs(h, ends, length, level)
                k = np.searchsorted(ends, start, side="right")
                begin = np.concatenate([[0], ends[:-1]])
                yield _rows(anchor, span, owner[k, 0], owner[k, 1], _pack(windows, start - begin[k] + offset[k]))
        release()

    return run


def _extend(length: int, level: int):
    """The runs at ``level`` inside the listed runs of the level before."""

    def run(batches):
        for b in batches:
            for dk, rid, text, found in zip(*(b.column(i) for i in range(4))):
                words = text.as_py().split()
                h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
                at = found.values.to_numpy()
                first, size = at & 0xFFFFFFFF, (at >> 32) + length - 1
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size) // _PIECE)) + 1):
                    ends = np.cumsum(size[some])
                    begin = ends - size[some]
                    place = np.arange(ends[-1]) - np.repeat(begin - first[some], size[some])
                    start, windows, anchor, span = runs(h[place], ends, length, level)
                    one = np.ones(len(start), np.int64)
                    yield _rows(anchor, span, one * dk.as_py(), one * rid.as_py(), _pack(windows, place[start]))

    return run


def _survivors(found: DataFrame, tag: str) -> DataFrame:
    """``found``, a level's runs, to those that are repeats and those that have to be extended: dk, rid, at, repeat."""
    shared = materialize(
        found.groupBy("anchor").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi"), F.min("span").alias("s"), F.max("span").alias("z"))
        .where("lo <> hi").select("anchor", F.expr("s <> z").alias("varied")), f"anchors{tag}",
    )
    live = materialize(found.join(shared, "anchor"), f"live{tag}")
    firsts = materialize(live.groupBy("anchor", "span").agg(F.min("dk").alias("first"), F.max("dk").alias("last")).where("first <> last").drop("last"), f"firsts{tag}")
    repeat = F.coalesce(F.expr("first < dk"), F.lit(False)).alias("repeat")
    judged = live.join(firsts, ["anchor", "span"], "left").select("dk", "rid", "at", repeat, "varied").where("repeat or varied").drop("varied")
    judged = materialize(judged, f"judged{tag}")
    discard(found, shared, live, firsts)
    return judged


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(dk, rid, at: list): for each text with repeats, its runs of windows that also start in a smaller document.

    ``at`` packs the first word (32 bits) and the number of windows (above).
    """
    if not 2 <= length <= 4096:
        raise ValueError("length must be from 2 to 4096 words")
    keyed = docs.select(*_keyed(docs, id_col, text_col))
    judged, steps = [], levels(length)
    found = materialize(keyed.mapInArrow(_find_runs(length, steps[0]), _RUN), "runs")
    for level, following in zip(steps, [*steps[1:], None]):
        judged.append(_survivors(found, str(level)))
        open_runs = judged[-1].where("not repeat")
        if following is None or open_runs.isEmpty():
            break
        lists = open_runs.groupBy("dk", "rid").agg(F.collect_set("at").alias("at"))
        # rows that repeat id and text have the same runs: one of them is enough
        texts = keyed.join(lists, ["dk", "rid"]).select("dk", "rid", "t", "at")
        found = materialize(texts.mapInArrow(_extend(length, following), _RUN), f"runs{following}")
    lists = reduce(DataFrame.union, judged).where("repeat").groupBy("dk", "rid").agg(F.collect_set("at").alias("at"))
    out = materialize(lists, "repeats")
    discard(*judged)
    return out


def _cut(text: bytes, at: pa.ListScalar, length: int) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by one space)."""
    words = text.split()
    n = len(words)
    gone = 0
    if at.is_valid:
        at = at.values.to_numpy()
        start = at & 0xFFFFFFFF
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + (at >> 32) - 1 + length, -1)
        stays = np.cumsum(edge[:n]) == 0
        gone = int(n - stays.sum())
        words = [w for w, s in zip(words, stays.tolist()) if s]
    return n, gone, b" ".join(words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text: the words left, joined by one space.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller id; all windows are
    judged on the input. Null and empty texts have no words. Rows with a null id come after all others and keep what
    they share among themselves, as do rows that repeat an id. An empty table gives an empty result.
    """
    lists = repeated_windows(docs, id_col, text_col, length)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *_keyed(docs, id_col, text_col))

    def run(batches):
        for b in batches:
            rows = [_cut(text.as_py(), at, length) for text, at in zip(b.column(1), b.column(2))]
            n, gone, kept = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return keyed.join(lists, ["dk", "rid"], "left").select("id", "t", "at").mapInArrow(run, "id long, n_words long, n_removed long, kept_text string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``docs`` with texts as ``remove_repeats`` leaves them; a text that loses nothing stays as it is, white space included.

    Rows of whose text nothing is left go. All other columns pass through, whatever their names.
    """
    lists = repeated_windows(docs, id_col, text_col, length)
    lists = lists.select(F.col("dk").alias("__dk"), F.col("rid").alias("__rid"), F.col("at").alias("__at"))
    dk, rid, _ = _keyed(docs, id_col, text_col)
    rows = docs.withColumns({"__dk": dk, "__rid": rid}).join(lists, ["__dk", "__rid"], "left").select(*docs.columns, "__at")
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        for b in batches:
            kept, stays = [], []
            for text, found in zip(b.column(at), b.column(b.num_columns - 1)):
                text = text.as_py()
                if found.is_valid and text is not None:
                    text = _cut(text.encode(), found, length)[2].decode()
                    stays.append(bool(text))
                else:
                    stays.append(True)
                kept.append(text)
            columns = [b.column(i) if i != at else pa.array(kept, pa.string()) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, docs_names).filter(pa.array(stays))

    docs_names = docs.columns
    return rows.mapInArrow(run, docs.schema)
