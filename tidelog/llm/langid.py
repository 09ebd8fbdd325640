"""Language identification with interpolated Kneser-Ney character models.

One model per language over folded letters (lower case; everything that is no letter is one boundary). The n-grams of
each order lie in sorted arrays of 64-bit hashes, shared by all languages, with a column of log probabilities for
each. A text's language is the one with the lowest cross-entropy per character. A text is rejected if that entropy is
beyond what held-back training texts of the language reach at its length.

The models are fitted on a bounded sample of labelled rows: about ``per_language`` whole documents of each language (less if
they are long: ``LETTERS`` code points in all), chosen by a hash of id and text, one in eight of them for calibration only. There
are models for the ``LANGUAGES`` most frequent labels. So what is collected and broadcast is bounded, whatever the table's size.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, remainder_of_id

#: Documents of each language that a model is fitted on, about.
PER_LANGUAGE = 400
#: Code points that a language's sample holds, about; each of its texts is whole.
LETTERS = 4_000_000
#: Languages that have models, at most.
LANGUAGES = 256
ORDER = 4
UNKNOWN = "und"
#: Least variance of the entropies of whole texts.
SPREAD = 0.02
_M = np.uint64(0x9E3779B97F4A7C15)
#: Characters scored at a time.
_SLICE = 1 << 18


@cache
def _fold() -> np.ndarray:
    """Code point to folded letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x32400):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def letters(text: str) -> np.ndarray:
    """Folded letters with single zeros between words, and one before and after."""
    c = _fold()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    keep[0] = True
    return c[keep]


def _hashes(c: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters up to each position, from position ``order - 1`` on."""
    h = np.zeros(max(0, len(c) - order + 1), np.uint64)
    for k in range(order):
        h = (h ^ (c[k : k + len(h)].astype(np.uint64) + np.uint64(1))) * _M
        h ^= h >> np.uint64(29)
    return h


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


class _Counts:
    """Kneser-Ney statistics of one language: for each order, n-grams with their (continuation) counts."""

    def __init__(self, texts: list[np.ndarray], order: int):
        chars = np.concatenate(texts)
        ends = np.cumsum([len(x) for x in texts])
        self.grams, self.weights, self.contexts, self.totals, self.kinds = [], [], [], [], []
        for k in range(1, order + 1):
            # the n-gram at each place, if it lies in one text; below the highest order each counts once for each letter before it
            size = k if k == order else k + 1
            place = np.arange(len(chars) - size + 1)
            inside = np.ones(len(place), bool)
            for e in ends[:-1]:
                inside[max(0, e - size + 1) : e] = False
            place = place[inside]
            if k < order:
                _, first = np.unique(_hashes(chars, size)[place], return_index=True)
                place = place[first] + 1
            keys, first, n = np.unique(_hashes(chars, k)[place], return_index=True, return_counts=True)
            self.grams.append(keys)
            self.weights.append(n.astype(np.float64))
            context = _hashes(chars, k - 1)[place[first]] if k > 1 else np.zeros(len(keys), np.uint64)
            seen, which = np.unique(context, return_inverse=True)
            self.contexts.append(seen)
            self.totals.append(np.bincount(which, self.weights[-1]))
            self.kinds.append(np.bincount(which).astype(np.float64))


class LanguageModel:
    def __init__(self, labelled: dict[str, list[np.ndarray]], order: int = ORDER, discount: float = 0.75):
        self.languages, self.order = sorted(labelled), order
        counts = [_Counts(labelled[x], order) for x in self.languages]
        width = len(counts)
        letters_seen = len(np.unique(np.concatenate([c.grams[0] for c in counts])))
        self.floor = -np.log(letters_seen + 1.0)
        self.keys, self.logp, self.contexts, self.backoff = [], [], [], []
        # each order's n-grams over all languages, with a place where it occurs for its context and shorter n-gram
        chars = np.concatenate([t for x in self.languages for t in labelled[x]])
        for k in range(1, order + 1):
            keys = np.unique(np.concatenate([c.grams[k - 1] for c in counts]))
            contexts = np.unique(np.concatenate([c.contexts[k - 1] for c in counts]))
            backoff = np.zeros((len(contexts), width), np.float32)
            h = _hashes(chars, k)
            place = np.full(len(keys), -1)
            at, known = _lookup(keys, h)
            place[at[known]] = np.flatnonzero(known)
            context = _hashes(chars, k - 1)[place] if k > 1 else np.zeros(len(keys), np.uint64)
            if k > 1:
                lower = self._lower(k - 1, _hashes(chars, k - 1)[place + 1])
            else:
                lower = np.full((len(keys), width), self.floor)
            logp = np.empty((len(keys), width), np.float32)
            for j, c in enumerate(counts):
                share = np.zeros(len(contexts))
                total = np.ones(len(contexts))
                at, known = _lookup(contexts, c.contexts[k - 1])
                total[at] = c.totals[k - 1]
                share[at] = discount * c.kinds[k - 1] / c.totals[k - 1]
                seen = share > 0
                backoff[:, j] = np.where(seen, np.log(np.where(seen, share, 1)), 0)
                n = np.zeros(len(keys))
                at, _ = _lookup(keys, c.grams[k - 1])
                n[at] = c.weights[k - 1]
                at, known = _lookup(contexts, context)
                gamma = np.where(seen[at], share[at], 1.0)
                p = np.maximum(n - discount, 0) / total[at] + gamma * np.exp(lower[:, j])
                logp[:, j] = np.log(p)
            self.keys.append(keys)
            self.logp.append(logp)
            self.contexts.append(contexts)
            self.backoff.append(backoff)
        self.limits = {}

    def _lower(self, k: int, h: np.ndarray) -> np.ndarray:
        """Log probabilities of known n-grams of order k, for each language."""
        at, known = _lookup(self.keys[k - 1], h)
        return np.where(known[:, None], self.logp[k - 1][at].astype(np.float64), self.floor)

    def each(self, c: np.ndarray) -> np.ndarray:
        """Log probability of each character but the first, for each language."""
        out = np.zeros((len(c) - 1, len(self.languages)), np.float32)
        todo = np.arange(1, len(c))
        for k in range(self.order, 0, -1):
            here = todo[todo >= k - 1]
            later = todo[todo < k - 1]
            h = _hashes(c, k)
            at, known = _lookup(self.keys[k - 1], h[here - k + 1])
            out[here[known] - 1] += self.logp[k - 1][at[known]]
            missed = here[~known]
            if k > 1 and len(missed):
                at, found = _lookup(self.contexts[k - 1], _hashes(c, k - 1)[missed - k + 1])
                out[missed[found] - 1] += self.backoff[k - 1][at[found]]
            todo = np.concatenate([later, missed]) if len(later) else missed
        # an unseen character
        out[todo - 1] += (self.backoff[0][0] if len(self.backoff[0]) else 0) + np.float32(self.floor)
        return out

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per character for each text and language, characters)."""
        out = np.zeros((len(texts), len(self.languages)))
        n = np.array([max(1, len(t) - 1) for t in texts])
        batch, who = [], []

        def flush():
            if batch:
                p = self.each(np.concatenate(batch))
                p = np.concatenate([np.zeros((1, p.shape[1]), np.float32), p])
                begins = np.cumsum([0] + [len(x) for x in batch[:-1]])
                p[begins] = 0  # the boundary that starts a text costs nothing
                np.add.at(out, who, np.add.reduceat(p, begins, axis=0, dtype=np.float64))
                batch.clear()
                who.clear()

        size = 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), _SLICE):
                piece = t[max(0, at - self.order) : at + _SLICE]
                if at:  # what the pieces share is scored once: take the overlap off again
                    flush()
                    out[i] -= self.each(t[at - self.order : at]).sum(0)
                batch.append(piece)
                who.append(i)
                size += len(piece)
                if size >= _SLICE:
                    flush()
                    size = 0
        flush()
        return -out / n[:, None], n

    def calibrate(self, held: dict[str, list[np.ndarray]]) -> None:
        """Entropy limits: mean + reach * sqrt(spread + noise / characters), beyond all calibration texts.

        The spread is ``SPREAD`` at least: texts with long quotations in another language are texts of their own still.
        """
        for j, x in enumerate(self.languages):
            texts = held.get(x) or []
            e, n = self.entropies(texts) if texts else (np.zeros((0, len(self.languages))), np.zeros(0))
            e = e[:, j]
            long = e[n >= 200] if (n >= 200).sum() >= 5 else e
            mean, spread = (float(long.mean()), float(long.var()) + SPREAD) if len(long) else (3.0, 1.0)
            z = (e - mean) / np.sqrt(spread + 6.0 / np.maximum(n, 1))
            self.limits[x] = (mean, spread, 1.5 * max(6.0, float(z.max()) if len(z) else 6.0))

    def accepts(self, language: str, entropy: float, n: int) -> bool:
        mean, spread, reach = self.limits[language]
        return entropy <= mean + reach * (spread + 6.0 / n) ** 0.5


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER) -> LanguageModel | None:
    """A model of the rows where ``learn`` holds and lang is not null; None if there are none with a letter.

    The sample holds about ``per_language`` rows of each of the ``LANGUAGES`` most frequent languages, by a hash of id and text, whatever
    the table's size; fewer where the language's texts are so long that they would have more than ``LETTERS`` code points, but one
    at least. Rows that repeat id and text are drawn together, and count once.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("place"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("letters"), F.min("place").alias("first"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    # of the whole range of the hash, the part that should hold the sample, and the language's first row in any case
    upto = {r.lang: max(r.first, -(2**63) + min(2**64 - 1, int(2**64 * min(per_language / r.n, LETTERS / max(1, r.letters))))) for r in sizes}
    drawn = rows.where(F.col("place") <= F.element_at(F.create_map(*[F.lit(v) for k, x in upto.items() for v in (k, x)]), F.col("lang")))
    picked = drawn.dropDuplicates(["lang", "place"]).select("lang", "text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(8)).alias("part")).toPandas()
    picked = picked.sort_values(["lang", "text"]).to_numpy()
    fit, held = {}, {}
    for lang, text, part in picked:
        (held if part == 0 else fit).setdefault(lang, []).append(letters(text))
    for lang in held.keys() - fit.keys():
        fit[lang] = held[lang]
    model = LanguageModel(fit, order)
    model.calibrate({x: held.get(x) or fit[x] for x in fit})
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (the language's posterior, 0 to 1), entropy (nats per
    character), rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is all if there is no model. Each row is
    judged by itself: repeated rows and ids, null ids and columns of any other name make no difference, and an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            lang, score, entropy, rejected = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.full(b.num_rows, np.nan), np.ones(b.num_rows, bool)
            if m is not None:
                for s in range(0, b.num_rows, 256):
                    part = [letters(x) if x is not None else np.zeros(1, np.uint32) for x in b.column(1).slice(s, 256).to_pylist()]
                    rows = [i for i, c in enumerate(part) if c.any()]
                    if not rows:
                        continue
                    e, n = m.entropies([part[i] for i in rows])
                    best = e.argmin(1)
                    low = e[np.arange(len(e)), best]
                    posterior = 1 / np.exp(-(e - low[:, None]) * n[:, None]).sum(1)
                    for i, j, p, x, k in zip(rows, best.tolist(), posterior.tolist(), low.tolist(), n.tolist()):
                        lang[s + i], score[s + i], entropy[s + i], rejected[s + i] = m.languages[j], p, x, not m.accepts(m.languages[j], x, k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], ["id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, lang_pred string, score double, entropy double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; all other columns pass through, whatever their names.

    Rows whose text is null or without a letter go. Without a model nothing is known of any language, and only those go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        m = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for s in range(0, b.num_rows, 256):
                part = [letters(x) if x is not None else np.zeros(1, np.uint32) for x in b.column(at).slice(s, 256).to_pylist()]
                rows = [i for i, c in enumerate(part) if c.any()]
                if m is None or not rows:
                    keep[[s + i for i in rows]] = True
                    continue
                e, n = m.entropies([part[i] for i in rows])
                best = e.argmin(1)
                for i, j, x, k in zip(rows, best.tolist(), e[np.arange(len(e)), best].tolist(), n.tolist()):
                    keep[s + i] = m.accepts(m.languages[j], x, k)
            yield b.filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, docs.schema)


def fit_and_identify(docs: DataFrame, **names) -> DataFrame:
    """``identify`` with a model of the rows whose id leaves another remainder than 2 modulo 4 (a null id: not learned).

    Null, empty and repeated texts, empty tables and clashing names are treated as ``train`` and ``identify`` say.
    """
    return identify(docs, train(docs, remainder_of_id(4) != 2, **names))
