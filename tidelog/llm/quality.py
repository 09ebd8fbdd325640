"""Quality rules from tokeniser fertility.

A public vocabulary splits a text the better the more it resembles what the vocabulary was made for. For each text this
measures characters per token, the share of byte-fallback tokens and the entropy of its tokens, beside plain counts of
symbols, repeated lines and repeated word windows. Texts are rejected outside bands that are derived for each
language (or script, where the language is null) and each octave of lengths, as all three measures depend on the length, from quartiles
over the whole corpus: three interquartile ranges beyond them, Tukey's limit for far outliers, which a normal distribution
exceeds with one in 400,000 texts.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import materialize
from .pieces import PieceEncoder, read_model, shared

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_M = np.uint64(0x9E3779B97F4A7C15)
#: How many interquartile ranges beyond the quartiles a band reaches.
REACH = 3.0
#: The least range that counts as one: beside what one token more or less changes, so that uniform groups tolerate small differences.
LEAST = {"chars_per_token": 0.02, "byte_share": 0.01, "token_entropy": 0.02}
#: Texts that a group needs for a band.
LEAST_TEXTS = 30
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MEASURES = "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + n]) * _M
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(twice)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = text.translate(None, _SPACE)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated_words(words)


@cache
def _script_of(char: str) -> str:
    return unicodedata.name(char, "OTHER").split(" ")[0]


def script(text: str) -> str:
    """The script of most letters among those that occur in the text; ``NONE`` if it has none."""
    found: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            s = _script_of(c)
            found[s] = found.get(s, 0) + 1
    return max(sorted(found), key=found.get) if found else "NONE"


def measure(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, lang, counts, script, n_tokens, chars_per_token, byte_share, token_entropy in bits) for each row.

    Null texts count as empty ones; where there is no token the ratios are zero. Texts are measured whole, each row by itself, so
    repeated rows and null ids make no difference; only the named columns are read, whatever others are called.
    """
    model = model or read_model()

    def run(batches):
        encoder = shared(PieceEncoder, model)
        for b in batches:
            rows = []
            for x in b.column(2):
                text = x.as_py() or ""
                ids = encoder.encode(text)
                n = len(ids)
                if n:
                    counts = np.bincount(ids)
                    counts = counts[counts > 0] / n
                    ratios = (len(text) / n, float(encoder.is_byte[ids].mean()), float(-(counts * np.log2(counts)).sum()))
                else:
                    ratios = (0.0, 0.0, 0.0)
                rows.append((*base_counts(text.encode()), script(text), n, *ratios))
            columns = list(zip(*rows)) if rows else [()] * 10
            types = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.float64()] * 3
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", "lang", *names])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), text_col).mapInArrow(run, f"id long, lang string, {_BASE}, {_MEASURES}")


def judge(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """``measured`` with base_failed, in_bands and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. A text's group is its language (its script,
    where that is null) with the octave of its number of tokens; it is in the bands if all measures are at most ``reach``
    interquartile ranges of the group beyond its quartiles. Where an octave has fewer than ``LEAST_TEXTS`` texts, characters per
    token and byte share are held against those of the whole language; entropy, which grows with the length, is not judged.
    Languages with fewer texts have no bands, and texts without tokens are in them. Repeated rows count as often as they stand
    there; an empty table gives an empty result.
    """
    group = F.coalesce("lang", F.concat(F.lit("script "), "script"))
    rows = measured.withColumn("__group", group).withColumn("__octave", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"))
    each = rows.where("n_tokens > 0").groupBy("__group", "__octave")
    whole = rows.where("n_tokens > 0").groupBy("__group")
    quartiles = [F.percentile_approx(c, [0.25, 0.75], 1000).alias(f"__{c}") for c in LEAST]
    enough = F.count("*").alias("__texts")
    octaves = each.agg(enough, *quartiles)
    languages = whole.agg(enough, *[q if "token_entropy" not in c else F.lit(None).cast("array<double>").alias(f"__{c}") for c, q in zip(LEAST, quartiles)]).withColumn("__octave", F.lit(-1))
    bands = materialize(octaves.unionByName(languages).where(F.col("__texts") >= LEAST_TEXTS).drop("__texts"), "bands")
    small = bands.count() <= 10_000
    of = lambda cond, tag: bands.where(cond).select("__group", *(["__octave"] if not tag else []), *[F.col(f"__{c}").alias(f"__{c}{tag}") for c in LEAST])
    for table, keys in ((of("__octave >= 0", ""), ["__group", "__octave"]), (of("__octave < 0", "_all"), ["__group"])):
        rows = rows.join(F.broadcast(table) if small else table, keys, "left")
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    step = {"chars_per_token": 1 / n, "byte_share": 1 / n, "token_entropy": F.log2(n + 1) / n}
    within = F.lit(True)
    for c, least in LEAST.items():
        band = F.coalesce(f"__{c}", F.when(F.col("__chars_per_token").isNull(), F.col(f"__{c}_all")))
        low, high = F.element_at(band, 1), F.element_at(band, 2)
        room = F.lit(reach) * F.greatest(high - low, F.lit(least) + step[c])
        within = within & F.coalesce(F.col(c).between(low - room, high + room), F.lit(True))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("n_tokens") == 0) | within
    return rows.select(*measured.columns, failed.alias("base_failed"), fine.alias("in_bands"), (~failed & fine).alias("kept"))


def quality(docs: DataFrame, **names) -> DataFrame:
    """``measure`` and ``judge``; the measures are written once, since the bands need all of them first. Nulls, empty and repeated
    rows, empty tables and clashing names are treated as these say."""
    return judge(materialize(measure(docs, **names), "measures"))
