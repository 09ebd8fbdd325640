"""Secret scan with multipart credential linking, in DataFrame expressions only.

Patterns find identifiers, secrets and endpoints. What is a secret on its own (``assign``, ``access``, ``hex``) is always
reported. Weak candidates are reported only if complementary parts stand within ``scope`` code points: an identifier
needs a secret, an opaque string an identifier, an endpoint both. The linking is an interval join inside each text: the
parts of each kind are sorted, and a binary search finds the first that ends after a candidate's scope begins.

Matches are located by lengths: those of the matches and of the pieces between them, summed up by doubling steps. So the work is
n log n in the matches of a text, and linear in its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of each kind, in the order of their reports. The first three are given by contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+"""
WEAK_SECRET = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"
KINDS = ("assign", "access", "hex", "endpoint", "weak_id", "weak_secret")
BASE = KINDS[:3]
#: Code points between parts of one credential, at most.
SCOPE = 200
#: Code points that a text is cut into before it is masked.
_CHUNK = 4_096


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though ``use`` may name it in a lambda for each of many elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _here(value: Column) -> Column:
    """``value``, not to be computed elsewhere: a filter on it is not pushed below the steps it is made of, which would
    write all of them out again at each place they are named."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _scan(values: Column, n: Column, combine) -> Column:
    """Each of ``n`` ``values`` (an array of numbers) combined with all before it: in steps of 1, 2, 4 ... elements."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda back: back < n)
    return F.aggregate(steps, values, lambda done, back: F.transform(done, lambda x, i: F.when(i >= back, combine(x, F.get(done, i - back))).otherwise(x)))


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """``matches`` with their first code point (from 0) and the one after their last."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    ends = _scan(F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, k: k + F.char_length(m)), F.size(matches), lambda x, y: x + y)
    return F.when(F.size(matches) > 0, F.zip_with(matches, ends, lambda m, e: F.struct((e - F.char_length(m)).alias("s"), e.alias("e"), m.alias("m")))).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _near(spans: Column, c: Column, scope: int) -> Column:
    """Whether one of ``spans``, sorted and disjoint, is within ``scope`` of span ``c``."""
    before = F.aggregate(
        F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0),
        lambda n, step: F.when(F.coalesce(F.get(spans, n + step - 1)["e"] <= c["s"] - scope, F.lit(False)), n + step).otherwise(n),
    )
    return F.coalesce(F.get(spans, before)["s"] < c["e"] + scope, F.lit(False))


def _apart(spans: Column, strong: list[Column]) -> Column:
    """``spans`` without those that touch a span of ``strong``."""
    return reduce(lambda left, other: F.filter(left, lambda c: ~_near(other, c, 0)), strong, spans)


def scan(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, prefix: str = "") -> DataFrame:
    """``docs`` with ``{prefix}spans``: array of (start, kind, end), sorted by start and then kind; kind counts ``KINDS``.

    Positions are code points from 0, the end exclusive. A null or empty text has no spans. Every row is judged by
    itself, so repeated rows, null ids and clashing columns make no difference; a column named like the new one is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, ENDPOINT, WEAK_ID, WEAK_SECRET)))
    found = docs.select("*", text.alias("__t"))
    found = found.select("*", *[F.regexp_extract_all("__t", F.lit(p), F.lit(0)).alias(f"__{k}") for k, p in patterns.items()])
    found = found.withColumns({f"__{k}": _located(F.col("__t"), F.col(f"__{k}"), p) for k, p in patterns.items()})
    column = {k: F.col(f"__{k}") for k in KINDS}
    found = found.withColumns({
        "__assign": F.filter(column["assign"], lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6),
        "__weak_secret": F.filter(column["weak_secret"], lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")),
    })
    strong = [column[k] for k in BASE]
    found = found.withColumns({f"__{k}": _apart(column[k], strong) for k in KINDS[3:]})
    identifiers, secrets = (column["access"], column["weak_id"]), (column["assign"], column["hex"], column["weak_secret"])

    def beside(c: Column, parts) -> Column:
        return reduce(lambda a, b: a | b, [_near(p, c, scope) for p in parts])

    found = found.withColumns({
        "__endpoint": F.filter(column["endpoint"], lambda c: beside(c, identifiers) & beside(c, secrets)),
        "__weak_id": F.filter(column["weak_id"], lambda c: beside(c, secrets)),
        "__weak_secret": F.filter(column["weak_secret"], lambda c: beside(c, identifiers)),
    })
    spans = F.sort_array(F.concat(*[F.transform(column[k], _as_span(i)) for i, k in enumerate(KINDS)]))
    return found.withColumn(f"{prefix}spans", _here(spans)).drop("__t", *[f"__{k}" for k in KINDS])


def _as_span(kind: int):
    return lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"))


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def report(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, counts of the base kinds, base_sha256 of their report, and spans: the report of all kinds."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", scope)
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("id", *counts, F.sha2(report(base), 256).alias("base_sha256"), report(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``; overlapping and touching spans become one.

    Texts without spans, and null texts, stay as they are.
    """
    found = scan(docs, text_col, scope, "__")
    spans, text = F.col("__spans"), F.col(text_col)
    found = found.withColumn("__reach", _scan(F.transform(spans, lambda x: x["end"]), F.size(spans), lambda x, y: F.greatest(x, y)))
    # spans that begin beyond all before them
    first = F.filter(F.transform(spans, lambda x, i: F.when((i == 0) | (x["start"] > F.get(F.col("__reach"), i - 1)), i)), lambda i: i.isNotNull())
    found = found.withColumn("__first", first)

    def merged(first: Column) -> Column:
        last = lambda k: F.coalesce(F.get(first, k + 1), F.size(spans)) - 1
        return F.transform(first, lambda i, k: F.struct(F.get(spans, i)["start"].alias("s"), F.get(F.col("__reach"), last(k)).alias("e")))

    found = found.withColumn("__merged", _once(F.col("__first"), merged))
    ends = F.concat(F.array(F.lit(0)), F.transform("__merged", lambda x: x["e"]))
    starts = F.concat(F.transform("__merged", lambda x: x["s"]), F.array(F.char_length(text)))
    kept = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))

    def cut(chunks: Column, x: Column) -> Column:
        def part(k: Column) -> Column:
            begin, end = F.greatest(F.lit(0), x["e"] - k * _CHUNK), F.least(F.lit(_CHUNK), x["s"] - k * _CHUNK)
            return F.substring(F.get(chunks, k), begin + 1, end - begin)

        return F.array_join(F.transform(F.sequence(F.floor(x["e"] / _CHUNK).cast("int"), F.floor(x["s"] / _CHUNK).cast("int")), part), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    masked = _once(chunks, lambda c: F.array_join(F.transform(kept, lambda x: cut(c, x)), mask))
    clean = F.when(F.size("__merged") > 0, masked).otherwise(text)
    return found.withColumn(text_col, _here(clean)).select(*docs.columns)
