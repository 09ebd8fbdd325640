"""Running counts, sums, extremes and last values over long ordered groups, in two levels.

A window over (topic, partition) puts a whole partition's history into one task. Where a bucket column is given that never
falls along the order (an hour, a range of offsets), rows are counted inside (keys, bucket), and the buckets' totals,
one row each, are summed up before: so the large window is split over tasks, and the small one has a row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

_ALL = W.Window.unboundedPreceding


def numbered(df: DataFrame, keys: list[str], order: list, name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number in its group, from 0, a long."""
    return running(df, keys, order, {name: (F.lit(1), False)}, bucket)


def running(df: DataFrame, keys: list[str], order: list, sums: dict[str, tuple[Column, bool]], bucket: Column | None = None) -> DataFrame:
    """``df`` with running sums: name -> (value, whether the row's own value is included)."""
    if bucket is None:
        window = W.Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.coalesce(F.sum(v.cast("long")).over(window.rowsBetween(_ALL, 0 if own else -1)), F.lit(0).cast("long")) for n, (v, own) in sums.items()})
    rows = df.withColumns({"__in": _part(keys, bucket), **{f"__v_{n}": v.cast("long") for n, (v, _) in sums.items()}})
    totals = rows.groupBy("__in").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.select("__in", *[F.coalesce(F.sum(f"__t_{n}").over(_before(keys)), F.lit(0)).alias(f"__b_{n}") for n in sums])
    window = W.Window.partitionBy("__in").orderBy(*order)
    parts = rows.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(window.rowsBetween(_ALL, 0 if own else -1)), F.lit(0).cast("long")) for n, (_, own) in sums.items()})
    return parts.join(totals, "__in").withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).select(*df.columns, *sums)


def _part(keys: list[str], bucket: Column) -> Column:
    """(keys, bucket) as one value. It is never null, and equal where its parts are equal or both null: so rows are shuffled by it once, for the
    window and for the join."""
    return F.struct(*keys, bucket.alias("__bucket"))


def _before(keys: list[str]) -> W.WindowSpec:
    """The buckets before one's own."""
    return W.Window.partitionBy(*[F.col(f"__in.{k}") for k in keys]).orderBy("__in.__bucket").rowsBetween(_ALL, -1)


#: How a running value is formed inside a window, from the totals of buckets, and from both.
_FOLDS = {
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "min": (F.min, lambda before, own: F.least(before, own)),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], bucket: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """``df`` with running values, the row's own included: name -> (max, min or last, value); nulls are passed over.

    ``order`` are columns, ascending; rows that are equal in all of them stand in any order. ``source`` has the same rows, for the
    buckets' totals, where ``df`` itself takes more to compute.
    """
    if bucket is None:
        window = W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(_ALL, 0)
        return df.withColumns({n: _FOLDS[kind][0](v).over(window) for n, (kind, v) in values.items()})
    folds = {n: _FOLDS[kind] for n, (kind, _) in values.items()}
    cut = {"__in": _part(keys, bucket), **{f"__v_{n}": v for n, (_, v) in values.items()}}
    at = F.struct(*order)
    totals = (df if source is None else source).withColumns(cut).groupBy("__in").agg(
        *[(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)) if kind == "last" else folds[n][0](F.col(f"__v_{n}"))).alias(f"__t_{n}") for n, (kind, _) in values.items()]
    )
    totals = totals.select("__in", *[f(F.col(f"__t_{n}")).over(_before(keys)).alias(f"__b_{n}") for n, (f, _) in folds.items()])
    window = W.Window.partitionBy("__in").orderBy(*order).rowsBetween(_ALL, 0)
    parts = df.withColumns(cut).withColumns({n: f(F.col(f"__v_{n}")).over(window) for n, (f, _) in folds.items()})
    return parts.join(totals, "__in").withColumns({n: both(F.col(f"__b_{n}"), F.col(n)) for n, (_, both) in folds.items()}).select(*df.columns, *values)
