"""Benchmark statistics: nearest-rank percentiles, throughput and batch fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .prefix import numbered, running


def after_warm_up(samples: DataFrame, keys: list[str], order: list, bucket: Column | None = None) -> DataFrame:
    """Without the first tenth of each group's samples, one at least. ``bucket``, which never falls along ``order``, splits a long group over tasks."""
    totals = samples.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.count("*").alias("__all"))
    rows = numbered(samples, keys, order, "__n", bucket).join(totals, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return rows.where(F.col("__n") >= F.greatest(F.lit(1), F.floor(F.col("__all") / 10))).select(*samples.columns)


def limit_polls(polls: DataFrame, keys: list[str], order: list, seeded: Column, samples: int = 100, attempts: int = 2_000, empty: int = 5) -> DataFrame:
    """The polls (n_messages, in ``order``) that a consumer benchmark makes before it stops, without the empty ones.

    It stops with ``samples`` polls that gave messages, after ``attempts`` of any kind, or with the ``empty``-th empty one in a row since all
    ``seeded`` messages were read. Empty polls before that are passed over. A run is bounded by ``attempts``.
    """
    window = W.Window.partitionBy(*keys).orderBy(*order)
    so_far = window.rowsBetween(W.Window.unboundedPreceding, 0)
    got = F.col("n_messages") > 0
    rows = polls.withColumn("__try", F.row_number().over(window)).where(F.col("__try") <= attempts)
    rows = rows.withColumns({"__hits": F.sum(got.cast("int")).over(so_far), "__read": F.sum("n_messages").over(so_far)})
    # empty polls since the last one that gave messages, once everything was read
    idle = F.sum((~got & (F.col("__read") >= seeded)).cast("int")).over(W.Window.partitionBy(*keys, "__hits").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.withColumn("__idle", idle).withColumn("__over", F.max((F.col("__idle") >= empty).cast("int")).over(so_far))
    return rows.where(got & (F.col("__hits") <= samples) & (F.col("__over") == 0)).drop("__try", "__hits", "__read", "__idle", "__over")


def percentiles(samples: DataFrame, keys: list[str], value: str, wanted: dict[str, int], width: int | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at index floor(n * p / 100), from 0, at most n - 1, and the maximum.

    Equal values are counted first, with map-side combining; ranks run over distinct values, so nothing is collected. With a
    ``width`` the ranks of a group are counted in ranges of so many values, a task each.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.sum("__n").alias("__all"))
    rows = running(counts, keys, [value], {"__upto": (F.col("__n"), True)}, width and F.floor(F.col(value) / width)).join(totals, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    at = [F.min(F.when(F.col("__upto") > F.least(F.floor(F.col("__all") * p / 100), F.col("__all") - 1), F.col(value))).alias(name) for name, p in wanted.items()]
    return rows.groupBy(*keys).agg(*at, F.max(value).alias("max"), F.max("__all").alias("n"))


def throughput(n: Column, duration_ms: Column, payload_bytes: Column) -> tuple[Column, Column]:
    """(messages per second, MiB per second) over a duration of one millisecond at least."""
    per_s = n / (F.greatest(duration_ms, F.lit(1)) / 1000)
    return per_s, payload_bytes / 1048576 / (F.greatest(duration_ms, F.lit(1)) / 1000)


def split_work(n: int, workers: int) -> list[int]:
    """Samples for each worker: the first n mod workers get one more."""
    return [n // workers + (i < n % workers) for i in range(workers)]


def report(samples: DataFrame, keys: list[str], value: str, order: list, duration_ms: str, payload_bytes: str) -> DataFrame:
    """A benchmark's rows: percentiles after warm-up, rates over the whole duration, and the report as JSON.

    As in the benchmark this follows, the rates divide the measured samples by the whole time, warm-up included.
    """
    measured = after_warm_up(samples, keys, order)
    per_s, mib_s = throughput(F.col("n"), F.col("__ms"), F.col("__bytes"))
    sums = samples.groupBy(*keys).agg(F.max(duration_ms).alias("__ms"))
    sizes = measured.groupBy(*keys).agg(F.sum(payload_bytes).alias("__bytes"))
    rows = percentiles(measured, keys, value, {"p50": 50, "p95": 95, "p99": 99}).join(sums, keys).join(sizes, keys)
    rows = rows.withColumns({"msgs_per_s": F.round(per_s, 2), "mib_per_s": F.round(mib_s, 2)}).drop("__ms", "__bytes")
    return rows.withColumn("json", F.to_json(F.struct(*rows.columns)))


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a report; a report has a row for each scenario."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows.collect()])
