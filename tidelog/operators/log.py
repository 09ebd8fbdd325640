"""Log geometry: offsets, positions, segments, sparse indexes, retention, truncation and recovery."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.records import encoded_size
from ..schema import INDEX_ENTRY_BYTES, LogConfig
from .prefix import carried, numbered, running

KEYS = ["topic", "partition"]


def assign_offsets(records: DataFrame, order: list, base: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """``records`` with dense offsets in arrival order, from 0 or from ``base`` (topic, partition, leo). A given offset is ignored."""
    rows = numbered(records.drop("offset"), KEYS, order, "offset", bucket)
    if base is None:
        return rows
    start = base.select(*KEYS, F.col("leo").alias("__leo"))
    return rows.join(start, KEYS, "left").withColumn("offset", F.col("offset") + F.coalesce("__leo", F.lit(0))).drop("__leo")


def with_sizes(log: DataFrame) -> DataFrame:
    return log.withColumn("encoded_size", encoded_size(F.col("key"), F.col("value")).cast("int"))


def layout(log: DataFrame, config: LogConfig, clock: str = "timestamp") -> DataFrame:
    """topic, partition, offset, encoded_size -> also segment_base, position, indexed (whether the sparse index has it).

    Before each append a segment is closed if it has ``segment_bytes`` or more, if another index entry would not fit, or
    if it is not empty and ``segment_ms`` old, by the appended records' ``clock``. The first record of a segment is
    indexed, then whenever the bytes since the last entry, the record's own included, reach the interval.

    The rule is greedy: each segment's start depends on the one before. So a partition is one ordered stream; it is sorted by
    Spark (spilling if need be), and passes in batches through a task that keeps five numbers of state.
    """
    limit, interval, entries_limit, max_age = config.segment_bytes, config.index_interval_bytes, config.index_max_bytes // INDEX_ENTRY_BYTES, config.segment_ms

    def run(batches):
        here, base, size, entries, since, born = None, 0, 0, 0, 0, 0
        for b in batches:
            bases, positions, marks = [], [], []
            for topic, partition, offset, n, now in zip(*(b.column(i).to_pylist() for i in range(5))):
                if here != (topic, partition):
                    here, base, size, entries, since, born = (topic, partition), offset, 0, 0, 0, now
                elif size >= limit or entries >= entries_limit or (max_age > 0 and size and now - born >= max_age):
                    base, size, entries, since, born = offset, 0, 0, 0, now
                since += n
                mark = not entries or since >= interval
                if mark:
                    entries += 1
                    since = 0
                bases.append(base)
                positions.append(size)
                marks.append(mark)
                size += n
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bases, pa.int64()), pa.array(positions, pa.int64()), pa.array(marks, pa.bool_())], names)

    names = [*KEYS, "offset", "encoded_size", "segment_base", "position", "indexed"]
    ordered = log.select(*KEYS, "offset", "encoded_size", F.col(clock).cast("long").alias("clock")).repartition(*KEYS).sortWithinPartitions(*KEYS, "offset")
    return ordered.mapInArrow(run, "topic string, partition int, offset long, encoded_size int, segment_base long, position long, indexed boolean")


def segments(laid: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """One row for each segment of ``layout``: base_offset, next_offset, size_bytes, is_active, and created_at_ms if ``clock``
    (topic, partition, offset, timestamp) is given."""
    rows = laid if clock is None else laid.join(clock.select(*KEYS, "offset", "timestamp"), [*KEYS, "offset"])
    more = [] if clock is None else [F.min_by("timestamp", "offset").alias("created_at_ms")]
    found = rows.groupBy(*KEYS, F.col("segment_base").alias("base_offset")).agg((F.max("offset") + 1).alias("next_offset"), F.sum("encoded_size").cast("long").alias("size_bytes"), *more)
    last = W.Window.partitionBy(*KEYS)
    return found.withColumn("is_active", F.col("base_offset") == F.max("base_offset").over(last))


def index_entries(laid: DataFrame) -> DataFrame:
    """The sparse index: base_offset, relative_offset, position."""
    return laid.where("indexed").select(*KEYS, F.col("segment_base").alias("base_offset"), (F.col("offset") - F.col("segment_base")).alias("relative_offset"), "position")


def floor_lookup(targets: DataFrame, entries: DataFrame, keys: list[str], target: str, at: str, values: list[str], default: dict[str, Column] | None = None, width: int | None = None) -> DataFrame:
    """As-of lookup: for each target the ``values`` of the entry with the greatest ``at`` <= ``target``, and ``exact``.

    Both sides are laid into one ordered stream per key, and each target takes the last entry before it: one shuffle,
    no pairs. Without such an entry the values are null, or those of ``default``, and exact is false. With a ``width``
    the stream is cut into ranges of so many values, a task each.
    """
    names = targets.columns
    entry = F.struct(F.col(at).cast("long").alias("at"), *[F.col(v) for v in values])
    left = targets.select(*keys, F.col(target).cast("long").alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in names]).alias("__row"), F.lit(None).cast(entries.select(entry.alias("e")).schema[0].dataType).alias("__entry"))
    right = entries.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), entry.alias("__entry"))
    both = carried(left.union(right), keys, ["__at", "__side"], {"__found": ("last", F.col("__entry"))}, width and F.floor(F.col("__at") / width)).where("__side = 1")
    default = default or {}
    return both.select("__row.*", *[F.coalesce(F.col(f"__found.{v}"), default[v]).alias(v) if v in default else F.col(f"__found.{v}").alias(v) for v in values], F.coalesce(F.col("__found.at") == F.col("__at"), F.lit(False)).alias("exact"))


def index_lookup(targets: DataFrame, entries: DataFrame, target: str = "relative_target") -> DataFrame:
    """``targets`` (topic, partition, base_offset, relative_target) with position and exact; (0, false) if nothing is below."""
    return floor_lookup(targets, entries, [*KEYS, "base_offset"], target, "relative_offset", ["position"], {"position": F.lit(0).cast("long")})


def segment_lookup(targets: DataFrame, found: DataFrame, target: str = "target", width: int | None = None) -> DataFrame:
    """``targets`` (topic, partition, target) with the base_offset of the segment that holds it; null below the first."""
    return floor_lookup(targets, found.select(*KEYS, "base_offset"), KEYS, target, "base_offset", ["base_offset"], width=width).drop("exact")


def bounds(found: DataFrame) -> DataFrame:
    """log_start, leo, segments, size_bytes for each partition of ``segments``."""
    return found.groupBy(*KEYS).agg(F.min("base_offset").alias("log_start"), F.max("next_offset").alias("leo"), F.count("*").alias("segments"), F.sum("size_bytes").alias("size_bytes"))


def counters(laid: DataFrame) -> DataFrame:
    """records, segments, index_entries and bytes of each partition of a ``layout``."""
    return laid.groupBy(*KEYS).agg(
        F.count("*").alias("records"), F.count(F.when(F.col("offset") == F.col("segment_base"), 1)).alias("segments"),
        F.count(F.when(F.col("indexed"), 1)).alias("index_entries"), F.sum("encoded_size").cast("long").alias("bytes"),
    )


def retain_by_bytes(found: DataFrame, limit: Column) -> DataFrame:
    """Segments that stay when the oldest go until ``limit`` bytes are left; the active one always stays; a limit <= 0 keeps all."""
    after = W.Window.partitionBy(*KEYS).orderBy("base_offset").rowsBetween(0, W.Window.unboundedFollowing)
    return found.withColumn("__after", F.sum("size_bytes").over(after)).where((limit <= 0) | F.col("is_active") | (F.col("__after") <= limit)).drop("__after")


def retain_by_time(found: DataFrame, now_ms: Column, retention_ms: int) -> DataFrame:
    """Segments younger than ``retention_ms``, and the active ones; <= 0 keeps all.

    Going from the oldest on, all that are old enough go, wherever they stand.
    """
    return found.where(F.lit(retention_ms <= 0) | F.col("is_active") | (now_ms - F.col("created_at_ms") < retention_ms))


def retain(found: DataFrame, now_ms: Column, retention_ms: int, retention_bytes: int) -> DataFrame:
    """A retention pass: by age, then by bytes."""
    return retain_by_bytes(retain_by_time(found, now_ms, retention_ms), F.lit(retention_bytes))


def truncate(log: DataFrame, offset: int) -> DataFrame:
    """Records before ``offset``; one at or beyond the end of a partition changes nothing there."""
    return log.where(F.col("offset") < offset)


def truncated_ends(ends: DataFrame, offset: int) -> DataFrame:
    """``ends`` (topic, partition, log_start, leo, hw) after truncation: the log is never without a segment."""
    leo = F.least("leo", F.lit(offset).cast("long"))
    return ends.select(*KEYS, F.least("log_start", F.lit(offset).cast("long")).alias("log_start"), leo.alias("leo"), F.least("hw", leo).alias("hw"))


def recover(log: DataFrame, valid: Column, bucket: Column | None = None) -> DataFrame:
    """The prefix of each partition before its first invalid record."""
    return running(log.withColumn("__bad", (~F.coalesce(valid, F.lit(False))).cast("int")), KEYS, ["offset"], {"__sofar": (F.col("__bad"), True)}, bucket).where("__sofar = 0").drop("__bad", "__sofar")
