"""Reads: range and point scans, byte budgets, visibility, and offsets by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..schema import ERRORS, RECORD_OVERHEAD
from .log import KEYS


def scan(log: DataFrame, first: int, before: int | None = None) -> DataFrame:
    """Records from offset ``first`` on, up to but not including ``before``; both bounds reach a Parquet scan."""
    rows = log.where(F.col("offset") >= first)
    return rows if before is None else rows.where(F.col("offset") < before)


def budget_prefix(rows: DataFrame, max_bytes: Column, keys: list[str]) -> DataFrame:
    """The first record of each group and those after it whose sizes, all before included, fit ``max_bytes``; none if that is <= 0."""
    window = W.Window.partitionBy(*keys).orderBy("offset").rowsBetween(W.Window.unboundedPreceding, 0)
    sums = rows.withColumns({"__bytes": F.sum("encoded_size").over(window), "__n": F.count(F.lit(1)).over(window)})
    return sums.where((max_bytes > 0) & ((F.col("__n") == 1) | (F.col("__bytes") <= max_bytes))).drop("__bytes", "__n")


def fetch_each(log: DataFrame, first: int, max_bytes: int, high_watermark: DataFrame | None = None) -> DataFrame:
    """A fetch at the same offset and budget from every partition; ``high_watermark`` (topic, partition, hw) bounds what is visible.

    A record has 33 bytes at least, so no more than max_bytes / 33 + 1 offsets are read: a bound that the scan gets.
    The budget is spent before the visibility cut, as a broker reads first and cuts then.
    """
    rows = scan(log, first, first + max(0, max_bytes) // RECORD_OVERHEAD + 1)
    found = budget_prefix(rows, F.lit(max_bytes), KEYS)
    if high_watermark is None:
        return found
    return found.join(high_watermark.select(*KEYS, "hw"), KEYS).where("offset < hw").drop("hw")


def fetch(requests: DataFrame, log: DataFrame, partitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A multi-partition fetch: (responses, records).

    ``requests`` (topic, partition, fetch_offset, max_bytes) is as small as a request, ``partitions`` has a row for each
    existing one (topic, partition, log_start, hw). Responses carry error_code: 4 for a topic or partition that does not exist, 2 below
    the log start, else 0, also at and beyond the high watermark, where there are no records.
    """
    known = requests.join(partitions.select(*KEYS, "log_start", "hw"), KEYS, "left")
    code = F.when(F.col("hw").isNull(), ERRORS["unknown_topic_or_partition"]).when((F.col("fetch_offset") < F.col("hw")) & (F.col("fetch_offset") < F.col("log_start")), ERRORS["offset_out_of_range"]).otherwise(0)
    answered = known.withColumn("error_code", code.cast("int"))
    open_ = answered.where("error_code = 0 and fetch_offset < hw and max_bytes > 0").select(*KEYS, "fetch_offset", "max_bytes", "hw")
    rows = _wanted(requests, log).join(open_, KEYS).where((F.col("offset") >= F.col("fetch_offset")) & (F.col("offset") < F.col("fetch_offset") + F.floor(F.col("max_bytes") / RECORD_OVERHEAD) + 1))
    found = budget_prefix(rows, F.col("max_bytes"), [*KEYS, "fetch_offset"]).where("offset < hw").drop("max_bytes", "hw")
    return answered, found


def _wanted(requests: DataFrame, log: DataFrame) -> DataFrame:
    """``log`` between the least offset that the few ``requests`` name and the greatest that their budgets reach: bounds that the scan gets."""
    reach = F.col("fetch_offset") + F.floor(F.greatest(F.col("max_bytes"), F.lit(0)) / RECORD_OVERHEAD) + 1
    first, last = requests.agg(F.min("fetch_offset"), F.max(reach)).first()
    return scan(log, first or 0, last or 0)


def replica_fetch(requests: DataFrame, log: DataFrame, partitions: DataFrame, local_id: int, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """What followers get from broker ``local_id``: (responses, records).

    ``requests`` (topic, partition, replica_id, fetch_offset), ``partitions`` (topic, partition, leader, leo). Responses carry error_code: 4 for
    what does not exist, 5 where another broker leads, else 0; and follower_leo: behind the last record they give, or the wanted offset.
    Records come up to the end of the log, whatever is visible to consumers. A budget of 0 or less is one MiB.
    """
    budget = max_bytes if max_bytes > 0 else 1 << 20
    known = requests.join(partitions.select(*KEYS, "leader", "leo"), KEYS, "left")
    code = F.when(F.col("leader").isNull(), ERRORS["unknown_topic_or_partition"]).when(F.col("leader") != local_id, ERRORS["not_leader_for_partition"]).otherwise(0)
    answered = known.select(*requests.columns, "leo", code.cast("int").alias("error_code"))
    open_ = answered.where("error_code = 0").select(*KEYS, "replica_id", "fetch_offset")
    rows = _wanted(requests.withColumn("max_bytes", F.lit(budget)), log).join(open_, KEYS).where("offset >= fetch_offset")
    found = budget_prefix(rows, F.lit(budget), [*KEYS, "replica_id", "fetch_offset"])
    ends = found.groupBy(*KEYS, "replica_id", "fetch_offset").agg((F.max("offset") + 1).alias("__end"))
    joined = answered.join(ends, [*KEYS, "replica_id", "fetch_offset"], "left")
    return joined.select(*requests.columns, "error_code", F.when(F.col("error_code") == 0, F.coalesce("__end", "fetch_offset")).alias("follower_leo")), found


def after_replica_fetch(responses: DataFrame, replicas: DataFrame, partitions: DataFrame) -> DataFrame:
    """What the leader knows after ``replica_fetch``: ``replicas`` (topic, partition, broker_id, leo) with the ends that the followers
    reached and the leader's own; an end never falls."""
    reached = responses.where("error_code = 0").select(*KEYS, F.col("replica_id").alias("broker_id"), F.col("follower_leo").alias("leo"))
    own = partitions.select(*KEYS, F.col("leader").alias("broker_id"), "leo")
    return replicas.select(*KEYS, "broker_id", "leo").unionByName(reached).unionByName(own).groupBy(*KEYS, "broker_id").agg(F.max("leo").alias("leo"))


def point_read(targets: DataFrame, log: DataFrame, columns: list[str]) -> DataFrame:
    """``targets`` (topic, partition, target) with ``columns`` of the record at that offset, and found."""
    hit = log.join(targets, KEYS).where("offset = target").select(*KEYS, "target", *columns, F.lit(True).alias("__hit"))
    return targets.join(hit, [*KEYS, "target"], "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def list_offsets(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """``requests`` (topic, partition, timestamp) with offset and error_code: -2 is the start, anything else the end; unknown: -1 and 4."""
    rows = requests.join(partitions.select(*KEYS, "log_start", "leo"), KEYS, "left")
    offset = F.when(F.col("leo").isNull(), -1).when(F.col("timestamp") == -2, F.col("log_start")).otherwise(F.col("leo"))
    code = F.when(F.col("leo").isNull(), ERRORS["unknown_topic_or_partition"]).otherwise(0)
    return rows.select(*requests.columns, offset.cast("long").alias("offset"), code.cast("int").alias("error_code"))


def offset_for_timestamp(requests: DataFrame, log: DataFrame, partitions: DataFrame) -> DataFrame:
    """Extension: the first offset whose timestamp is at or after the wanted one, or the end."""
    # as-of from above: the least offset among the timestamps from the wanted one on, in one ordered stream of both sides
    left = requests.select(*KEYS, F.col("timestamp").cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__offset"), F.struct(*requests.columns).alias("__row"))
    right = log.groupBy(*KEYS, F.col("timestamp").cast("long").alias("__at")).agg(F.min("offset").cast("long").alias("__offset"))
    right = right.select(*KEYS, "__at", F.lit(0).alias("__side"), "__offset", F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    after = W.Window.partitionBy(*KEYS).orderBy(F.col("__at").desc(), "__side").rowsBetween(W.Window.unboundedPreceding, 0)
    hits = left.union(right).withColumn("hit", F.min("__offset").over(after)).where("__side = 1").select("__row.*", "hit")
    rows = hits.join(partitions.select(*KEYS, "leo"), KEYS, "left")
    return rows.select(*requests.columns, F.coalesce("hit", "leo", F.lit(-1)).cast("long").alias("offset"))


def messages(records: DataFrame) -> DataFrame:
    """The client's view of records: without attributes."""
    return records.select("topic", "partition", "offset", "timestamp", "key", "value")


def poll(assigned: DataFrame, log: DataFrame, partitions: DataFrame, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """One poll of a group's member: (records, assigned with the advanced position).

    ``assigned`` (topic, partition, position): a position below 0 reads from 0. Partitions that answer with an error give no
    records and keep their position; the others move behind the last record they gave.
    """
    asked = assigned.select(*KEYS, F.greatest("position", F.lit(0)).cast("long").alias("fetch_offset"), F.lit(max_bytes).alias("max_bytes"))
    answers, found = fetch(asked, log, partitions)
    moved = found.groupBy(*KEYS).agg((F.max("offset") + 1).alias("__next"))
    after = assigned.join(moved, KEYS, "left").select(*assigned.columns, F.coalesce("__next", "position").cast("long").alias("next_position"))
    return found, after.join(answers.select(*KEYS, "error_code"), KEYS)
