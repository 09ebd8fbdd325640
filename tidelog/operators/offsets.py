"""Committed offsets of consumer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import big_endian, from_big_endian
from ..functions.records import offsets_partition
from ..schema import ERRORS

KEYS = ["group_id", "topic", "partition"]


def last_commits(commits: DataFrame, position: Column | str = "commit_pos") -> DataFrame:
    """Last write wins: the offset of each key at its greatest log position. The key is three columns, so no two keys collide."""
    return commits.groupBy(*KEYS).agg(F.max_by("offset", F.struct(position) if isinstance(position, str) else position).alias("offset"))


def commit(committed: DataFrame, commits: DataFrame, position: str = "commit_pos") -> DataFrame:
    """``committed`` (one row for each key) after more ``commits``; any offset is accepted, as the log accepts any."""
    old = committed.select(*KEYS, "offset", F.lit(None).cast("long").alias("__at"))
    new = commits.select(*KEYS, "offset", F.col(position).cast("long").alias("__at"))
    return old.union(new).groupBy(*KEYS).agg(F.max_by("offset", F.struct("__at")).alias("offset"))


def as_log_records(commits: DataFrame, partitions: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Commits as records of the offsets log: key group:topic:partition, value the offset in 8 bytes; and the columns to ``keep``."""
    return commits.select(
        *keep,
        F.lit("__consumer_offsets").alias("topic"),
        offsets_partition(F.col("group_id"), partitions).alias("partition"),
        F.concat_ws(":", "group_id", "topic", F.col("partition").cast("string")).cast("binary").alias("key"),
        big_endian(F.col("offset"), 8).alias("value"),
    )


def from_log_records(records: DataFrame) -> DataFrame:
    """(group_id, topic, partition, offset, commit_pos) of offsets-log records. Records with an empty key or a value of less
    than 8 bytes are skipped, as are keys without two colons. A group may hold colons, a topic cannot."""
    rows = records.where((F.octet_length("key") > 0) & (F.octet_length("value") >= 8))
    parts = F.regexp_extract(F.col("key").cast("string"), r"^(.*):([^:]*):([0-9]+)$", 1), F.regexp_extract(F.col("key").cast("string"), r"^(.*):([^:]*):([0-9]+)$", 2), F.regexp_extract(F.col("key").cast("string"), r"^(.*):([^:]*):([0-9]+)$", 3)
    rows = rows.where(F.col("key").cast("string").rlike(r"^.*:[^:]*:[0-9]+$"))
    return rows.select(parts[0].alias("group_id"), parts[1].alias("topic"), parts[2].cast("int").alias("partition"), from_big_endian(F.substring("value", 1, 8)).alias("offset"), F.col("offset").alias("commit_pos"))


def fetch_committed(requests: DataFrame, committed: DataFrame) -> DataFrame:
    """``requests`` (group_id, topic, partition) with the committed offset, or -1."""
    return requests.join(committed.select(*KEYS, F.col("offset").alias("__offset")), KEYS, "left").select(*requests.columns, F.coalesce("__offset", F.lit(-1).cast("long")).alias("offset"))


def resolve_positions(fetched: DataFrame, partitions: DataFrame, policy: Column) -> DataFrame:
    """Where a consumer starts: its committed offset if >= 0, else by ``policy``: the end for latest, none for none (code 2),
    the start for earliest and anything unknown; partitions that do not exist stay at -1 with code 4."""
    rows = fetched.join(partitions.select("topic", "partition", "log_start", "leo"), ["topic", "partition"], "left")
    policy = F.lower(policy)
    position = F.when(F.col("offset") >= 0, F.col("offset")).when(F.col("leo").isNull(), -1).when(policy == "latest", F.col("leo")).when(policy == "none", -1).otherwise(F.col("log_start"))
    code = F.when(F.col("offset") >= 0, 0).when(F.col("leo").isNull(), ERRORS["unknown_topic_or_partition"]).when(policy == "none", ERRORS["offset_out_of_range"]).otherwise(0)
    return rows.select(*fetched.columns, position.cast("long").alias("position"), code.cast("int").alias("error_code"))


def lag(committed: DataFrame, partitions: DataFrame) -> DataFrame:
    """Extension: records between each group's position and the end; a negative offset counts from the start."""
    rows = committed.join(partitions.select("topic", "partition", "log_start", "leo"), ["topic", "partition"])
    return rows.select(*KEYS, (F.col("leo") - F.when(F.col("offset") >= 0, F.col("offset")).otherwise(F.col("log_start"))).cast("long").alias("lag"))
