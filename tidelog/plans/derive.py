"""Log tables derived from the driver's tables, the same for every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import encoded_size
from ..operators.prefix import numbered
from ..operators.routing import partition_of_key

PARTITIONS = 4
#: Hours are the buckets that long partitions are counted in.
_HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def records(spark: SparkSession, sf_dir: str, topic: Column | None = None) -> DataFrame:
    """Events as records: topic (the event type), key (the user), value (props), ts_ms, and the arrival order (ts, event_id)."""
    events = table(spark, sf_dir, "events")
    return events.select((F.col("event_type") if topic is None else topic).alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), _ms(F.col("ts")).alias("ts_ms"), "ts", "event_id")


def hour() -> Column:
    return F.floor(F.col("ts_ms") / _HOUR_MS)


def log(spark: SparkSession, sf_dir: str, topic: Column | None = None) -> DataFrame:
    """``records`` by key into four partitions, with offsets and sizes."""
    rows = records(spark, sf_dir, topic).withColumn("partition", partition_of_key(F.col("key").cast("binary"), PARTITIONS))
    rows = numbered(rows, ["topic", "partition"], ["ts", "event_id"], "offset", hour())
    return rows.withColumn("encoded_size", encoded_size(F.col("key"), F.col("value")).cast("int"))


def log1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log`` of one topic, ``events``."""
    return log(spark, sf_dir, F.lit("events"))


def ends(rows: DataFrame) -> DataFrame:
    """topic, partition, log_start, leo, and hw ten below the end."""
    return rows.groupBy("topic", "partition").agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("leo")).withColumn("hw", F.col("leo") - 10)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("g"), (F.col("o_custkey") % 5).cast("string")).alias("group_id"),
        F.col("o_orderstatus").alias("topic"),
        (F.col("o_orderkey") % 4).cast("int").alias("partition"),
        F.col("o_orderkey").cast("long").alias("offset"),
        F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key")).alias("commit_pos"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string")).alias("group_id"), F.col("c_mktsegment").alias("member_id")).distinct()


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return events.select("name", (4 + F.char_length("name") % 3).cast("int").alias("num_partitions"), F.lit(1).cast("short").alias("replication_factor"))


def replica_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reports of log ends: topic, partition, seq, broker_id, leo (the broker's running count), ts in ms."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = lines.select(F.lit("t").alias("topic"), (F.col("l_suppkey") % 4).cast("int").alias("partition"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("broker_id"), _ms(F.col("l_shipdate")).alias("ts"), *order)
    day = F.floor(F.col("ts") / (24 * _HOUR_MS))
    rows = numbered(rows, ["topic", "partition"], order, "seq", day)
    rows = numbered(rows, ["topic", "partition", "broker_id"], ["seq"], "leo", day)
    return rows.select("topic", "partition", "seq", "broker_id", (F.col("leo") + 1).alias("leo"), "ts")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 16).cast("int").alias("worker"), F.round(F.col("value") * 100).cast("long").alias("us"), _ms(F.col("ts")).alias("ts_ms"), "ts", "event_id")
