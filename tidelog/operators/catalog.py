"""Topics, brokers and partition metadata; the checks that creating and producing go through."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.records import static_leader, valid_topic_name
from ..schema import ERRORS

# --- topic metadata as a JSON file: {"topics": {name: {"name", "num_partitions", "replication_factor"}}}


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """TOPICS from a metadata file; a missing file is an empty catalog."""
    schema = "topics map<string, struct<name: string, num_partitions: int, replication_factor: smallint>>"
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return spark.createDataFrame([], "name string, num_partitions int, replication_factor smallint")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode("topics")).select("value.*")


def save_topics(topics: DataFrame, path: str) -> None:
    """Replaces the metadata file at once: a reader sees the old one or the new one. A catalog fits one file."""
    rows = {r["name"]: r.asDict() for r in topics.select("name", "num_partitions", "replication_factor").collect()}
    text = json.dumps({"topics": rows}, indent=2, sort_keys=True)
    if "://" not in path:
        with open(f"{path}.tmp", "w") as f:
            f.write(text)
        os.replace(f"{path}.tmp", path)
        return
    spark = topics.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    # one step that replaces the old file: a rename with overwrite, where the store has one
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(target), overwrite)


# --- replicas and leaders


def distinct_replicas(brokers: Column, local_id: int) -> Column:
    """Broker ids without repeats, in order; the local one if there are none."""
    ids = F.array_distinct(F.coalesce(brokers, F.array().cast("array<int>")))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(local_id)))


def partitions_of(topics: DataFrame) -> DataFrame:
    """A row for each partition of TOPICS; topics without partitions give none."""
    return topics.where("num_partitions > 0").select(F.col("name").alias("topic"), F.explode(F.sequence(F.lit(0), F.col("num_partitions") - 1)).alias("partition"))


def metadata(topics: DataFrame, replicas: Column, in_sync: DataFrame | None = None, leaders: DataFrame | None = None, wanted: list[str] | None = None) -> DataFrame:
    """topic, partition, leader, replicas, isr for each partition.

    Without a row in ``in_sync`` (topic, partition, isr) all replicas count as in sync; without one in ``leaders`` (topic,
    partition, leader) the static leader holds. ``wanted``: None is every topic, an empty list none; an unknown name
    gives one row with error code 4.
    """
    rows = partitions_of(topics).withColumn("replicas", replicas)
    rows = rows.join(in_sync.select("topic", "partition", "isr"), ["topic", "partition"], "left") if in_sync is not None else rows.withColumn("isr", F.lit(None).cast("array<int>"))
    rows = rows.join(leaders.select("topic", "partition", F.col("leader").alias("__leader")), ["topic", "partition"], "left") if leaders is not None else rows.withColumn("__leader", F.lit(None).cast("int"))
    rows = rows.select("topic", "partition", F.coalesce("__leader", static_leader(F.col("replicas"), F.col("partition"))).alias("leader"), "replicas", F.coalesce("isr", "replicas").alias("isr"))
    if wanted is None:
        return rows.withColumn("error_code", F.lit(0))
    asked = topics.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(wanted)], "topic string")
    known = topics.select(F.col("name").alias("topic"), F.lit(0).alias("__known"))
    coded = asked.join(known, "topic", "left").select("topic", F.coalesce("__known", F.lit(ERRORS["unknown_topic_or_partition"])).alias("error_code"))
    return coded.join(rows, "topic", "left").select("topic", "partition", "leader", "replicas", "isr", "error_code")


def without_errors(rows: DataFrame) -> DataFrame:
    """What a client keeps of metadata: topics without an error."""
    return rows.where(F.coalesce(F.col("error_code"), F.lit(0)) == 0)


def partition_counts(rows: DataFrame) -> DataFrame:
    """name and num_partitions of each topic in metadata rows, as an assignor is given them."""
    return rows.groupBy(F.col("topic").alias("name")).agg(F.count("partition").cast("int").alias("num_partitions"))


def by_topic(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """``keys``, topic and partitions: the partitions of each topic (with ``fields``, as structures), ascending, as requests carry them."""
    one = F.struct("partition", *fields) if fields else F.col("partition")
    return rows.groupBy(*keys, "topic").agg(F.sort_array(F.collect_list(one)).alias("partitions"))


def create_topics(requests: DataFrame, topics: DataFrame, order: list) -> DataFrame:
    """``requests`` (name, num_partitions, ...) with error_code: 17 for the name, then 15 for the number, then 14 if it exists.

    Requests are served in ``order``: of valid requests for one new name the first creates it.
    """
    valid = valid_topic_name(F.col("name")) & F.coalesce(F.col("num_partitions") > 0, F.lit(False))
    turn = F.sum(valid.cast("int")).over(W.Window.partitionBy("name").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1))
    known = topics.select("name", F.lit(True).alias("__known")).distinct()
    rows = requests.withColumn("__earlier", F.coalesce(turn, F.lit(0))).join(known, "name", "left")
    code = (
        F.when(~valid_topic_name(F.col("name")), ERRORS["invalid_topic"])
        .when(~valid, ERRORS["invalid_partition_count"])
        .when(F.col("__known") | (F.col("__earlier") > 0), ERRORS["topic_already_exists"])
        .otherwise(0)
    )
    return rows.select(*requests.columns, F.coalesce(code, F.lit(0)).cast("int").alias("error_code"))


def validate_produce(requests: DataFrame, topics: DataFrame, partitions: DataFrame, local_id: int, min_isr: int = 1, max_message_bytes: int = 0, auto_create: bool = False) -> DataFrame:
    """``requests`` (topic, partition, acks, set_bytes, decodable) with error_code: the first check that fails.

    Topic name 17; unknown topic 4 (unless ``auto_create``) or partition 4; not the leader 5; acks -1 with fewer in-sync
    replicas than ``min_isr`` 8; larger than ``max_message_bytes`` (if > 0) 7; undecodable 3; else 0.
    ``partitions`` has leader and isr of each partition.
    """
    known = topics.select(F.col("name").alias("topic"), F.lit(True).alias("__topic")).distinct()
    state = partitions.select("topic", "partition", F.col("leader").alias("__leader"), F.size("isr").alias("__isr"))
    rows = requests.join(known, "topic", "left").join(state, ["topic", "partition"], "left")
    code = F.when(~valid_topic_name(F.col("topic")), ERRORS["invalid_topic"])
    if not auto_create:
        code = code.when(F.col("__topic").isNull(), ERRORS["unknown_topic_or_partition"])
    code = (
        code.when(F.col("__topic").isNotNull() & F.col("__leader").isNull(), ERRORS["unknown_topic_or_partition"])
        .when(F.col("__leader") != local_id, ERRORS["not_leader_for_partition"])
        .when((F.col("acks") == -1) & (F.col("__isr") < min_isr), ERRORS["not_enough_replicas"])
        .when(F.lit(max_message_bytes > 0) & (F.col("set_bytes") > max_message_bytes), ERRORS["message_too_large"])
        .when(~F.col("decodable"), ERRORS["corrupt_message"])
        .otherwise(0)
    )
    return rows.select(*requests.columns, code.cast("int").alias("error_code"))
