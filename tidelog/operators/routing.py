"""Which partition a record goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import murmur2
from .prefix import numbered


def partition_of_key(key: Column, partitions: int) -> Column:
    """murmur2 modulo the number of partitions, for keyed rows; 0 if there is no partition."""
    if partitions <= 0:
        return F.lit(0)
    return (murmur2(key) % partitions).cast("int")


def route(records: DataFrame, partitions: int, order: list[str], topic: str = "topic", key: str = "key", bucket: Column | None = None) -> DataFrame:
    """``records`` with ``partition``: keyed rows by hash, rows with a null or empty key in turn.

    The turn counts the keyless rows of a topic in ``order``; keyed rows do not advance it. With ``bucket``, a column that never
    falls along the order, the counting is split over tasks.
    """
    if partitions <= 0:
        return records.withColumn("partition", F.lit(0))
    keyed = F.coalesce(F.octet_length(key), F.lit(0)) > 0
    rows = numbered(records.withColumn("__keyed", keyed), [topic, "__keyed"], order, "__turn", bucket)
    return rows.withColumn("partition", F.when(F.col("__keyed"), partition_of_key(F.col(key).cast("binary"), partitions)).otherwise((F.col("__turn") % partitions).cast("int"))).drop("__turn", "__keyed")


