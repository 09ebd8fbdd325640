"""Lines of text as records, and a log on the console."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def line_records(spark: SparkSession, path: str, topic: str, partition: int = 0, streaming: bool = False) -> DataFrame:
    """Each line that is not blank as the value of a record without key; a stream of new files if ``streaming``."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    kept = lines.where(F.trim("value") != "")
    return kept.select(F.lit(topic).alias("topic"), F.lit(partition).alias("partition"), F.lit(0).cast("long").alias("timestamp"), F.lit(0).cast("tinyint").alias("attributes"), F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))


def to_console(stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Prints a stream of records: partition, offset, key and value."""
    shown = stream.select("partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    writer = shown.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
