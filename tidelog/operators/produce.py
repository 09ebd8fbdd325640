"""Writes: client defaults, batching, and appending to a stored log."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .catalog import validate_produce
from .log import KEYS, assign_offsets, with_sizes
from .prefix import running


def with_timestamps(records: DataFrame, now_ms: Column) -> DataFrame:
    """Records without a positive timestamp get ``now_ms``."""
    return records.withColumn("timestamp", F.when(F.col("timestamp") > 0, F.col("timestamp")).otherwise(now_ms))


def client_offsets(records: DataFrame, base: Column, position: Column) -> DataFrame:
    """What a producer tells its caller: base offset plus the place in the batch."""
    return records.withColumn("offset", base + position)


def batch_boundaries(records: DataFrame, batch_bytes: int, linger_ms: int, order: list[str], size: str = "encoded_size", clock: str = "timestamp") -> DataFrame:
    """topic, partition, the ``order`` columns, size -> batch (from 0 in each partition) and flush: size, linger or close.

    A batch opens with its first record. It is flushed with the record that brings it to ``batch_bytes``, or once
    ``linger_ms`` have passed since it opened, before a later record; what is open at the end is closed. Each partition
    is an ordered stream that passes through one task in batches.
    """

    def run(batches):
        here, number, held, opened, pending = None, 0, 0, 0, []

        def flush(reason):
            nonlocal number, held, pending
            out = [(*row, number, reason) for row in pending]
            number, held, pending = number + 1, 0, []
            return out

        for b in batches:
            done = []
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                n, now = row[-2], row[-1]
                if here != row[:2]:
                    done += flush("close")
                    here, number = row[:2], 0
                elif pending and now - opened >= linger_ms:
                    done += flush("linger")
                if not pending:
                    opened = now
                pending.append(row[:-1])
                held += n
                if held >= batch_bytes:
                    done += flush("size")
            yield from encoded(done)
        yield from encoded(flush("close"))

    def encoded(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=pa.schema(list(zip(names, types))))

    picked = records.select(*KEYS, *order, size, F.col(clock).cast("long").alias("__clock"))
    names = [*KEYS, *order, size, "batch", "flush"]
    types = [to_arrow_type(picked.schema[n].dataType) for n in names[:-2]] + [pa.int64(), pa.string()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + ", batch long, flush string"
    return picked.repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInArrow(run, schema)


def batch_fill(batches: DataFrame, batch_bytes: int, size: str = "encoded_size") -> DataFrame:
    """topic, partition, batch, records, bytes, fill: the bytes as a share of ``batch_bytes``, which can exceed 1."""
    found = batches.groupBy(*KEYS, "batch").agg(F.count("*").alias("records"), F.sum(size).cast("long").alias("bytes"))
    return found.withColumn("fill", F.col("bytes") / batch_bytes)


def mean_fill(filled: DataFrame) -> DataFrame:
    """mean_fill over ``batch_fill``'s rows, and their number; 0 if there are none."""
    return filled.agg(F.coalesce(F.avg("fill"), F.lit(0.0)).alias("mean_fill"), F.count("*").alias("batches"))


def produce(requests: DataFrame, records: DataFrame, topics: DataFrame, partitions: DataFrame, local_id: int, order: list, now_ms: Column, **limits) -> tuple[DataFrame, DataFrame]:
    """Produce requests as a broker serves them: (responses, appended records).

    ``requests`` (id, topic, partition, acks, set_bytes, decodable), ``records`` (id, place, ...) the contents of their record sets, ``partitions``
    (topic, partition, leader, isr, leo). Requests go through ``validate_produce`` (``limits`` are its own) one by one in ``order``; what
    passes is appended. A response has error_code, base_offset (the first record's, 0 if there is none) and log_append_time (0 if nothing
    was appended); records get offset = base_offset + place.
    """
    coded = validate_produce(requests, topics, partitions, local_id, **limits)
    sizes = records.groupBy("id").agg(F.count("*").alias("__n"))
    accepted = coded.join(sizes, "id", "left").withColumn("__n", F.when(F.col("error_code") == 0, F.coalesce("__n", F.lit(0))).otherwise(0))
    placed = running(accepted, KEYS, order, {"__before": (F.col("__n"), False)}).join(partitions.select(*KEYS, F.col("leo").alias("__leo")), KEYS, "left")
    base = F.when(F.col("__n") > 0, F.coalesce("__leo", F.lit(0)) + F.col("__before")).otherwise(0).cast("long")
    answers = placed.select(*requests.columns, "error_code", base.alias("base_offset"), F.when(F.col("__n") > 0, now_ms).otherwise(0).cast("long").alias("log_append_time"))
    taken = answers.where("error_code = 0").select("id", *KEYS, "base_offset")
    return answers, records.join(taken, "id").withColumn("offset", F.col("base_offset") + F.col("place")).drop("base_offset")


class StoredLog:
    """A log in Parquet files by append, topic and partition, sorted by offset, so that offset filters skip row groups.

    One writer at a time, as a broker has one for each partition. Append k writes its records to ``append=k``, and then, by one
    rename, a small table of all partitions' ends to ``_ends/k-batch``: with that it has happened. So an append reads no stored
    records, whatever the log's size; what one left that was cut off before the rename is not read, and the next overwrites it.
    ``batch_id`` makes an append idempotent: a batch that has been stored is not stored again.
    """

    _SCHEMA = "offset long, timestamp long, attributes tinyint, key binary, value binary, encoded_size int, batch_id long, append int, topic string, partition int"
    _ENDS = "topic string, partition int, log_start long, leo long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _appends(self) -> list[str]:
        """The names of the appends that have happened, in order: number-batch, or number- without a batch."""
        system, p = self._hadoop(f"{self.path}/_ends")
        if not system.exists(p):
            return []
        names = [x.getPath().getName() for x in system.listStatus(p)]
        return sorted((n for n in names if not n.startswith(("_", "."))), key=lambda n: int(n.partition("-")[0]))

    def _ends_of(self, appends: list[str]) -> DataFrame:
        if not appends:
            return self.spark.createDataFrame([], self._ENDS)
        return self.spark.read.schema(self._ENDS).parquet(f"{self.path}/_ends/{appends[-1]}")

    def read(self) -> DataFrame:
        appends = self._appends()
        if not appends:
            return self.spark.createDataFrame([], self._SCHEMA).drop("append")
        return self.spark.read.schema(self._SCHEMA).parquet(self.path).where(F.col("append") < len(appends)).drop("append")

    def ends(self) -> DataFrame:
        """topic, partition, log_start, leo."""
        return self._ends_of(self._appends())

    def append(self, records: DataFrame, order: list, batch_id: int | None = None) -> None:
        """``records`` (topic, partition, timestamp, attributes, key, value and the ``order`` columns)."""
        appends = self._appends()
        if batch_id is not None and any(n.partition("-")[2] == str(batch_id) for n in appends):
            return
        ends, here = self._ends_of(appends), f"{self.path}/append={len(appends)}"
        rows = with_sizes(assign_offsets(records, order, ends))
        rows = rows.withColumns({"batch_id": F.lit(batch_id).cast("long"), "attributes": F.col("attributes").cast("tinyint")})
        names = [x.strip().split()[0] for x in self._SCHEMA.split(",")]
        names.remove("append")
        rows.select(*names).repartition(*KEYS).sortWithinPartitions(*KEYS, "offset").write.mode("overwrite").partitionBy(*KEYS).parquet(here)
        new = self.spark.read.schema(", ".join(x for x in self._SCHEMA.split(", ") if not x.startswith("append "))).parquet(here)
        after = ends.unionByName(new.groupBy(*KEYS).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("leo")))
        done, cut = f"{self.path}/_ends/{len(appends)}-{'' if batch_id is None else batch_id}", f"{self.path}/_ends/.next"
        after.groupBy(*KEYS).agg(F.min("log_start").alias("log_start"), F.max("leo").alias("leo")).coalesce(1).write.mode("overwrite").parquet(cut)
        system, p = self._hadoop(cut)
        if not system.rename(p, self._hadoop(done)[1]):
            raise OSError(f"{cut} could not be renamed to {done}")
