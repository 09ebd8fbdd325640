"""Replica progress: log ends, in-sync sets, high watermarks, pending acknowledgements and leader epochs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ERRORS
from .prefix import carried, running

KEYS = ["topic", "partition"]


def replica_leo(events: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The greatest log end that each replica has reported."""
    return events.groupBy(*keys, "broker_id").agg(F.max("leo").alias("leo"))


def caught_up(events: DataFrame, leader_id: int, keys: list[str] = KEYS, bucket: Column | None = None) -> DataFrame:
    """Last time each replica's log end was the leader's: events (keys, seq, broker_id, leo, ts).

    Each event is held against the greatest end that the leader has reported until then. ``bucket``, which never falls
    along seq, splits a long history over tasks.
    """
    rows = carried(events, keys, ["seq"], {"__leader": ("max", F.when(F.col("broker_id") == leader_id, F.col("leo")))}, bucket)
    rows = carried(rows, [*keys, "broker_id"], ["seq"], {"__own": ("max", F.col("leo"))}, bucket, events)
    return rows.groupBy(*keys, "broker_id").agg(F.max("leo").alias("leo"), F.max(F.when(F.col("__own") >= F.coalesce("__leader", F.lit(0)), F.col("ts"))).alias("last_caught_up_ms"))


def with_in_sync(replicas: DataFrame, leader_id: int, now_ms: Column, lag_ms: int) -> DataFrame:
    """``replicas`` (keys, broker_id, leo, last_caught_up_ms) with in_sync: the leader, and who caught up within ``lag_ms``."""
    return replicas.withColumn("in_sync", (F.col("broker_id") == leader_id) | F.coalesce(now_ms - F.col("last_caught_up_ms") <= lag_ms, F.lit(False)))


def in_sync_sets(replicas: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """isr: the in-sync broker ids, ascending."""
    return replicas.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("in_sync"), F.col("broker_id")))).alias("isr"))


def high_watermark(replicas: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """hw: the least log end over the in-sync replicas."""
    return replicas.groupBy(*keys).agg(F.min(F.when(F.col("in_sync"), F.col("leo"))).alias("hw"))


def watermark_history(events: DataFrame, brokers: list[int], keys: list[str] = KEYS, bucket: Column | None = None) -> DataFrame:
    """``events`` (keys, seq, broker_id, leo; an end is 0 or more) with hw after each: the least end over all ``brokers``, 0
    before their first report. As an end so far never falls, their least never does.

    ``bucket``, which never falls along seq, splits a long history over tasks.
    """
    names = [f"__end_{b}" for b in brokers]
    rows = carried(events, keys, ["seq"], {n: ("max", F.when(F.col("broker_id") == b, F.col("leo"))) for n, b in zip(names, brokers)}, bucket)
    ends = [F.coalesce(n, F.lit(0).cast("long")) for n in names]
    return rows.withColumn("hw", F.least(*ends) if len(ends) > 1 else ends[0]).drop(*names)


def complete_pending(pending: DataFrame, watermarks: DataFrame, width: int | None = None) -> DataFrame:
    """``pending`` (id, keys, required_hw, deadline_ms) with done_at and error_code: at the first ``watermarks`` (keys, ts, hw;
    hw never falls along ts) that reaches the required one, if before the deadline; else the deadline and 6.

    Nothing is paired: as hw rises with time, the first watermark that suffices is a floor search, done in one
    ordered stream of both sides per partition; with a ``width`` it is cut into ranges of so many offsets, a task each.
    """
    names = pending.columns
    left = pending.select(*KEYS, F.col("required_hw").alias("__hw"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__ts"), F.struct(*names).alias("__row"))
    right = watermarks.select(*KEYS, F.col("hw").alias("__hw"), F.lit(0).alias("__side"), F.col("ts").cast("long").alias("__ts"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    both = left.union(right).withColumn("__below", -F.col("__hw"))
    rows = carried(both, KEYS, ["__below", "__side"], {"__first": ("min", F.col("__ts"))}, width and F.floor(F.col("__below") / width)).where("__side = 1")
    at_once = F.col("__row.required_hw") <= 0
    in_time = F.coalesce(F.col("__first") <= F.col("__row.deadline_ms"), F.lit(False))
    done = F.when(at_once, F.lit(None).cast("long")).when(in_time, F.col("__first")).otherwise(F.col("__row.deadline_ms"))
    return rows.select("__row.*", done.alias("done_at"), F.when(at_once | in_time, 0).otherwise(ERRORS["request_timed_out"]).alias("error_code"))


def follower_watermarks(local: DataFrame, leader: DataFrame) -> DataFrame:
    """A follower's hw: the leader's, as far as its own log reaches. ``local`` (keys, leo), ``leader`` (keys, hw)."""
    return local.join(leader.select(*KEYS, F.col("hw").alias("__hw")), KEYS).select(*KEYS, "leo", F.least("__hw", "leo").alias("hw"))


def epochs(changes: DataFrame) -> DataFrame:
    """The epoch of each partition after its leader ``changes`` (topic, partition, seq, leader): their number, and the last leader."""
    return changes.groupBy(*KEYS).agg(F.count("*").cast("int").alias("epoch"), F.max_by("leader", "seq").alias("leader"))


def fence(requests: DataFrame, current: DataFrame) -> DataFrame:
    """``requests`` (topic, partition, request_epoch) with valid: not behind the current epoch; an unknown partition is valid."""
    return requests.join(current.select(*KEYS, "epoch"), KEYS, "left").withColumn("valid", F.coalesce(F.col("request_epoch") >= F.col("epoch"), F.lit(True))).drop("epoch")


def append_fetched(local: DataFrame, fetched: DataFrame) -> DataFrame:
    """A follower's log with what it fetched: each partition's new records get the offsets after its own end, in order."""
    ends = local.groupBy(*KEYS).agg((F.max("offset") + 1).alias("__leo"))
    rows = running(fetched, KEYS, ["offset"], {"__n": (F.lit(1), False)}).join(ends, KEYS, "left")
    new = rows.withColumn("offset", F.coalesce("__leo", F.lit(0)) + F.col("__n")).select(*local.columns)
    return local.unionByName(new)


class IsrTracker:
    """Replica progress of one partition, updated report by report: the specification of in-sync sets and high watermarks."""

    def __init__(self, brokers: list[int], leader: int, lag_ms: int, born: int, saved: dict | None = None):
        self.leader, self.lag_ms = leader, lag_ms
        saved = saved or {}
        self.replicas: dict[int, list] = {int(k): list(v) for k, v in saved.get("replicas", {b: [0, born, True] for b in brokers}).items()}  # id -> [leo, caught up at, in sync]
        self.hw: int = saved.get("hw", 0)

    def save(self) -> dict:
        return {"replicas": self.replicas, "hw": self.hw}

    def update(self, broker: int, leo: int, leader_leo: int, now: int) -> None:
        me = self.replicas.setdefault(broker, [0, now, True])
        me[0] = max(me[0], leo)
        lead = self.replicas.get(self.leader)
        if me[0] >= max(leader_leo, lead[0] if lead else 0):
            me[1] = now
        for b, r in self.replicas.items():
            r[2] = b == self.leader or now - r[1] <= self.lag_ms
        in_sync = [r[0] for r in self.replicas.values() if r[2]]
        if in_sync:
            self.hw = max(self.hw, min(in_sync))

    def isr(self) -> list[int]:
        return sorted(b for b, r in self.replicas.items() if r[2])


ISR_HISTORY = "topic string, partition int, seq long, hw long, isr string"


def fold_reports(events: DataFrame, brokers: list[int], leader: int, lag_ms: int) -> DataFrame:
    """hw and isr (ids joined by commas) after each report of ``events`` (keys, seq, broker_id, leo, ts), as ``IsrTracker`` has it.

    The tracker is born with a partition's first report. One partition is one ordered stream through a task.
    """

    def run(batches):
        here, tracker = None, None
        for b in batches:
            hw, isr = [], []
            for topic, partition, broker, leo, ts in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if here != (topic, partition):
                    here, tracker = (topic, partition), IsrTracker(brokers, leader, lag_ms, ts)
                tracker.update(broker, leo, 0, ts)
                hw.append(tracker.hw)
                isr.append(",".join(map(str, tracker.isr())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hw, pa.int64()), pa.array(isr, pa.string())], ["topic", "partition", "seq", "hw", "isr"])

    ordered = events.select(*KEYS, "seq", "broker_id", "leo", "ts").repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    return ordered.mapInArrow(run, ISR_HISTORY)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition, hw) of a checkpoint text: lines ``topic partition hw``; of a partition's lines the last counts.

    Lines of another form are skipped. The text is one small file: a line for each partition of a broker.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")))
    parts = lines.select("pos", F.split(F.trim("col"), r"\s+").alias("p")).where("size(p) = 3 and p[1] rlike '^[0-9]+$' and p[2] rlike '^-?[0-9]+$'")
    rows = parts.select(F.get("p", F.lit(0)).alias("topic"), F.get("p", F.lit(1)).cast("int").alias("partition"), F.get("p", F.lit(2)).cast("long").alias("hw"), "pos")
    return rows.groupBy(*KEYS).agg(F.max_by("hw", "pos").alias("hw"))


def update_checkpoint(old: DataFrame, new: DataFrame) -> DataFrame:
    """The checkpoint's rows with those of ``new`` in place of older ones, as lines of its text."""
    rows = old.join(new.select(*KEYS), KEYS, "left_anti").select(*KEYS, "hw").unionByName(new.select(*KEYS, "hw"))
    return rows.select(F.concat_ws(" ", "topic", F.col("partition").cast("string"), F.col("hw").cast("string")).alias("value"))


def broker_addresses(rows: DataFrame, brokers: DataFrame, broker: str = "leader") -> DataFrame:
    """``rows`` with host and port of their broker; null for one that is not configured."""
    return rows.join(brokers.select(F.col("id").alias(broker), "host", "port"), broker, "left").select(*rows.columns, "host", "port")
