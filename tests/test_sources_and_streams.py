import os
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec as C
from tidelog.operators.groups import COMMANDS, fold_commands
from tidelog.operators.produce import StoredLog
from tidelog.operators.replication import complete_pending, fold_reports
from tidelog.sources.record_sets import decode_sets, encode_sets
from tidelog.sources.segments import NAME, floor_position, list_segments, register, write_segments
from tidelog.streaming import pipes, stateful

KEYS = "topic string, partition int, offset long, timestamp long, attributes tinyint, key binary, value binary"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [("t", p, i, i, 0, None if i % 3 else b"k", b"v" * (i % 5)) for p in range(2) for i in range(50)]
    root = str(tmp_path / "log")
    write_segments(spark.createDataFrame(rows, KEYS), root, 500, 100)
    return root, rows


def _plain(rs):
    return sorted((r.topic, r.partition, r.offset, r.timestamp, r.attributes, r.key and bytes(r.key), None if r.value is None else bytes(r.value)) for r in rs)


def test_segments_round_trip(spark, stored):
    root, rows = stored
    assert len(list_segments(root)) > 6
    back = spark.read.format(NAME).load(root)
    assert _plain(back.collect()) == sorted(rows)
    assert back.where("partition = 1 and offset >= 20 and offset < 30").count() == 10
    assert back.where("offset = 7").count() == 2 and back.where("topic = 'none'").count() == 0
    assert back.where("value is null").count() == 0


def test_active_segment_recovers_and_closed_one_fails(spark, stored):
    root, rows = stored
    segs = [s for s in list_segments(root) if s.partition == 0]
    with open(segs[-1].path, "ab") as f:
        f.write(b"torn")
    assert spark.read.format(NAME).load(root).count() == 100
    with open(segs[0].path, "r+b") as f:
        f.seek(25)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="checksum|length"):
        spark.read.format(NAME).load(root).collect()


def test_other_files_are_no_segments(spark, stored):
    root, _ = stored
    for name in ("x.log", "0001.log", "00000000000000000000.tmp"):
        open(os.path.join(root, "t-0", name), "wb").close()
    assert spark.read.format(NAME).load(root).count() == 100


def test_overwrite_and_missing(spark, stored, tmp_path):
    root, rows = stored
    write_segments(spark.createDataFrame(rows[:5], KEYS), root, mode="overwrite")
    assert spark.read.format(NAME).load(root).count() == 5
    register(spark)
    assert spark.read.format(NAME).load(str(tmp_path / "nothing")).count() == 0


def test_index_floor():
    index = b"".join(a.to_bytes(4, "big") + b.to_bytes(4, "big") for a, b in ((0, 0), (3, 30), (7, 70)))
    assert [floor_position(index + bytes(24), x) for x in (0, 2, 3, 6, 9)] == [0, 0, 30, 30, 70]
    assert floor_position(b"", 5) == 0


def test_stream_reads_each_record_once(spark, stored, tmp_path):
    root, rows = stored
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    pipes.keep_rows(spark.readStream.format(NAME).load(root), out, state).awaitTermination()
    more = [("t", 0, i, i, 0, None, b"new") for i in range(50, 60)]
    write_segments(spark.createDataFrame(more, KEYS), root)
    pipes.keep_rows(spark.readStream.format(NAME).load(root), out, state).awaitTermination()
    assert _plain(spark.read.parquet(out).collect()) == sorted(rows + more)


def test_record_sets(spark):
    blobs = [("a", b"".join(C.encode_record(C.Record(i, i, None, b"x")) for i in range(3))), ("b", b""), ("c", None)]
    df = spark.createDataFrame(blobs, "id string, record_set binary")
    assert sorted((r.id, r.place, r.offset) for r in decode_sets(df).collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2)]
    torn = spark.createDataFrame([("a", blobs[0][1][:-2])], df.schema)
    assert decode_sets(torn, lenient=True).count() == 2
    with pytest.raises(Exception, match="left|ShortRead"):
        decode_sets(torn).collect()
    records = spark.createDataFrame([("a", i, C.encode_record(C.Record(i, i, None, b"x"))) for i in (2, 0, 1)], "id string, offset long, record binary")
    assert bytes(encode_sets(records, ["id"]).first().record_set) == blobs[0][1]
    register(spark)
    df.createOrReplaceTempView("sets")
    assert spark.sql("select id, r.offset from sets, lateral decode_record_set(record_set) r").count() == 3


def test_stored_log_appends_once(spark, tmp_path):
    log = StoredLog(spark, str(tmp_path / "stored"))
    new = spark.createDataFrame([("t", p, 5, 0, b"k", b"v", i) for p in (0, 1) for i in range(4)], "topic string, partition int, timestamp long, attributes int, key binary, value binary, n int")
    log.append(new, ["n"], 0)
    log.append(new, ["n"], 0)
    log.append(new, ["n"], 1)
    assert sorted((r.partition, r.log_start, r.leo) for r in log.ends().collect()) == [(0, 0, 8), (1, 0, 8)]
    # an append that was cut off before its ends were renamed has not happened; the next one overwrites what it left
    (tmp_path / "stored/_ends/1-1").rename(tmp_path / "stored/_ends/.next")
    assert log.read().count() == 8 and sorted((r.partition, r.leo) for r in log.ends().collect()) == [(0, 4), (1, 4)]
    log.append(new.where("partition = 0"), ["n"], 2)
    log.append(new.where("n < 0"), ["n"])
    assert sorted((r.partition, r.offset, r.batch_id) for r in log.read().collect()) == sorted([(p, i, 0) for p in (0, 1) for i in range(4)] + [(0, i, 2) for i in range(4, 8)])
    assert sorted((r.partition, r.log_start, r.leo) for r in log.ends().collect()) == [(0, 0, 8), (1, 0, 4)]


def _stream(spark, df, path, parts=3):
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_of_group_commands_equals_fold(spark, tmp_path):
    kinds = ["join", "sync", "heartbeat", "join", "leave", "sweep"]
    rows = [(f"g{i % 2}", i, i * 9000, kinds[(i * 7) % 6], f"m{i % 3}", i % 4, 20_000, "range", {f"m{i % 3}": "x"}) for i in range(60)]
    df = spark.createDataFrame(rows, COMMANDS)
    pipes.keep_rows(stateful.group_states(_stream(spark, df, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, fold_commands(df).collect()))


def test_stream_of_acks_equals_batch(spark, tmp_path):
    schema = "topic string, partition int, ts long, id long, required_hw long, deadline_ms long, hw long"
    rows = [("t", 0, 1, 1, 100, 50, None), ("t", 0, 2, 2, 100, 5, None), ("t", 0, 3, None, None, None, 80), ("t", 0, 9, None, None, None, 100), ("t", 0, 10, 3, 90, 99, None)]
    out = str(tmp_path / "out")
    pipes.keep_rows(stateful.pending_acks(_stream(spark, spark.createDataFrame(rows, schema), str(tmp_path / "in"))), out, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.id, r.done_at, r.error_code) for r in spark.read.parquet(out).collect()) == [(1, 9, 0), (2, 5, 6), (3, 10, 0)]
    assert complete_pending is not None


def test_reports_stream_in_micro_batches_of_a_range_of_seq(spark, tmp_path):
    rows = [("t", p, i, (i * 7 + p) % 3 + 1, i // 3, i * 40) for p in range(3) for i in range(300 * p + 100)]
    df = spark.createDataFrame(rows, "topic string, partition int, seq long, broker_id int, leo long, ts long")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = pipes.in_order(df.repartition(5), "seq", 60, str(tmp_path / "in"))
    pipes.keep_rows(stateful.in_sync_states(stream, [1, 2, 3], 1, 200), out, state).awaitTermination()
    assert len([x for x in os.listdir(f"{state}/commits") if x.isdigit()]) == 12
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, fold_reports(df, [1, 2, 3], 1, 200).collect()))


def test_no_reports_are_an_empty_stream(spark, tmp_path):
    df = spark.createDataFrame([], "topic string, partition int, seq long, broker_id int, leo long, ts long")
    out = str(tmp_path / "out")
    pipes.keep_rows(stateful.in_sync_states(pipes.in_order(df, "seq", 60, str(tmp_path / "in")), [1], 1, 200), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema("hw long").parquet(out).count() == 0


def test_reports_of_a_micro_batch_are_held_as_numbers():
    class Events:
        def groupBy(self, *_):  # noqa: N802
            return self

        def applyInPandasWithState(self, step, *_):  # noqa: N802
            return step

    class State:
        exists, saved = False, None

        def update(self, saved):
            self.saved = saved

    n, size, state = 200_000, 10_000, State()
    step = stateful.in_sync_states(Events(), [1, 2, 3], 1, 1000)
    parts = (pd.DataFrame({"topic": "t", "partition": 0, "seq": range(n - i, n - i - size, -1), "broker_id": 1, "leo": range(n - i, n - i - size, -1), "ts": range(n - i, n - i - size, -1)}) for i in range(0, n, size))
    tracemalloc.start()
    seen, largest = 0, 0
    for frame in step(("t", 0), parts, state):
        assert list(frame.seq) == list(range(seen + 1, seen + len(frame) + 1))
        seen, largest = seen + len(frame), max(largest, len(frame))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and largest <= 10_000 and state.saved and peak < 40e6, (seen, largest, peak)


def test_sessions_expire_with_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    beat = lambda m, s: spark.createDataFrame([("g", m, s)], "group_id string, member_id string, s long").select("group_id", "member_id", F.timestamp_seconds("s").alias("ts"))
    beat("a", 1000).write.parquet(src)
    stream = lambda: stateful.session_expiry(spark.readStream.schema(beat("a", 1).schema).parquet(src).withWatermark("ts", "0 seconds"), 45_000)
    run = lambda: pipes.keep_rows(stream(), out, str(tmp_path / "state")).awaitTermination()
    run()
    beat("b", 1200).write.mode("append").parquet(src)
    run()
    beat("b", 1210).write.mode("append").parquet(src)
    run()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("g", "a", 1_000_000)]
