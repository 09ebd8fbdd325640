import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import catalog, fetch, groups, log as L, offsets, produce, replication, stats
from tidelog.operators.prefix import carried, numbered, running
from tidelog.operators.routing import route
from tidelog.schema import LogConfig


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def sized(spark, sizes, topic="t", partition=0):
    return spark.createDataFrame([(topic, partition, i, n, 1000 * i) for i, n in enumerate(sizes)], "topic string, partition int, offset long, encoded_size int, timestamp long")


def test_keyless_rows_take_turns(spark):
    df = spark.createDataFrame([("t", None if i % 2 else "", i) for i in range(40)] + [("t", "k", 100 + i) for i in range(5)], "topic string, key string, n int")
    found = route(df, 4, ["n"])
    assert rows(found.where("n < 100").groupBy("partition").count(), "partition") == [(p, 10) for p in range(4)]
    assert found.where("n >= 100").select("partition").distinct().count() == 1
    assert route(df, 0, ["n"]).where("partition <> 0").count() == 0


def test_two_level_counts_equal_one_level(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 3}", i, i % 7) for i in range(200)], "k string, n int, v int")
    plain = running(df, ["k"], ["n"], {"own": (F.col("v"), True), "before": (F.col("v"), False)})
    split = running(df, ["k"], ["n"], {"own": (F.col("v"), True), "before": (F.col("v"), False)}, F.floor(F.col("n") / 13))
    assert rows(plain, "n") == rows(split, "n")
    assert rows(numbered(df, ["k"], ["n"], "i"), "n") == rows(numbered(df, ["k"], ["n"], "i", F.floor(F.col("n") / 50)), "n")


def test_two_level_extremes_equal_one_level(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 3}", i, (i * 37) % 101 if i % 4 else None) for i in range(200)], "k string, n int, v int")
    values = {"up": ("max", F.col("v")), "down": ("min", F.col("v")), "latest": ("last", F.struct("v", "n")), "seen": ("last", F.when(F.col("v") > 50, F.col("v")))}
    plain, split = (rows(carried(df, ["k"], ["n"], values, b), "n") for b in (None, F.floor(F.col("n") / 13)))
    assert plain == split
    want, so_far = [], {}
    for k, n, v in rows(df, "n"):
        now = so_far.setdefault(k, [None, None, None])
        if v is not None:
            now[:2] = max(v, now[0] if now[0] is not None else v), min(v, now[1] if now[1] is not None else v)
            now[2] = v if v > 50 else now[2]
        want.append((k, n, v, now[0], now[1], (v, n), now[2]))
    assert [tuple(r[:5]) + (tuple(r[5]), r[6]) for r in split] == want
    assert rows(carried(df.where("n < 0"), ["k"], ["n"], values, F.floor(F.col("n") / 13))) == []


def test_ranges_do_not_change_lookups(spark):
    """Floor lookups, pending acknowledgements, watermarks and percentiles, cut into ranges or not."""
    targets = spark.createDataFrame([("t", i % 2, i) for i in range(-3, 120)], "topic string, partition int, target long")
    found = spark.createDataFrame([("t", 0, i) for i in (0, 7, 50, 51)] + [("t", 1, 60)], "topic string, partition int, base_offset long")
    assert rows(L.segment_lookup(targets, found), "target") == rows(L.segment_lookup(targets, found, width=16), "target")
    reports = spark.createDataFrame([("t", 0, i, i % 3 + 1, i // 3 + (i * 7) % 5, 1000 * i) for i in range(90)], "topic string, partition int, seq long, broker_id int, leo long, ts long")
    cut = F.floor(F.col("seq") / 8)
    plain, split = (replication.watermark_history(reports, [1, 2, 3], bucket=b) for b in (None, cut))
    assert rows(plain, "seq") == rows(split, "seq")
    assert rows(replication.caught_up(reports, 1), "broker_id") == rows(replication.caught_up(reports, 1, bucket=cut), "broker_id")
    pending = spark.createDataFrame([("t", 0, i, i, 40_000) for i in range(-2, 40)], "topic string, partition int, id long, required_hw long, deadline_ms long")
    marks = plain.select("topic", "partition", "ts", "hw")
    assert rows(replication.complete_pending(pending, marks), "id") == rows(replication.complete_pending(pending, marks, 4), "id")
    samples = spark.createDataFrame([("w" if i % 5 else None, (i * 13) % 40, i) for i in range(200)], "w string, v long, n int")
    assert rows(stats.after_warm_up(samples, ["w"], ["n"]), "n") == rows(stats.after_warm_up(samples, ["w"], ["n"], F.floor(F.col("n") / 9)), "n")
    assert rows(stats.percentiles(samples, ["w"], "v", {"p50": 50, "p99": 99}), "w") == rows(stats.percentiles(samples, ["w"], "v", {"p50": 50, "p99": 99}, 6), "w")


def test_offsets_continue(spark):
    df = spark.createDataFrame([("t", 0, i, 99) for i in range(3)], "topic string, partition int, n int, offset long")
    ends = spark.createDataFrame([("t", 0, 10)], "topic string, partition int, leo long")
    assert [r[3] for r in rows(L.assign_offsets(df, ["n"], ends).select("topic", "partition", "n", "offset"), "n")] == [10, 11, 12]


def test_rotation_and_index(spark):
    laid = L.layout(sized(spark, [41] * 100), LogConfig(segment_bytes=1000, index_interval_bytes=100, segment_ms=0))
    bases = sorted({r.segment_base for r in laid.collect()})
    assert bases == [0, 25, 50, 75]  # 25 records of 41 bytes are the first to reach 1000
    first = rows(L.index_entries(laid).where("base_offset = 0").select("relative_offset", "position"), "position")
    assert first[:3] == [(0, 0), (3, 123), (6, 246)]
    segs = L.segments(laid)
    assert rows(L.bounds(segs).drop("topic", "partition")) == [(0, 100, 4, 4100)]
    assert rows(segs.select("base_offset", "next_offset", "size_bytes", "is_active"), "base_offset")[-1] == (75, 100, 1025, True)


def test_rotation_by_age_and_full_index(spark):
    by_age = L.layout(sized(spark, [41] * 10), LogConfig(segment_ms=3000))
    assert sorted({r.segment_base for r in by_age.collect()}) == [0, 3, 6, 9]
    full = L.layout(sized(spark, [41] * 10), LogConfig(segment_ms=0, index_interval_bytes=1, index_max_bytes=32))
    assert sorted({r.segment_base for r in full.collect()}) == [0, 4, 8]


def test_layout_of_nothing(spark):
    assert L.layout(sized(spark, [1]).where("offset < 0"), LogConfig()).count() == 0


def test_index_floor(spark):
    entries = spark.createDataFrame([("t", 0, 0, i, 10 * (i + 1)) for i in (0, 2, 4)], "topic string, partition int, base_offset long, relative_offset long, position long")
    targets = spark.createDataFrame([("t", 0, 0, i) for i in (-1, 0, 1, 4, 9)] + [("t", 1, 0, 3)], "topic string, partition int, base_offset long, relative_target long")
    got = {(r.partition, r.relative_target): (r.position, r.exact) for r in L.index_lookup(targets, entries).collect()}
    assert got == {(0, -1): (0, False), (0, 0): (10, True), (0, 1): (10, False), (0, 4): (50, True), (0, 9): (50, False), (1, 3): (0, False)}


def test_retention(spark):
    segs = spark.createDataFrame([("t", 0, i * 10, i * 10 + 10, 100, i * 1000, i == 4) for i in range(5)], "topic string, partition int, base_offset long, next_offset long, size_bytes long, created_at_ms long, is_active boolean")
    bases = lambda df: [r.base_offset for r in df.orderBy("base_offset").collect()]
    assert bases(L.retain_by_bytes(segs, F.lit(250))) == [30, 40]
    assert bases(L.retain_by_bytes(segs, F.lit(10))) == [40]
    assert bases(L.retain_by_bytes(segs, F.lit(-1))) == [0, 10, 20, 30, 40]
    assert bases(L.retain_by_time(segs, F.lit(5000), 2500)) == [30, 40]
    assert bases(L.retain_by_time(segs, F.lit(10**9), 1)) == [40]
    assert bases(L.retain(segs, F.lit(5000), 4500, 350)) == [20, 30, 40]


def test_truncate_and_recover(spark):
    log = sized(spark, [41] * 20)
    assert L.truncate(log, 10).count() == 10
    ends = spark.createDataFrame([("t", 0, 0, 20, 15)], "topic string, partition int, log_start long, leo long, hw long")
    assert rows(L.truncated_ends(ends, 10)) == [("t", 0, 0, 10, 10)]
    assert rows(L.truncated_ends(ends, 99)) == [("t", 0, 0, 20, 15)]
    assert L.recover(log, F.col("offset") != 7).count() == 7
    assert L.recover(log, F.lit(None).cast("boolean")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(33, 200), min_size=1, max_size=30), st.integers(0, 900), st.integers(0, 10))
def test_byte_budget_is_a_contiguous_prefix(spark, sizes, budget, first):
    got = [r.offset for r in fetch.fetch_each(sized(spark, sizes), first, budget).orderBy("offset").collect()]
    want, total = [], 0
    for o in range(first, len(sizes)):
        if budget <= 0 or (want and total + sizes[o] > budget):
            break
        want.append(o)
        total += sizes[o]
    assert got == want


def test_budget_runs_on_over_segments(spark):
    """A prefix has no gap where one segment's budget ends and a smaller record begins the next."""
    assert [r.offset for r in fetch.fetch_each(sized(spark, [100, 100, 500, 40, 40]), 0, 300).orderBy("offset").collect()] == [0, 1]


def test_fetch_codes(spark):
    log = sized(spark, [50] * 10)
    parts = spark.createDataFrame([("t", 0, 2, 8)], "topic string, partition int, log_start long, hw long")
    asked = spark.createDataFrame([("t", 0, 2, 10_000), ("t", 0, 1, 10_000), ("t", 0, 8, 10_000), ("t", 0, 3, 0), ("t", 1, 0, 10), ("u", 0, 0, 10)], "topic string, partition int, fetch_offset long, max_bytes long")
    answers, found = fetch.fetch(asked, log, parts)
    codes = {(r.topic, r.partition, r.fetch_offset): r.error_code for r in answers.collect()}
    assert codes == {("t", 0, 2): 0, ("t", 0, 1): 2, ("t", 0, 8): 0, ("t", 0, 3): 0, ("t", 1, 0): 4, ("u", 0, 0): 4}
    assert sorted(r.offset for r in found.collect()) == [2, 3, 4, 5, 6, 7]


def test_list_offsets(spark):
    parts = spark.createDataFrame([("t", 0, 0, 2)], "topic string, partition int, log_start long, leo long")
    asked = spark.createDataFrame([("t", 0, -2), ("t", 0, -1), ("t", 0, 0)], "topic string, partition int, timestamp long")
    assert [r.offset for r in fetch.list_offsets(asked, parts).orderBy("timestamp").collect()] == [0, 2, 2]


def members(spark, names, group="g"):
    return spark.createDataFrame([(group, n) for n in names], "group_id string, member_id string")


def topics(spark, counts):
    return spark.createDataFrame(list(counts.items()), "name string, num_partitions int")


def by_member(df):
    out = {}
    for r in df.orderBy("topic", "partition").collect():
        out.setdefault(r.member_id, []).append(r.partition)
    return out


@pytest.mark.parametrize("strategy, want", [("range", {"consumer-1": [0, 1, 2], "consumer-2": [3, 4]}), ("roundrobin", {"consumer-1": [0, 2, 4], "consumer-2": [1, 3]})])
def test_assignors(spark, strategy, want):
    two = members(spark, ["consumer-2", "consumer-1"])
    assert by_member(groups.assign(strategy, two, topics(spark, {"t": 5}))) == want
    assert {k: len(v) for k, v in by_member(groups.assign(strategy, two, topics(spark, {"t": 4}))).items()} == {"consumer-1": 2, "consumer-2": 2}
    assert groups.assign(strategy, two.where("false"), topics(spark, {"t": 5})).count() == 0
    none = groups.assign(strategy, two, topics(spark, {"t": 0}))
    assert none.count() == 0
    assert [r.topics for r in groups.as_lists(none, two).collect()] == [[], []]


def test_unknown_assignor(spark):
    with pytest.raises(ValueError):
        groups.assign("sticky", members(spark, ["a"]), topics(spark, {"t": 1}))


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 6), min_size=1, max_size=3), st.sampled_from(["range", "roundrobin"]))
def test_assignments_partition_everything(spark, n, counts, strategy):
    found = groups.assign(strategy, members(spark, [f"m{i}" for i in range(n)]), topics(spark, {f"t{i}": c for i, c in enumerate(counts)}))
    pairs = [(r.topic, r.partition) for r in found.collect()]
    assert sorted(pairs) == sorted((f"t{i}", p) for i, c in enumerate(counts) for p in range(c))
    if strategy == "roundrobin" and pairs:
        sizes = [len(v) for v in by_member(found).values()] + [0] * (n - len(by_member(found)))
        assert max(sizes) - min(sizes) <= 1


def test_group_machine():
    m = groups.GroupMachine()
    assert m.apply("heartbeat", 0, "a", 1) == 9
    assert m.apply("join", 0, "a") == 0 and (m.state, m.generation, m.leader) == (groups.PREPARING, 1, "a")
    assert m.apply("join", 0, "b") == 0 and m.generation == 1  # no new generation while preparing
    assert m.apply("heartbeat", 1, "a", 0) == 11 and m.apply("heartbeat", 1, "z", 1) == 9 and m.apply("heartbeat", 1, "a", 1) == 10
    assert m.apply("sync", 1, "b", 1, assignments={"b": "x"}) == 0 and m.state == groups.PREPARING  # not the leader
    assert m.apply("sync", 1, "a", 1, assignments={"a": "x", "ghost": "y"}) == 0 and m.state == groups.STABLE and m.assigned == {"a": "x"}
    assert m.apply("heartbeat", 2, "a", 1) == 0
    again = groups.GroupMachine(m.save())
    assert again.apply("leave", 3, "a") == 0 and (again.state, again.generation, again.leader) == (groups.PREPARING, 2, "b")
    assert again.apply("leave", 3, "a") == 9
    assert again.apply("leave", 3, "b") == 0 and (again.state, again.generation, again.leader) == (groups.EMPTY, 2, None)
    m.apply("sweep", 45_002, None)  # b was last heard at 1, a at 2
    assert list(m.members) == ["a"] and m.generation == 2
    m.apply("sweep", 10**9, None)
    assert m.state == groups.EMPTY and m.generation == 2


def test_invalid_group(spark):
    cmd = spark.createDataFrame([("", 1, 0, "join", "m", None, None, None, None), (None, 2, 0, "join", "m", None, None, None, None)], groups.COMMANDS)
    assert [r.error_code for r in groups.fold_commands(cmd).collect()] == [12, 12]


def test_offsets(spark):
    c = spark.createDataFrame([("g", "t", 0, 5, 1), ("g", "t", 0, 3, 2), ("g:x", "t", 0, 9, 1)], "group_id string, topic string, partition int, offset long, commit_pos long")
    last = offsets.last_commits(c)
    assert rows(last, "group_id") == [("g", "t", 0, 3), ("g:x", "t", 0, 9)]
    asked = spark.createDataFrame([("g", "t", 0), ("h", "t", 0)], "group_id string, topic string, partition int")
    assert [r.offset for r in offsets.fetch_committed(asked, last).orderBy("group_id").collect()] == [3, -1]
    more = spark.createDataFrame([("g", "t", 0, 100, 7)], c.schema)
    assert rows(offsets.commit(last, more), "group_id")[0] == ("g", "t", 0, 100)
    logged = offsets.as_log_records(c).withColumn("offset", F.monotonically_increasing_id())
    bad = spark.createDataFrame([("__consumer_offsets", 0, b"", bytes(8), 0), ("__consumer_offsets", 0, b"g:t:0", b"short", 1), ("__consumer_offsets", 0, b"nocolon", bytes(8), 2)], logged.schema)
    back = offsets.from_log_records(logged.union(bad))
    assert sorted(rows(back.drop("commit_pos"))) == [("g", "t", 0, 3), ("g", "t", 0, 5), ("g:x", "t", 0, 9)]


def test_replication(spark):
    r = spark.createDataFrame([("t", 0, 1, 100, 0), ("t", 0, 2, 80, 0), ("t", 0, 3, 50, 0)], "topic string, partition int, broker_id int, leo long, last_caught_up_ms long")
    assert rows(replication.high_watermark(replication.with_in_sync(r, 1, F.lit(0), 30_000)).select("hw")) == [(50,)]
    assert rows(replication.high_watermark(replication.with_in_sync(r.withColumn("leo", F.when(F.col("broker_id") == 3, 90).otherwise(F.col("leo"))), 1, F.lit(0), 30_000)).select("hw")) == [(80,)]
    assert rows(replication.in_sync_sets(replication.with_in_sync(r, 1, F.lit(150), 100)).select("isr")) == [([1],)]


def test_isr_tracker():
    t = replication.IsrTracker([1, 2, 3], 1, 30_000, 0)
    for b, leo in ((1, 100), (2, 80), (3, 50)):
        t.update(b, leo, 100, 1)
    assert t.hw == 50
    t.update(3, 90, 100, 2)
    assert t.hw == 80
    lagging = replication.IsrTracker([1, 2, 3], 1, 100, 0)
    lagging.update(1, 10, 10, 150)
    assert lagging.isr() == [1] and lagging.hw == 10
    one = replication.IsrTracker([1], 1, 100, 0)
    for leo in np.random.default_rng(0).permutation(np.arange(1, 501)).tolist():
        one.update(1, leo, 0, 1)
    assert one.hw == 500


def test_pending(spark):
    p = spark.createDataFrame([(1, "t", 0, 100, 50), (2, "t", 0, 100, 5), (3, "t", 0, 0, 50), (4, "t", 1, 1, 50)], "id long, topic string, partition int, required_hw long, deadline_ms long")
    hw = spark.createDataFrame([("t", 0, 1, 80), ("t", 0, 9, 100), ("t", 0, 20, 100)], "topic string, partition int, ts long, hw long")
    got = {r.id: (r.done_at, r.error_code) for r in replication.complete_pending(p, hw).collect()}
    assert got == {1: (9, 0), 2: (5, 6), 3: (None, 0), 4: (50, 6)}


def test_epochs(spark):
    ch = spark.createDataFrame([("t", 0, 1, 1), ("t", 0, 2, 3)], "topic string, partition int, seq long, leader int")
    now = replication.epochs(ch)
    assert rows(now) == [("t", 0, 2, 3)]
    asked = spark.createDataFrame([("t", 0, 2), ("t", 0, 1), ("u", 0, 0)], "topic string, partition int, request_epoch int")
    assert {(r.topic, r.request_epoch): r.valid for r in replication.fence(asked, now).collect()} == {("t", 2): True, ("t", 1): False, ("u", 0): True}


def test_follower_append(spark):
    local = spark.createDataFrame([("t", 0, i, b"a") for i in range(3)], "topic string, partition int, offset long, value binary")
    new = spark.createDataFrame([("t", 0, 7, b"b"), ("t", 0, 9, b"c"), ("t", 1, 4, b"d")], local.schema)
    assert [tuple(r)[:3] for r in replication.append_fetched(local, new).orderBy("partition", "offset").collect()][3:] == [("t", 0, 3), ("t", 0, 4), ("t", 1, 0)]


def test_batches(spark):
    got = produce.batch_boundaries(sized(spark, [41] * 8), 64, 5000, ["offset"])
    assert [(r.batch, r.flush) for r in got.orderBy("offset").collect()] == [(i // 2, "size") for i in range(8)]
    slow = produce.batch_boundaries(sized(spark, [41] * 5), 10_000, 2000, ["offset"])
    assert [(r.batch, r.flush) for r in slow.orderBy("offset").collect()] == [(0, "linger"), (0, "linger"), (1, "linger"), (1, "linger"), (2, "close")]
    assert produce.batch_fill(got, 64).agg(F.avg("fill")).first()[0] == 82 / 64


def test_metadata(spark, tmp_path):
    t = spark.createDataFrame([("t", 3, 1), ("z", 0, 1)], "name string, num_partitions int, replication_factor smallint")
    path = str(tmp_path / "meta.json")
    assert catalog.load_topics(spark, path).count() == 0
    catalog.save_topics(t, path)
    assert rows(catalog.load_topics(spark, path), "name") == [("t", 3, 1), ("z", 0, 1)]
    m = catalog.metadata(t, F.array(F.lit(2), F.lit(1)))
    assert [(r.partition, r.leader) for r in m.orderBy("partition").collect()] == [(0, 2), (1, 1), (2, 2)]
    assert catalog.metadata(t, F.array(F.lit(1)), wanted=[]).count() == 0
    assert {(r.topic, r.partition): r.error_code for r in catalog.metadata(t, F.array(F.lit(1)), wanted=["no", "t"]).collect()} == {("no", None): 4, ("t", 0): 0, ("t", 1): 0, ("t", 2): 0}


def test_percentiles(spark):
    df = spark.createDataFrame([("w", v, i) for i, v in enumerate([5, 1, 4, 2, 3, 3, 9])], "w string, v long, n int")
    assert rows(stats.percentiles(df, ["w"], "v", {"p50": 50, "p100": 100})) == [("w", 3, 9, 9, 7)]
    assert stats.after_warm_up(df, ["w"], ["n"]).count() == 6
    assert stats.split_work(10, 4) == [3, 3, 2, 2]


def test_distinct_replicas(spark):
    df = spark.createDataFrame([([3, 1, 3],), ([],), (None,)], "b array<int>")
    assert [r[0] for r in df.select(catalog.distinct_replicas(F.col("b"), 7)).collect()] == [[3, 1], [7], [7]]


def test_checkpoints(spark, tmp_path):
    path = tmp_path / "hw"
    path.write_text("t 0 5\nt 1 7\n\nbad line\nt 0 9\n")
    old = replication.read_checkpoint(spark, str(path))
    assert rows(old, "partition") == [("t", 0, 9), ("t", 1, 7)]
    new = spark.createDataFrame([("t", 1, 8)], "topic string, partition int, hw long")
    assert sorted(r.value for r in replication.update_checkpoint(old, new).collect()) == ["t 0 9", "t 1 8"]
    brokers = spark.createDataFrame([(1, "h", 9)], "id int, host string, port int")
    asked = spark.createDataFrame([(1,), (2,)], "leader int")
    assert rows(replication.broker_addresses(asked, brokers), "leader") == [(1, "h", 9), (2, None, None)]


def test_membership(spark):
    assert rows(groups.membership(members(spark, ["b", "a", "b"]))) == [("g", ["a", "b"])]
    assert spark.range(1).select(groups.member_id(F.lit("c"), F.lit(255))).first()[0] == "c-00000000000000ff"


def test_report(spark):
    df = spark.createDataFrame([("w", 10 * i, i, 2000, 1024) for i in range(20)], "w string, us long, n int, ms long, b long")
    r = stats.report(df, ["w"], "us", ["n"], "ms", "b")
    row = r.first()
    assert (row.n, row.p50, row["max"], row.msgs_per_s) == (18, 110, 190, 9.0) and '"p50":110' in row.json
    assert stats.markdown(r, ["w", "n"]) == "| w | n |\n|---|---|\n| w | 18 |"


def test_timestamps_and_client_offsets(spark):
    df = spark.createDataFrame([(0, 0), (5, 1), (-1, 2)], "timestamp long, place long")
    assert [r.timestamp for r in produce.with_timestamps(df, F.lit(99)).orderBy("place").collect()] == [99, 5, 99]
    assert [r.offset for r in produce.client_offsets(df, F.lit(7), F.col("place")).orderBy("place").collect()] == [7, 8, 9]


def test_lines(spark, tmp_path):
    from tidelog.sources.lines import line_records

    (tmp_path / "in.txt").write_text("a\n\n  \nb\n")
    assert sorted(bytes(r.value) for r in line_records(spark, str(tmp_path / "in.txt"), "t").collect()) == [b"a", b"b"]
