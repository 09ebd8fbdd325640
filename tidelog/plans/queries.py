"""The queries of the log engine, each with its DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.hashing import murmur2
from ..operators import catalog, fetch, groups, log as L, offsets, produce, replication, stats
from ..operators.routing import partition_of_key, route
from ..schema import DAY_MS, LogConfig
from ..sources.record_sets import decode_sets, encode_sets
from ..sources.workspace import stored
from . import derive, oracle
from .oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = ["topic", "partition"]
Q = '"partition"'
O = '"offset"'  # noqa: E741


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return add


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    def one(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# --- routing and records


@query(sql(f'SELECT topic, {Q}, {O}, key, ts_ms FROM log', "log"))
def log_append_offsets(spark, sf):
    return derive.log(spark, sf).select("topic", "partition", "offset", "key", "ts_ms")


@query(sql(f'SELECT key, hash, CAST(hash % 4 AS INTEGER) AS {Q} FROM hashed', "hashed"))
def partition_for_key(spark, sf):
    keys = derive.records(spark, sf).select("key").distinct()
    return keys.select("key", murmur2(F.col("key").cast("binary")).alias("hash"), partition_of_key(F.col("key").cast("binary"), 4).alias("partition"))


@query(sql(f'''SELECT e.event_id, e.event_type AS topic, CAST(CASE WHEN e.value < 50 THEN (row_number() OVER (PARTITION BY e.event_type, e.value < 50 ORDER BY e.ts, e.event_id) - 1) % 4 ELSE h.hash % 4 END AS INTEGER) AS {Q}
FROM events e JOIN hashed h ON h.key = CAST(e.user_id AS VARCHAR)''', "hashed"))  # fmt: skip
def partition_roundrobin(spark, sf):
    events = derive.table(spark, sf, "events")
    rows = events.select("event_id", F.col("event_type").alias("topic"), F.when(F.col("value") >= 50, F.col("user_id").cast("string")).alias("key"), "ts")
    day = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / DAY_MS)
    return route(rows, 4, ["ts", "event_id"], bucket=day).select("event_id", "topic", "partition")


@query("SELECT event_id, CAST(33 + octet_length(encode(CAST(user_id AS VARCHAR))) + octet_length(encode(props)) AS INTEGER) AS encoded_size FROM events")
def record_encoded_size(spark, sf):
    return derive.records(spark, sf).select("event_id", R.encoded_size(F.col("key"), F.col("value")).cast("int").alias("encoded_size"))


_BODY = f"'00' || {oracle.hex_of('octet_length(encode(key))', 4)} || hex(encode(key)) || {oracle.hex_of('octet_length(encode(value))', 4)} || hex(encode(value))"


@query(sql(f"SELECT event_id, lpad(hex({oracle.crc32c('blob')}), 8, '0') AS crc32c FROM (SELECT event_id, unhex({_BODY}) AS blob FROM rec)", "rec"))
def record_crc32c(spark, sf):
    return derive.records(spark, sf).select("event_id", F.lpad(F.hex(R.record_crc32c(F.col("key").cast("binary"), F.col("value").cast("binary"))), 8, "0").alias("crc32c"))


@query(sql(
    f"SELECT {Q}, {O}, {oracle.hex_of('encoded_size - 4', 4)} || {oracle.hex_of(O, 8)} || {oracle.hex_of('ts_ms', 8)} || lpad(hex({oracle.crc32c('blob')}), 8, '0') || body AS record "
    f"FROM (SELECT *, unhex(body) AS blob FROM (SELECT *, {_BODY} AS body FROM log1))", "log1",
))
def record_encode_hex(spark, sf):
    rows = derive.log1(spark, sf)
    return rows.select("partition", "offset", F.hex(_encoded()).alias("record"))


def _encoded():
    return R.encode_record(F.col("offset"), F.col("ts_ms"), F.col("key").cast("binary"), F.col("value").cast("binary"))


@query(f"SELECT group_id, CAST({oracle.fnv1a32('group_id')} % 50 AS INTEGER) AS {Q} FROM (SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS group_id FROM customer)")
def fnv1a_offsets_partition(spark, sf):
    found = derive.table(spark, sf, "customer").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("group_id")).distinct()
    return found.select("group_id", R.offsets_partition(F.col("group_id")).alias("partition"))


@query(sql(f"SELECT topic, {Q}, {O}, ts_ms, key, value FROM log1", "log1"))
def recordset_decode(spark, sf):
    rows = derive.log1(spark, sf).select(*KEYS, "offset", _encoded().alias("record"), F.floor(F.col("offset") / 100).alias("request"))
    sets = encode_sets(rows, [*KEYS, "request"])
    return decode_sets(sets, keys=KEYS).select(*KEYS, "offset", F.col("timestamp").alias("ts_ms"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


# --- fetch


@query(sql(f"SELECT topic, {Q}, {O}, key, value FROM log WHERE {O} >= 100", "log"))
def fetch_range(spark, sf):
    return fetch.scan(derive.log(spark, sf), 100).select(*KEYS, "offset", "key", "value")


_PREFIX = f"""SELECT *, sum(encoded_size) OVER w AS upto, row_number() OVER w AS rn FROM {{0}} WHERE {O} >= {{1}} WINDOW w AS (PARTITION BY topic, {Q} ORDER BY {O} ROWS UNBOUNDED PRECEDING)"""


@query(sql(f"SELECT topic, {Q}, {O}, key, value, ts_ms FROM ({_PREFIX.format('log1', 100)}) WHERE rn = 1 OR upto <= 4096", "log1"))
def fetch_byte_budget(spark, sf):
    return fetch.fetch_each(derive.log1(spark, sf), 100, 4096).select(*KEYS, "offset", "key", "value", "ts_ms")


@query(sql(f"SELECT p.topic, p.{Q}, p.{O} FROM ({_PREFIX.format('log', 50)}) p JOIN ends e ON e.topic = p.topic AND e.{Q} = p.{Q} WHERE (rn = 1 OR upto <= 100000) AND p.{O} < e.hw", "ends"))
def fetch_high_watermark(spark, sf):
    rows = derive.log(spark, sf)
    return fetch.fetch_each(rows, 50, 100_000, derive.ends(rows)).select(*KEYS, "offset")


_REQUESTS = [("purchase", 0, 10, 2000), ("purchase", 9, 0, 2000), ("view", 1, 0, 1), ("view", 2, 10_000_000, 2000), ("click", 3, 5, 0), ("nosuch", 0, 0, 2000), ("error", 2, -1, 2000), ("signup", 1, 20, 1_000_000)]


@query(sql(f"""SELECT r.topic, r.{Q}, CAST(r.fetch_offset AS BIGINT) AS fetch_offset, CAST(CASE WHEN e.hw IS NULL THEN 4 WHEN r.fetch_offset < e.hw AND r.fetch_offset < e.log_start THEN 2 ELSE 0 END AS INTEGER) AS error_code,
  count(p.{O}) AS n_records, CAST(coalesce(sum(p.encoded_size), 0) AS BIGINT) AS n_bytes, max(p.{O}) AS last_offset
FROM r LEFT JOIN ends e ON e.topic = r.topic AND e.{Q} = r.{Q}
LEFT JOIN (SELECT l.*, r.fetch_offset, r.max_bytes, sum(encoded_size) OVER w AS upto, row_number() OVER w AS rn FROM log l JOIN r ON r.topic = l.topic AND r.{Q} = l.{Q} AND l.{O} >= r.fetch_offset
  WINDOW w AS (PARTITION BY l.topic, l.{Q}, r.fetch_offset ORDER BY l.{O} ROWS UNBOUNDED PRECEDING)) p
  ON p.topic = r.topic AND p.{Q} = r.{Q} AND p.fetch_offset = r.fetch_offset AND p.{O} < e.hw AND p.max_bytes > 0 AND (p.rn = 1 OR p.upto <= p.max_bytes) AND r.fetch_offset >= e.log_start
GROUP BY ALL""", "ends", more=f"r(topic, {Q}, fetch_offset, max_bytes) AS (VALUES {_values(_REQUESTS)})"))  # fmt: skip
def fetch_multi_partition(spark, sf):
    rows = derive.log(spark, sf)
    answers, found = fetch.fetch(_local(spark, _REQUESTS, "topic string, partition int, fetch_offset long, max_bytes long"), rows, derive.ends(rows))
    sums = found.groupBy(*KEYS, "fetch_offset").agg(F.count("*").alias("n"), F.sum("encoded_size").cast("long").alias("b"), F.max("offset").alias("last_offset"))
    joined = answers.join(sums, [*KEYS, "fetch_offset"], "left")
    return joined.select(*KEYS, "fetch_offset", "error_code", F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("b", F.lit(0)).alias("n_bytes"), "last_offset")


_TARGETS = [("events", p, t) for p in range(4) for t in (0, 17, 400, 2000, 10_000_000)]


@query(sql(f"SELECT t.topic, t.{Q}, CAST(t.target AS BIGINT) AS target, l.key, l.value, l.key IS NOT NULL AS found FROM t LEFT JOIN log1 l ON l.{Q} = t.{Q} AND l.{O} = t.target", "log1", more=f"t(topic, {Q}, target) AS (VALUES {_values(_TARGETS)})"))
def point_read(spark, sf):
    return fetch.point_read(_local(spark, _TARGETS, "topic string, partition int, target long"), derive.log1(spark, sf), ["key", "value"])


_LIST = [(t, p, ts) for t in ("purchase", "view", "nosuch") for p in (0, 3, 7) for ts in (-1, -2, 0)]


@query(sql(f"SELECT r.topic, r.{Q}, CAST(r.ts AS BIGINT) AS timestamp, CAST(CASE WHEN e.leo IS NULL THEN -1 WHEN r.ts = -2 THEN e.log_start ELSE e.leo END AS BIGINT) AS {O}, CAST(CASE WHEN e.leo IS NULL THEN 4 ELSE 0 END AS INTEGER) AS error_code FROM r LEFT JOIN ends e ON e.topic = r.topic AND e.{Q} = r.{Q}", "ends", more=f"r(topic, {Q}, ts) AS (VALUES {_values(_LIST)})"))
def list_offsets(spark, sf):
    return fetch.list_offsets(_local(spark, _LIST, "topic string, partition int, timestamp long"), derive.ends(derive.log(spark, sf)))


@query(sql(f"SELECT e.topic, e.{Q}, w.ts AS timestamp, coalesce((SELECT min(l.{O}) FROM log l WHERE l.topic = e.topic AND l.{Q} = e.{Q} AND l.ts_ms >= w.ts), e.leo) AS {O} FROM ends e, w", "ends", more="w(ts) AS (VALUES (1704500000000), (1705500000000), (1900000000000))"))
def offset_for_timestamp(spark, sf):
    rows = derive.log(spark, sf)
    ends = derive.ends(rows)
    wanted = ends.select(*KEYS, F.explode(F.array(*[F.lit(x) for x in (1704500000000, 1705500000000, 1900000000000)])).alias("timestamp"))
    return fetch.offset_for_timestamp(wanted, rows.withColumnRenamed("ts_ms", "timestamp"), ends)


_ASSIGNED = [("purchase", 0, -1), ("view", 1, 40), ("click", 2, 10_000_000), ("error", 9, 5), ("nosuch", 0, 0), ("signup", 3, 0)]


@query(sql(f"""SELECT a.topic, a.{Q}, CAST(a.position AS BIGINT) AS position, CAST(coalesce(max(p.{O}) + 1, a.position) AS BIGINT) AS next_position, CAST(CASE WHEN e.hw IS NULL THEN 4 ELSE 0 END AS INTEGER) AS error_code
FROM a LEFT JOIN ends e ON e.topic = a.topic AND e.{Q} = a.{Q}
LEFT JOIN (SELECT l.*, sum(encoded_size) OVER w AS upto, row_number() OVER w AS rn FROM log l JOIN a ON a.topic = l.topic AND a.{Q} = l.{Q} AND l.{O} >= greatest(a.position, 0)
  WINDOW w AS (PARTITION BY l.topic, l.{Q} ORDER BY l.{O} ROWS UNBOUNDED PRECEDING)) p ON p.topic = a.topic AND p.{Q} = a.{Q} AND p.{O} < e.hw AND (p.rn = 1 OR p.upto <= 3000)
GROUP BY a.topic, a.{Q}, a.position, e.hw""", "ends", more=f"a(topic, {Q}, position) AS (VALUES {_values(_ASSIGNED)})"))  # fmt: skip
def group_poll(spark, sf):
    rows = derive.log(spark, sf)
    _, after = fetch.poll(_local(spark, _ASSIGNED, "topic string, partition int, position long"), rows, derive.ends(rows), 3000)
    return after


# --- log geometry

#: Offsets, or sequence numbers, that one task takes of a long ordered stream.
_RANGE = 65_536
_CONFIG = LogConfig(segment_bytes=8192, index_interval_bytes=1024, segment_ms=0)
_WALK = f"""walk AS (SELECT {Q}, {O}, encoded_size, 0::BIGINT AS base, 0::BIGINT AS pos, encoded_size::BIGINT AS size, 0::BIGINT AS since, true AS mark, ts_ms AS born FROM log1 WHERE {O} = 0
UNION ALL
SELECT {Q}, {O}, encoded_size, base, pos, pos + encoded_size, CASE WHEN fresh OR since_now >= 1024 THEN 0 ELSE since_now END, fresh OR since_now >= 1024, born FROM (
  SELECT l.{Q}, l.{O}, l.encoded_size, ROLL AS fresh, CASE WHEN ROLL THEN l.{O} ELSE w.base END AS base, CASE WHEN ROLL THEN 0 ELSE w.size END AS pos, CASE WHEN ROLL THEN 0 ELSE w.since END + l.encoded_size AS since_now,
    CASE WHEN ROLL THEN l.ts_ms ELSE w.born END AS born
  FROM walk w JOIN log1 l ON l.{Q} = w.{Q} AND l.{O} = w.{O} + 1))"""
_BY_BYTES = _WALK.replace("ROLL", "(w.size >= 8192)")
_BY_TIME = _WALK.replace("ROLL", f"(l.ts_ms - w.born >= {DAY_MS})")
_SEGMENTS = f"""segs AS (SELECT *, base_offset = max(base_offset) OVER (PARTITION BY {Q}) AS is_active FROM (SELECT {Q}, base AS base_offset, max({O}) + 1 AS next_offset, CAST(sum(encoded_size) AS BIGINT) AS size_bytes, min(born) AS created_at_ms FROM walk GROUP BY ALL))"""


def _laid(spark, sf, config=_CONFIG):
    return L.layout(derive.log1(spark, sf), config, "ts_ms")


@query(sql(f"SELECT {Q}, {O}, base AS segment_base, pos AS position FROM walk", "log1", recursive=True, more=_BY_BYTES))
def segment_rotation(spark, sf):
    return _laid(spark, sf).select("partition", "offset", "segment_base", "position")


@query(sql(f"SELECT {Q}, {O}, base AS segment_base, pos AS position FROM walk", "log1", recursive=True, more=_BY_TIME))
def segment_rotation_time(spark, sf):
    return _laid(spark, sf, LogConfig(segment_ms=DAY_MS)).select("partition", "offset", "segment_base", "position")


@query(sql(f"SELECT {Q}, base AS base_offset, {O} - base AS relative_offset, pos AS position FROM walk WHERE mark", "log1", recursive=True, more=_BY_BYTES))
def sparse_index(spark, sf):
    return L.index_entries(_laid(spark, sf)).drop("topic")


@query(sql(
    f"SELECT t.{Q}, t.base_offset, t.target AS relative_target, coalesce(i.pos, 0) AS position, coalesce(i.rel = t.target, false) AS exact "
    f"FROM (SELECT {Q}, base AS base_offset, {O} - base AS target FROM walk) t "
    f"ASOF LEFT JOIN (SELECT {Q}, base, {O} - base AS rel, pos FROM walk WHERE mark) i ON i.{Q} = t.{Q} AND i.base = t.base_offset AND t.target >= i.rel",
    "log1", recursive=True, more=_BY_BYTES,
))
def index_floor_lookup(spark, sf):
    laid = stored(_laid(spark, sf), "laid")
    targets = laid.select(*KEYS, F.col("segment_base").alias("base_offset"), (F.col("offset") - F.col("segment_base")).alias("relative_target"))
    return L.index_lookup(targets, L.index_entries(laid)).drop("topic")


@query(sql(f"SELECT t.{Q}, t.target, s.base_offset FROM (SELECT {Q}, {O} AS target FROM walk) t ASOF LEFT JOIN segs s ON s.{Q} = t.{Q} AND t.target >= s.base_offset", "log1", recursive=True, more=f"{_BY_BYTES}, {_SEGMENTS}"))
def segment_floor_lookup(spark, sf):
    laid = stored(_laid(spark, sf), "laid")
    targets = laid.select(*KEYS, F.col("offset").alias("target"))
    return L.segment_lookup(targets, L.segments(laid), width=_RANGE).select("partition", "target", "base_offset")


@query(sql(f"SELECT {Q}, min(base_offset) AS log_start, max(next_offset) AS leo, count(*) AS segments, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM segs GROUP BY ALL", "log1", recursive=True, more=f"{_BY_BYTES}, {_SEGMENTS}"))
def log_bounds(spark, sf):
    return L.bounds(L.segments(_laid(spark, sf))).drop("topic")


_SEGMENT_COLUMNS = f"{Q}, base_offset, next_offset, size_bytes, is_active"


@query(sql(
    f"SELECT {_SEGMENT_COLUMNS} FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY {Q} ORDER BY base_offset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, sum(size_bytes) OVER (PARTITION BY {Q}) AS total FROM segs) "
    "WHERE is_active OR after <= total * 4 // 10", "log1", recursive=True, more=f"{_BY_BYTES}, {_SEGMENTS}",
))
def retention_bytes(spark, sf):
    found = L.segments(_laid(spark, sf))
    total = found.groupBy(*KEYS).agg(F.floor(F.sum("size_bytes") * 4 / 10).alias("limit"))
    return L.retain_by_bytes(found.join(total, KEYS), F.col("limit")).select("partition", "base_offset", "next_offset", "size_bytes", "is_active")


@query(sql(f"SELECT {_SEGMENT_COLUMNS}, created_at_ms FROM segs WHERE is_active OR (SELECT max(ts_ms) FROM log1) - created_at_ms < {7 * DAY_MS}", "log1", recursive=True, more=f"{_BY_BYTES}, {_SEGMENTS}"))
def retention_time(spark, sf):
    rows = derive.log1(spark, sf)
    found = L.segments(_laid(spark, sf), rows.withColumnRenamed("ts_ms", "timestamp"))
    now = derive.records(spark, sf).agg(F.max("ts_ms").alias("now"))
    return L.retain_by_time(found.crossJoin(now), F.col("now"), 7 * DAY_MS).select("partition", "base_offset", "next_offset", "size_bytes", "is_active", "created_at_ms")


@query(sql(f"SELECT topic, {Q}, {O}, CAST(least(max({O}) OVER (PARTITION BY topic, {Q}) + 1, 50) AS BIGINT) AS leo FROM log WHERE {O} < 50", "log"))
def truncate_to_offset(spark, sf):
    rows = derive.log(spark, sf)
    ends = L.truncated_ends(derive.ends(rows), 50)
    return L.truncate(rows, 50).join(ends.select(*KEYS, "leo"), KEYS).select(*KEYS, "offset", "leo")


@query(sql(f"SELECT topic, {Q}, {O}, event_id FROM (SELECT *, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY topic, {Q} ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS bad FROM log) WHERE bad = 0", "log"))
def recover_valid_prefix(spark, sf):
    return L.recover(derive.log(spark, sf), F.col("event_id") % 97 != 0, derive.hour()).select(*KEYS, "offset", "event_id")


# --- catalog and validation

_NAMES = [("orders",), ("",), (".",), ("..",), ("a" * 249,), ("b" * 250,), ("with space",), ("x/y",), ("ok-1_2.3",), ("ü",), (None,)]


@query(f"SELECT name, CAST(CASE WHEN {oracle.valid_name('name')} THEN 0 ELSE 17 END AS INTEGER) AS error_code FROM (SELECT event_type AS name FROM events GROUP BY ALL UNION ALL SELECT * FROM (VALUES {_values(_NAMES)}) v(name))")
def topic_name_validation(spark, sf):
    names = derive.topics(spark, sf).select("name").union(_local(spark, _NAMES, "name string"))
    return names.select("name", F.when(R.valid_topic_name(F.col("name")), 0).otherwise(17).alias("error_code"))


@query(sql(f"""SELECT topic, {Q}, CAST(CASE WHEN {Q} = 3 THEN 2 ELSE [1, 2, 3][{Q} % 3 + 1] END AS INTEGER) AS leader, '1,2,3' AS replicas, CASE WHEN {Q} % 2 = 0 THEN '1,2' ELSE '1,2,3' END AS isr FROM places""", "places"))
def topic_metadata(spark, sf):
    found = derive.topics(spark, sf)
    each = catalog.partitions_of(found)
    in_sync = each.where("partition % 2 = 0").withColumn("isr", F.array(F.lit(1), F.lit(2)))
    leaders = each.where("partition = 3").withColumn("leader", F.lit(2))
    rows = catalog.metadata(found, F.array(F.lit(1), F.lit(2), F.lit(3)), in_sync, leaders)
    return rows.select(*KEYS, "leader", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("replicas", "isr")])


_CREATE = [(1, "purchase", 3), (2, "new", 3), (3, "new", 4), (4, "bad name", 3), (5, "zero", 0), (6, "..", 0), (7, "view", -1), (8, "other", None), (9, None, 1), (10, "zero", 2), (11, "new", 0)]


@query(sql(f"""SELECT id, name, num_partitions, CAST(CASE WHEN NOT {oracle.valid_name('name')} THEN 17 WHEN NOT coalesce(num_partitions > 0, false) THEN 15
  WHEN name IN (SELECT t.name FROM topics t) OR EXISTS (SELECT 1 FROM r b WHERE b.name = r.name AND b.id < r.id AND b.num_partitions > 0) THEN 14 ELSE 0 END AS INTEGER) AS error_code FROM r""",
    "topics", more=f"r(id, name, num_partitions) AS (VALUES {_values(_CREATE)})"))
def create_topics_codes(spark, sf):
    return catalog.create_topics(_local(spark, _CREATE, "id int, name string, num_partitions int"), derive.topics(spark, sf), ["id"])


_PRODUCE = [(i, t, p, a, s, d) for i, (t, p, a, s, d) in enumerate((t, p, a, s, d) for t in ("purchase", "view", "nosuch", "bad name") for p in (0, 1, 2, 9) for a in (1, -1) for s in (100, 5000) for d in (True, False))]


@query(sql(f"""SELECT id, CAST(CASE WHEN NOT {oracle.valid_name('r.topic')} THEN 17 WHEN t.name IS NULL THEN 4 WHEN p.topic IS NULL THEN 4 WHEN r.{Q} % 3 + 1 <> 1 THEN 5
  WHEN acks = -1 AND (CASE WHEN r.topic = 'view' THEN 1 ELSE 3 END) < 2 THEN 8 WHEN set_bytes > 4096 THEN 7 WHEN NOT decodable THEN 3 ELSE 0 END AS INTEGER) AS error_code
FROM r LEFT JOIN topics t ON t.name = r.topic LEFT JOIN places p ON p.topic = r.topic AND p.{Q} = r.{Q}""", "places", more=f"r(id, topic, {Q}, acks, set_bytes, decodable) AS (VALUES {_values(_PRODUCE)})"))  # fmt: skip
def produce_validation(spark, sf):
    found = derive.topics(spark, sf)
    state = catalog.partitions_of(found).select(*KEYS, (F.col("partition") % 3 + 1).alias("leader"), F.when(F.col("topic") == "view", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("isr"))
    requests = _local(spark, _PRODUCE, "id int, topic string, partition int, acks int, set_bytes int, decodable boolean")
    return catalog.validate_produce(requests, found, state, 1, 2, 4096).select("id", "error_code")


_REPLICAS = {"a": [1, 2, 3], "b": [3, 1], "c": [5], "d": []}


@query("SELECT topic, CAST(p AS INTEGER) AS \"partition\", CAST(CASE WHEN len(r) > 0 THEN r[p % len(r) + 1] END AS INTEGER) AS leader FROM (VALUES ('a', [1,2,3]), ('b', [3,1]), ('c', [5]), ('d', CAST([] AS INTEGER[]))) v(topic, r), range(7) t(p)")
def leader_static(spark, sf):
    rows = _local(spark, list(_REPLICAS.items()), "topic string, replicas array<int>").withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select("topic", "partition", R.static_leader(F.col("replicas"), F.col("partition")).alias("leader"))


# --- consumer offsets


@query(sql(f"SELECT group_id, topic, {Q}, {O} FROM committed", "committed"))
def offsets_last_write_wins(spark, sf):
    return offsets.last_commits(derive.commits(spark, sf))


_GROUPS = [f"g{i}" for i in range(6)]
_ASKED = [(g, t, p) for g in _GROUPS for t in ("F", "O", "P") for p in range(5)]


@query(sql(f"SELECT r.group_id, r.topic, r.{Q}, coalesce(c.{O}, -1) AS {O} FROM r LEFT JOIN committed c ON c.group_id = r.group_id AND c.topic = r.topic AND c.{Q} = r.{Q}", "committed", more=f"r(group_id, topic, {Q}) AS (VALUES {_values(_ASKED)})"))
def offset_fetch_default(spark, sf):
    return offsets.fetch_committed(_local(spark, _ASKED, "group_id string, topic string, partition int"), offsets.last_commits(derive.commits(spark, sf)))


_POLICY = {"g0": "earliest", "g1": "latest", "g2": "none", "g3": "weird", "g4": "Latest", "g5": "earliest"}
_COMMIT_ENDS = f'b AS (SELECT topic, {Q}, min({O}) AS log_start, max({O}) + 1 AS leo FROM commits GROUP BY ALL)'


def _commit_ends(rows):
    return rows.groupBy(*KEYS).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("leo"))


@query(sql(f"""SELECT r.group_id, r.topic, r.{Q}, coalesce(c.{O}, -1) AS {O}, CAST(CASE WHEN c.{O} >= 0 THEN c.{O} WHEN b.leo IS NULL THEN -1 WHEN lower(policy) = 'latest' THEN b.leo WHEN policy = 'none' THEN -1 ELSE b.log_start END AS BIGINT) AS position,
  CAST(CASE WHEN c.{O} >= 0 THEN 0 WHEN b.leo IS NULL THEN 4 WHEN policy = 'none' THEN 2 ELSE 0 END AS INTEGER) AS error_code
FROM r JOIN p ON p.group_id = r.group_id LEFT JOIN committed c ON c.group_id = r.group_id AND c.topic = r.topic AND c.{Q} = r.{Q} AND c.{Q} % 2 = 0 LEFT JOIN b ON b.topic = r.topic AND b.{Q} = r.{Q}""",
    "committed", more=f"r(group_id, topic, {Q}) AS (VALUES {_values(_ASKED)}), p(group_id, policy) AS (VALUES {_values(list(_POLICY.items()))}), {_COMMIT_ENDS}"))
def offset_reset_policy(spark, sf):
    rows = derive.commits(spark, sf)
    asked = _local(spark, _ASKED, "group_id string, topic string, partition int")
    fetched = offsets.fetch_committed(asked, offsets.last_commits(rows.where("partition % 2 = 0")))
    policy = F.element_at(F.create_map(*[F.lit(x) for kv in _POLICY.items() for x in kv]), F.col("group_id"))
    return offsets.resolve_positions(fetched, _commit_ends(rows), policy)


@query(sql(f"SELECT c.group_id, c.topic, c.{Q}, b.leo - c.{O} AS lag FROM committed c JOIN b ON b.topic = c.topic AND b.{Q} = c.{Q}", "committed", more=_COMMIT_ENDS))
def consumer_lag(spark, sf):
    rows = derive.commits(spark, sf)
    return offsets.lag(offsets.last_commits(rows), _commit_ends(rows))


@query(sql(f"SELECT group_id, topic, {Q}, {O} FROM committed", "committed"))
def offsets_log_replay(spark, sf):
    logged = offsets.as_log_records(derive.commits(spark, sf), keep=("commit_pos",))
    replayed = offsets.from_log_records(logged.withColumnRenamed("commit_pos", "offset"))
    return offsets.last_commits(replayed)


# --- consumer groups


@query(sql(f"""SELECT group_id, member_id, name AS topic, CAST(unnest(range(CAST(num_partitions // k * i + least(i, num_partitions % k) AS BIGINT), CAST(num_partitions // k * (i + 1) + least(i + 1, num_partitions % k) AS BIGINT))) AS INTEGER) AS {Q} FROM ranked, topics""", "ranked", "topics"))
def assign_range(spark, sf):
    return groups.assign("range", derive.members(spark, sf), derive.topics(spark, sf))


@query(sql(f"SELECT r.group_id, r.member_id, p.topic, p.{Q} FROM (SELECT *, row_number() OVER (ORDER BY topic, {Q}) - 1 AS place FROM places) p JOIN ranked r ON r.i = p.place % r.k", "ranked", "places"))
def assign_roundrobin(spark, sf):
    return groups.assign("roundrobin", derive.members(spark, sf), derive.topics(spark, sf))


@query(f"""WITH h AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_heartbeat_ms FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS member_id, last_heartbeat_ms FROM h WHERE (SELECT max(last_heartbeat_ms) FROM h) - last_heartbeat_ms > CASE WHEN user_id % 3 = 0 THEN 45000 ELSE {DAY_MS} END""")
def session_timeouts(spark, sf):
    beats = derive.records(spark, sf).groupBy(F.col("key").alias("member_id")).agg(F.max("ts_ms").alias("last_heartbeat_ms"))
    rows = beats.withColumn("session_timeout_ms", F.when(F.col("member_id").cast("long") % 3 == 0, 0).otherwise(DAY_MS))
    now = derive.records(spark, sf).agg(F.max("ts_ms").alias("now"))
    return groups.expired(rows.crossJoin(now), F.col("now")).select("member_id", "last_heartbeat_ms")


_STATES = [(f"g{i}", "Stable" if i % 2 else "PreparingRebalance", i % 3) for i in range(5)]


@query(sql("""SELECT r.id, CAST(CASE WHEN g.state IS NULL THEN 9 WHEN r.gen <> g.generation THEN 11 WHEN m.member_id IS NULL THEN 9 WHEN g.state = 'PreparingRebalance' THEN 10 ELSE 0 END AS INTEGER) AS error_code
FROM (SELECT c_custkey AS id, 'g' || (c_nationkey % 7) AS group_id, CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE c_mktsegment END AS member_id, c_custkey % 3 AS gen FROM customer) r
LEFT JOIN g ON g.group_id = r.group_id LEFT JOIN members m ON m.group_id = r.group_id AND m.member_id = r.member_id""", "members", more=f"g(group_id, state, generation) AS (VALUES {_values(_STATES)})"))  # fmt: skip
def heartbeat_codes(spark, sf):
    customer = derive.table(spark, sf, "customer")
    requests = customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("g"), (F.col("c_nationkey") % 7).cast("string")).alias("group_id"),
        F.when(F.col("c_custkey") % 11 == 0, "nobody").otherwise(F.col("c_mktsegment")).alias("member_id"), (F.col("c_custkey") % 3).cast("int").alias("request_generation"),
    )
    known = _local(spark, _STATES, "group_id string, state string, generation int")
    return groups.heartbeat_codes(requests, known, derive.members(spark, sf)).select("id", "error_code")


def commands_of(events: DataFrame) -> DataFrame:
    """Events as commands of five groups: each event type is one command."""
    member = F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string"))
    command = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "join", "purchase", "sync", "view", "heartbeat", "error", "leave", "click", "sweep")]), F.col("event_type"))
    return events.select(
        F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group_id"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), command.alias("command"), member.alias("member_id"),
        (F.col("event_id") % 40).cast("int").alias("generation"), F.lit(4 * 3_600_000).alias("timeout_ms"), F.lit("range").alias("protocol"), F.create_map(member, F.lit("x")).alias("assignments"),
    )


_TIMEOUT = 4 * 3_600_000
#: The machine as a recursive query: beats has the last heartbeat of members m0 ... m6, null for those that are not in the group.
_MACHINE = f"""cmd AS MATERIALIZED (SELECT 'g' || (user_id % 5) AS group_id, event_id AS seq, epoch_us(ts) // 1000 AS now, event_type AS kind, CAST(user_id % 7 AS INTEGER) AS m, CAST(event_id % 40 AS INTEGER) AS gen, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rn FROM events),
fold AS (SELECT group_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0 AS code, false AS known, 'Empty' AS state, 0 AS generation, NULL::INTEGER AS leader, [NULL, NULL, NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS beats FROM (SELECT DISTINCT group_id FROM cmd)
UNION ALL
SELECT group_id, rn, seq, code, known, CASE WHEN rebalance THEN 'PreparingRebalance' WHEN shrunk THEN 'Empty' WHEN kind = 'purchase' AND code = 0 AND m = leader THEN 'Stable' ELSE state END,
  generation + CASE WHEN rebalance THEN 1 ELSE 0 END, CASE WHEN rebalance THEN least_member WHEN shrunk THEN NULL WHEN kind = 'signup' THEN coalesce(leader, m) ELSE leader END, beats
FROM (SELECT *, CASE WHEN kind = 'signup' THEN state <> 'PreparingRebalance' ELSE shrunk AND n > 0 END AS rebalance
FROM (SELECT *, len(list_filter(beats, lambda b : b IS NOT NULL)) AS n, list_position(list_transform(beats, lambda b : b IS NOT NULL), true) - 1 AS least_member,
    CASE kind WHEN 'error' THEN code = 0 WHEN 'click' THEN len(list_filter(beats, lambda b : b IS NOT NULL)) < len(list_filter(old, lambda b : b IS NOT NULL)) ELSE false END AS shrunk
FROM (SELECT *, CASE WHEN kind = 'click' THEN list_transform(old, lambda b : CASE WHEN now - b <= {_TIMEOUT} THEN b END)
    WHEN kind = 'signup' OR (code = 0 AND kind IN ('purchase', 'view')) THEN list_transform(range(7), lambda i : CASE WHEN i = m THEN now ELSE old[CAST(i + 1 AS BIGINT)] END)
    WHEN kind = 'error' AND code = 0 THEN list_transform(range(7), lambda i : CASE WHEN i <> m THEN old[CAST(i + 1 AS BIGINT)] END) ELSE old END AS beats
FROM (SELECT f.group_id, c.rn, c.seq, c.now, c.kind, c.m, f.state, f.generation, f.leader, f.beats AS old, f.known OR c.kind = 'signup' AS known,
    CASE WHEN c.kind IN ('signup', 'click') THEN 0 WHEN NOT f.known THEN 9 WHEN c.kind <> 'error' AND c.gen <> f.generation THEN 11 WHEN f.beats[c.m + 1] IS NULL THEN 9 WHEN c.kind = 'view' AND f.state = 'PreparingRebalance' THEN 10 ELSE 0 END AS code
  FROM fold f JOIN cmd c ON c.group_id = f.group_id AND c.rn = f.rn + 1)))))"""
GROUP_STATES = f"WITH RECURSIVE {_MACHINE} SELECT group_id, seq, code AS error_code, state, generation, 'm' || leader AS leader_id, CAST(len(list_filter(beats, lambda b : b IS NOT NULL)) AS INTEGER) AS members FROM fold WHERE rn > 0"


@query(GROUP_STATES)
def group_state_fold(spark, sf):
    return groups.fold_commands(commands_of(derive.table(spark, sf, "events")))


# --- replication


@query(sql(f"SELECT topic, {Q}, broker_id, max(leo) AS leo FROM reports GROUP BY ALL", "reports"))
def replica_leo(spark, sf):
    return replication.replica_leo(derive.replica_events(spark, sf))


_LAG_MS = 2 * DAY_MS
_STATE = f"state AS (SELECT *, broker_id = 1 OR coalesce((SELECT max(ts) FROM reports) - last_caught_up_ms <= {_LAG_MS}, false) AS in_sync FROM caught)"


def _reports(spark, sf):
    return stored(derive.replica_events(spark, sf), "reports")


def _by_range():
    return F.floor(F.col("seq") / _RANGE)


def _replicas(spark, sf):
    events = _reports(spark, sf)
    now = derive.table(spark, sf, "lineitem").agg(F.max(F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("now"))
    return replication.with_in_sync(replication.caught_up(events, 1, bucket=_by_range()).crossJoin(now), 1, F.col("now"), _LAG_MS)


@query(sql(f"SELECT topic, {Q}, array_to_string(list_sort(list(broker_id) FILTER (in_sync)), ',') AS isr FROM state GROUP BY ALL", "caught", more=_STATE))
def isr_set(spark, sf):
    return replication.in_sync_sets(_replicas(spark, sf)).select(*KEYS, F.concat_ws(",", F.col("isr").cast("array<string>")).alias("isr"))


@query(sql(f"SELECT topic, {Q}, min(leo) FILTER (in_sync) AS hw FROM state GROUP BY ALL", "caught", more=_STATE))
def high_watermark(spark, sf):
    return replication.high_watermark(_replicas(spark, sf))


_HISTORY = f"""history AS MATERIALIZED (SELECT topic, {Q}, seq, ts, max(least(a, b, c)) OVER w AS hw FROM (SELECT *, {', '.join(f"coalesce(max(CASE WHEN broker_id = {b} THEN leo END) OVER w, 0) AS {n}" for b, n in ((1, 'a'), (2, 'b'), (3, 'c')))} FROM reports WINDOW w AS (PARTITION BY topic, {Q} ORDER BY seq)) WINDOW w AS (PARTITION BY topic, {Q} ORDER BY seq))"""


@query(sql(f"SELECT topic, {Q}, seq, hw FROM history", "reports", more=_HISTORY))
def hw_history(spark, sf):
    return replication.watermark_history(_reports(spark, sf), [1, 2, 3], bucket=_by_range()).select(*KEYS, "seq", "hw")


@query(sql(f"""SELECT p.topic, p.{Q}, p.id, p.required_hw, CASE WHEN p.required_hw <= 0 THEN NULL WHEN f.first <= p.deadline_ms THEN f.first ELSE p.deadline_ms END AS done_at,
  CAST(CASE WHEN p.required_hw <= 0 OR coalesce(f.first <= p.deadline_ms, false) THEN 0 ELSE 6 END AS INTEGER) AS error_code
FROM pending p ASOF LEFT JOIN (SELECT {Q}, hw, min(ts) AS first FROM history GROUP BY ALL) f ON f.{Q} = p.{Q} AND p.required_hw <= f.hw""",
    "reports", more=f"{_HISTORY}, pending AS (SELECT topic, {Q}, seq AS id, CAST(seq // 3 AS BIGINT) AS required_hw, ts + {DAY_MS} AS deadline_ms FROM reports)"))
def purgatory_completion(spark, sf):
    events = _reports(spark, sf)
    pending = events.select(*KEYS, F.col("seq").alias("id"), F.floor(F.col("seq") / 3).cast("long").alias("required_hw"), (F.col("ts") + DAY_MS).alias("deadline_ms"))
    return replication.complete_pending(pending, replication.watermark_history(events, [1, 2, 3], bucket=_by_range()), _RANGE).select(*KEYS, "id", "required_hw", "done_at", "error_code")


@query(sql(f"SELECT r.topic, r.{Q}, r.broker_id, r.leo, least(h.hw, r.leo) AS hw FROM (SELECT topic, {Q}, broker_id, max(leo) AS leo FROM reports WHERE broker_id <> 1 GROUP BY ALL) r JOIN (SELECT topic, {Q}, max(leo) - 5 AS hw FROM reports WHERE broker_id = 1 GROUP BY ALL) h ON h.{Q} = r.{Q}", "reports"))
def follower_hw(spark, sf):
    ends = replication.replica_leo(derive.replica_events(spark, sf))
    leader = ends.where("broker_id = 1").select(*KEYS, (F.col("leo") - 5).alias("hw"))
    followers = ends.where("broker_id <> 1")
    found = [replication.follower_watermarks(followers.where(F.col("broker_id") == b), leader).withColumn("broker_id", F.lit(b)) for b in (2, 3)]
    return found[0].unionByName(found[1])


_FENCED = [(t, p, e) for t in ("F", "O", "Z") for p in range(5) for e in (0, 100, 100_000_000)]


@query(f"""WITH c AS (SELECT o_orderstatus AS topic, o_orderkey % 4 AS p, count(*) AS epoch FROM orders GROUP BY ALL), r(topic, p, e) AS (VALUES {_values(_FENCED)})
SELECT r.topic, CAST(r.p AS INTEGER) AS {Q}, r.e AS request_epoch, coalesce(r.e >= c.epoch, true) AS valid FROM r LEFT JOIN c ON c.topic = r.topic AND c.p = r.p""")
def epoch_fence(spark, sf):
    orders = derive.table(spark, sf, "orders")
    changes = orders.select(F.col("o_orderstatus").alias("topic"), (F.col("o_orderkey") % 4).cast("int").alias("partition"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 3 + 1).cast("int").alias("leader"))
    return replication.fence(_local(spark, _FENCED, "topic string, partition int, request_epoch int"), replication.epochs(changes))


# --- producers and statistics

_BATCH, _LINGER = 512, 3_600_000
_BATCHES = f"""b AS (SELECT {Q}, {O}, encoded_size, 0::BIGINT AS batch, CASE WHEN encoded_size >= {_BATCH} THEN 0 ELSE encoded_size END::BIGINT AS held, ts_ms AS opened FROM log1 WHERE {O} = 0
UNION ALL
SELECT {Q}, {O}, encoded_size, batch, CASE WHEN total >= {_BATCH} THEN 0 ELSE total END, opened FROM (
  SELECT l.{Q}, l.{O}, l.encoded_size, b.batch + CASE WHEN NEW THEN 1 ELSE 0 END AS batch, CASE WHEN NEW THEN 0 ELSE b.held END + l.encoded_size AS total, CASE WHEN NEW THEN l.ts_ms ELSE b.opened END AS opened
  FROM b JOIN log1 l ON l.{Q} = b.{Q} AND l.{O} = b.{O} + 1))""".replace("NEW", f"(b.held = 0 OR l.ts_ms - b.opened >= {_LINGER})")


@query(sql(f"SELECT {Q}, batch, count(*) AS records, CAST(sum(encoded_size) AS BIGINT) AS bytes, round(sum(encoded_size) / {_BATCH}.0, 6) AS fill FROM b GROUP BY {Q}, batch", "log1", recursive=True, more=_BATCHES))
def producer_batches(spark, sf):
    rows = derive.log1(spark, sf).select(*KEYS, "offset", "encoded_size", "ts_ms")
    found = produce.batch_fill(produce.batch_boundaries(rows, _BATCH, _LINGER, ["offset"], clock="ts_ms"), _BATCH)
    return found.select("partition", "batch", "records", "bytes", F.round("fill", 6).alias("fill"))


@query(sql("""SELECT worker, l[CAST(least(len(l) * 50 // 100, len(l) - 1) + 1 AS BIGINT)] AS p50, l[CAST(least(len(l) * 95 // 100, len(l) - 1) + 1 AS BIGINT)] AS p95, l[CAST(least(len(l) * 99 // 100, len(l) - 1) + 1 AS BIGINT)] AS p99, l[len(l)] AS max, CAST(len(l) AS BIGINT) AS n
FROM (SELECT worker, list_sort(list(us)) AS l FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY worker) AS n FROM lat) WHERE rn > greatest(1, n // 10) GROUP BY worker)""", "lat"))
def latency_percentiles(spark, sf):
    rows = stored(stats.after_warm_up(derive.latencies(spark, sf), ["worker"], ["ts", "event_id"], derive.hour()).select("worker", "us"), "measured")
    return stats.percentiles(rows, ["worker"], "us", {"p50": 50, "p95": 95, "p99": 99}, 1_000)


@query(sql("SELECT worker, count(*) AS n, round(count(*) / (greatest(max(ts_ms) - min(ts_ms), 1) / 1000.0), 9) AS msgs_per_s, round(count(*) * 1024 / 1048576.0 / (greatest(max(ts_ms) - min(ts_ms), 1) / 1000.0), 9) AS mib_per_s FROM lat GROUP BY worker", "lat"))
def throughput(spark, sf):
    found = derive.latencies(spark, sf).groupBy("worker").agg(F.count("*").alias("n"), (F.max("ts_ms") - F.min("ts_ms")).alias("ms"))
    msgs, mib = stats.throughput(F.col("n"), F.col("ms"), F.col("n") * 1024)
    return found.select("worker", "n", F.round(msgs, 9).alias("msgs_per_s"), F.round(mib, 9).alias("mib_per_s"))
