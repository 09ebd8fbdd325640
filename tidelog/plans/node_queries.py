"""Queries of what brokers and clients do around the log: requests served whole, message bodies, catalogs, checkpoints, groups and
statistics. Each has its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import records as R
from ..operators import catalog, fetch, groups, log as L, offsets, produce, replication, stats
from ..schema import DAY_MS, INDEX_ENTRY_BYTES, Config, index_max_bytes
from ..sources.lines import line_records
from ..sources.record_sets import decode_bodies, decode_sets, encode_bodies, encode_sets
from ..sources.workspace import workspace
from . import derive, queries
from .oracle import hex_of, sql, valid_name
from .queries import _BATCHES, _BY_BYTES, _local, _values

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["topic", "partition"]
Q, O = '"partition"', '"offset"'  # noqa: E741


def query(text: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, text
        return f

    return add


# --- requests served whole

_SERVED = f"""state AS (SELECT p.topic, p.{Q}, CAST(p.{Q} % 3 + 1 AS INTEGER) AS leader, CASE WHEN p.topic = 'view' THEN 1 ELSE 3 END AS isr, coalesce(e.leo, 0) AS leo FROM places p LEFT JOIN ends e ON e.topic = p.topic AND e.{Q} = p.{Q})"""


def _served(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Topics, and their partitions with leader, in-sync set and end."""
    found = derive.topics(spark, sf)
    ends = derive.ends(derive.log(spark, sf)).select(*KEYS, "leo")
    isr = F.when(F.col("topic") == "view", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = catalog.partitions_of(found).join(ends, KEYS, "left")
    return found, rows.select(*KEYS, (F.col("partition") % 3 + 1).alias("leader"), isr.alias("isr"), F.coalesce("leo", F.lit(0)).cast("long").alias("leo"))


_SENT = f"""sent AS (SELECT o_orderkey AS id, ['purchase', 'view', 'click', 'bad name', 'nosuch'][o_orderkey % 5 + 1] AS topic, CAST(o_custkey % 6 AS INTEGER) AS {Q}, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS acks,
  CAST(o_orderkey % 90 * 50 AS INTEGER) AS set_bytes, o_orderkey % 11 <> 0 AS decodable, CAST(o_orderkey % 4 AS BIGINT) AS n FROM orders),
coded AS (SELECT s.*, p.leo, CAST(CASE WHEN NOT {valid_name('s.topic')} THEN 17 WHEN t.name IS NULL THEN 4 WHEN p.topic IS NULL THEN 4 WHEN p.leader <> 1 THEN 5 WHEN acks = -1 AND p.isr < 2 THEN 8 WHEN set_bytes > 4096 THEN 7 WHEN NOT decodable THEN 3 ELSE 0 END AS INTEGER) AS error_code
  FROM sent s LEFT JOIN topics t ON t.name = s.topic LEFT JOIN state p ON p.topic = s.topic AND p.{Q} = s.{Q}),
answered AS (SELECT *, CASE WHEN error_code = 0 THEN n ELSE 0 END AS taken, CAST(coalesce(sum(CASE WHEN error_code = 0 THEN n ELSE 0 END) OVER (PARTITION BY topic, {Q} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM coded)"""


def _sent(spark, sf) -> tuple[DataFrame, DataFrame]:
    orders = derive.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("purchase", "view", "click", "bad name", "nosuch")])
    requests = orders.select(
        k.alias("id"), F.get(names, (k % 5).cast("int")).alias("topic"), (F.col("o_custkey") % 6).cast("int").alias("partition"), F.when(k % 2 == 0, -1).otherwise(1).alias("acks"),
        (k % 90 * 50).cast("int").alias("set_bytes"), (k % 11 != 0).alias("decodable"),
    )
    records = orders.where(k % 4 > 0).select(k.alias("id"), F.explode(F.sequence(F.lit(0), (k % 4 - 1).cast("int"))).alias("place"))
    return requests, records


def _produced(spark, sf):
    topics, partitions = _served(spark, sf)
    return produce.produce(*_sent(spark, sf), topics, partitions, 1, ["id"], F.lit(1_700_000_000_000), min_isr=2, max_message_bytes=4096)


@query(sql(f"SELECT id, topic, {Q}, error_code, CAST(CASE WHEN taken > 0 THEN leo + before ELSE 0 END AS BIGINT) AS base_offset, CAST(CASE WHEN taken > 0 THEN 1700000000000 ELSE 0 END AS BIGINT) AS log_append_time FROM answered", "ends", "places", more=f"{_SERVED}, {_SENT}"))
def produce_requests(spark, sf):
    return _produced(spark, sf)[0].select("id", *KEYS, "error_code", "base_offset", "log_append_time")


@query(sql(f"SELECT id, topic, {Q}, CAST(leo + before + k AS BIGINT) AS {O} FROM answered, range(4) t(k) WHERE k < taken", "ends", "places", more=f"{_SERVED}, {_SENT}"))
def produce_requests_records(spark, sf):
    return _produced(spark, sf)[1].select("id", *KEYS, "offset")


_FOLLOWERS = [(t, p, b, o) for t in ("purchase", "view", "nosuch") for p in (0, 1, 3, 9) for b, o in ((2, 0), (3, 15), (2, 10_000_000))]
_ASKED = f"""r(topic, {Q}, replica_id, fetch_offset) AS (VALUES {_values(_FOLLOWERS)}),
got AS (SELECT * FROM (SELECT l.*, r.replica_id, r.fetch_offset, sum(encoded_size) OVER w AS upto, row_number() OVER w AS rn FROM log l JOIN r ON r.topic = l.topic AND r.{Q} = l.{Q} AND l.{O} >= r.fetch_offset JOIN state s ON s.topic = l.topic AND s.{Q} = l.{Q} AND s.leader = 1
  WINDOW w AS (PARTITION BY l.topic, l.{Q}, r.replica_id, r.fetch_offset ORDER BY l.{O} ROWS UNBOUNDED PRECEDING)) WHERE rn = 1 OR upto <= 3000),
answers AS (SELECT r.topic, r.{Q}, r.replica_id, CAST(r.fetch_offset AS BIGINT) AS fetch_offset, CAST(CASE WHEN s.topic IS NULL THEN 4 WHEN s.leader <> 1 THEN 5 ELSE 0 END AS INTEGER) AS error_code,
  CAST(CASE WHEN s.leader = 1 THEN coalesce((SELECT max({O}) + 1 FROM got g WHERE g.topic = r.topic AND g.{Q} = r.{Q} AND g.replica_id = r.replica_id AND g.fetch_offset = r.fetch_offset), r.fetch_offset) END AS BIGINT) AS follower_leo
  FROM r LEFT JOIN state s ON s.topic = r.topic AND s.{Q} = r.{Q})"""


def _replica_fetched(spark, sf):
    requests = _local(spark, _FOLLOWERS, "topic string, partition int, replica_id int, fetch_offset long")
    _, partitions = _served(spark, sf)
    return fetch.replica_fetch(requests, derive.log(spark, sf), partitions, 1, 3000), partitions


@query(sql("SELECT * FROM answers", "ends", "places", more=f"{_SERVED}, {_ASKED}"))
def replica_fetch(spark, sf):
    return _replica_fetched(spark, sf)[0][0]


@query(sql(f"SELECT topic, {Q}, replica_id, CAST(fetch_offset AS BIGINT) AS fetch_offset, {O}, key FROM got", "ends", "places", more=f"{_SERVED}, {_ASKED}"))
def replica_fetch_records(spark, sf):
    return _replica_fetched(spark, sf)[0][1].select(*KEYS, "replica_id", "fetch_offset", "offset", "key")


@query(sql(f"SELECT topic, {Q}, broker_id, CAST(max(leo) AS BIGINT) AS leo FROM (SELECT topic, {Q}, replica_id AS broker_id, follower_leo AS leo FROM answers WHERE error_code = 0 UNION ALL SELECT topic, {Q}, leader, leo FROM state UNION ALL SELECT topic, {Q}, 2, 12 FROM state) GROUP BY ALL", "ends", "places", more=f"{_SERVED}, {_ASKED}"))
def replica_progress(spark, sf):
    (answers, _), partitions = _replica_fetched(spark, sf)
    return fetch.after_replica_fetch(answers, partitions.select(*KEYS, F.lit(2).alias("broker_id"), F.lit(12).cast("long").alias("leo")), partitions)


@query(sql(f"SELECT topic, {Q}, {O}, event_id FROM log1 WHERE {O} < 700 UNION ALL SELECT topic, {Q}, 700 + row_number() OVER (PARTITION BY {Q} ORDER BY {O}) - 1, event_id FROM log1 WHERE {O} BETWEEN 700 AND 1100", "log1"))
def follower_append(spark, sf):
    """A follower's log after two rounds of its loop."""
    rows = derive.log1(spark, sf).select(*KEYS, "offset", "event_id")
    local = rows.where("offset < 700")
    for first, last in ((700, 900), (901, 1100)):
        local = replication.append_fetched(local, rows.where(F.col("offset").between(first, last)))
    return local


@query(sql(f"SELECT topic, {Q}, {O}, ts_ms AS timestamp, key, value FROM log WHERE {O} BETWEEN 20 AND 60", "log"))
def message_projection(spark, sf):
    rows = fetch.scan(derive.log(spark, sf), 20, 61).withColumnRenamed("ts_ms", "timestamp").withColumn("attributes", F.lit(0))
    return fetch.messages(rows)


@query(sql(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5 ELSE ts_ms END AS timestamp, 1000 + event_id % 10 AS {O} FROM rec", "rec"))
def producer_send(spark, sf):
    """What a producer fills in before a send, and tells its caller after it."""
    rows = derive.records(spark, sf).withColumn("timestamp", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 - 1).otherwise(F.col("ts_ms")))
    sent = produce.with_timestamps(rows, F.lit(5).cast("long"))
    return produce.client_offsets(sent, F.lit(1000), F.col("event_id") % 10).select("event_id", "timestamp", "offset")


# --- records and message bodies


@query(sql("SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM rec", "rec"))
def record_crc_valid(spark, sf):
    """A flipped bit in every fifth record and a lost byte in every seventh are found."""
    rows = derive.records(spark, sf)
    whole = R.encode_record(F.col("event_id"), F.col("ts_ms"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    flipped = F.expr("overlay(record PLACING X'FF' FROM 31 FOR 1)")
    cut = F.expr("substring(record, 1, octet_length(record) - 1)")
    sent = F.when(F.col("event_id") % 5 == 0, flipped).when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("record"))
    return rows.select("event_id", whole.alias("record")).select("event_id", R.valid_record(sent).alias("valid"))


@query(sql(f"SELECT topic, {Q}, {O}, ts_ms, key FROM log1 WHERE {O} % 100 < 60 OR {O} // 100 % 2 = 0", "log1"))
def recordset_decode_lenient(spark, sf):
    """Every other record set is cut inside its 61st record: what stands before is kept."""
    rows = derive.log1(spark, sf).select(*KEYS, "offset", queries._encoded().alias("record"), F.floor(F.col("offset") / 100).alias("request"))
    torn = (F.col("request") % 2 == 1) & (F.col("offset") % 100 == 60)
    rows = rows.where((F.col("request") % 2 == 0) | (F.col("offset") % 100 <= 60)).withColumn("record", F.when(torn, F.substring("record", 1, 20)).otherwise(F.col("record")))
    sets = encode_sets(rows, [*KEYS, "request"])
    return decode_sets(sets, keys=KEYS, lenient=True).select(*KEYS, "offset", F.col("timestamp").alias("ts_ms"), F.col("key").cast("string").alias("key"))


_INT = hex_of


def _string(s: str) -> str:
    return f"{_INT(f'octet_length(encode({s}))', 2)} || hex(encode({s}))"


def _blob(s: str) -> str:
    return f"{_INT(f'octet_length(encode({s}))', 4)} || hex(encode({s}))"


def _list(*items: str) -> str:
    return " || ".join([_INT(str(len(items)), 4), *items])


def _row(*items: str) -> str:
    return " || ".join(items)


_K, _N, _S, _T = "c_custkey", "c_nationkey", "c_mktsegment", "c_name"
# Each body: the value as Spark's SQL has it, and its bytes as hex in DuckDB's.
_REQUEST_BODIES = {
    0: (f"named_struct('acks', -1, 'timeout_ms', {_K}, 'topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'record_set', cast({_T} as binary))))))",
        _row(_INT("-1", 2), _INT(_K, 4), _list(_row(_string(_S), _list(_row(_INT(_N, 4), _blob(_T))))))),
    1: (f"named_struct('max_wait_ms', 500, 'min_bytes', 1, 'max_bytes', {_K}, 'topics', array(named_struct('name', {_T}, 'partitions', array(named_struct('partition', 0, 'fetch_offset', {_K} * 1000000, 'max_bytes', 9), named_struct('partition', {_N}, 'fetch_offset', -1, 'max_bytes', -2)))))",
        _row(_INT("500", 4), _INT("1", 4), _INT(_K, 4), _list(_row(_string(_T), _list(_row(_INT("0", 4), _INT(f"{_K} * 1000000", 8), _INT("9", 4)), _row(_INT(_N, 4), _INT("-1", 8), _INT("-2", 4))))))),
    2: (f"named_struct('topics', array({_S}, {_T}, ''))", _list(_string(_S), _string(_T), _string("''"))),
    3: (f"named_struct('topics', array(named_struct('name', {_S}, 'num_partitions', {_N}, 'replication_factor', 3)))", _list(_row(_string(_S), _INT(_N, 4), _INT("3", 2)))),
    4: (f"named_struct('group_id', {_S}, 'session_timeout_ms', {_K}, 'member_id', {_T}, 'protocol_type', 'consumer', 'protocols', array(named_struct('name', 'range', 'metadata', cast('' as binary))))",
        _row(_string(_S), _INT(_K, 4), _string(_T), _string("'consumer'"), _list(_row(_string("'range'"), _INT("0", 4))))),
    5: (f"named_struct('group_id', {_S}, 'generation', {_N}, 'member_id', {_T}, 'assignments', array(named_struct('member_id', {_T}, 'assignment', cast({_S} as binary))))",
        _row(_string(_S), _INT(_N, 4), _string(_T), _list(_row(_string(_T), _blob(_S))))),
    6: (f"named_struct('group_id', {_S}, 'generation', {_N}, 'member_id', {_T})", _row(_string(_S), _INT(_N, 4), _string(_T))),
    7: (f"named_struct('group_id', {_S}, 'member_id', {_T})", _row(_string(_S), _string(_T))),
    8: (f"named_struct('group_id', {_S}, 'generation', -1, 'member_id', {_T}, 'topics', array(named_struct('name', 't', 'partitions', array(named_struct('partition', {_N}, 'offset', {_K}, 'metadata', '')))))",
        _row(_string(_S), _INT("-1", 4), _string(_T), _list(_row(_string("'t'"), _list(_row(_INT(_N, 4), _INT(_K, 8), _string("''"))))))),
    9: (f"named_struct('group_id', {_S}, 'topics', array(named_struct('name', 't', 'partitions', array({_N}, 1))))", _row(_string(_S), _list(_row(_string("'t'"), _list(_INT(_N, 4), _INT("1", 4)))))),
    10: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'timestamp', -2)))))", _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT("-2", 8)))))),
    11: (f"named_struct('replica_id', 2, 'max_wait_ms', 500, 'topic', {_S}, 'partition', {_N}, 'fetch_offset', {_K})", _row(_INT("2", 4), _INT("500", 4), _string(_S), _INT(_N, 4), _INT(_K, 8))),
}
_RESPONSE_BODIES = {
    0: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'error_code', 7, 'base_offset', {_K}, 'log_append_time', -1)))))",
        _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT("7", 2), _INT(_K, 8), _INT("-1", 8)))))),
    1: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'error_code', 0, 'high_watermark', {_K}, 'log_start_offset', 0, 'record_set', cast({_T} as binary))))))",
        _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT("0", 2), _INT(_K, 8), _INT("0", 8), _blob(_T)))))),
    2: (f"named_struct('brokers', array(named_struct('node_id', 1, 'host', {_T}, 'port', 9092)), 'topics', array(named_struct('name', {_S}, 'error_code', 0, 'partitions', array(named_struct('partition', {_N}, 'leader', 1, 'replicas', array(1, 2), 'isr', array(1))))))",
        _row(_list(_row(_INT("1", 4), _string(_T), _INT("9092", 4))), _list(_row(_string(_S), _INT("0", 2), _list(_row(_INT(_N, 4), _INT("1", 4), _list(_INT("1", 4), _INT("2", 4)), _list(_INT("1", 4)))))))),
    3: (f"named_struct('topics', array(named_struct('name', {_S}, 'error_code', 14)))", _list(_row(_string(_S), _INT("14", 2)))),
    4: (f"named_struct('error_code', 0, 'generation', {_N}, 'protocol_name', 'range', 'leader_id', {_S}, 'member_id', {_T}, 'members', array(named_struct('member_id', {_T}, 'metadata', cast('' as binary))))",
        _row(_INT("0", 2), _INT(_N, 4), _string("'range'"), _string(_S), _string(_T), _list(_row(_string(_T), _INT("0", 4))))),
    5: (f"named_struct('error_code', 11, 'assignment', cast({_T} as binary))", _row(_INT("11", 2), _blob(_T))),
    6: ("named_struct('error_code', 10)", _INT("10", 2)),
    7: ("named_struct('error_code', 9)", _INT("9", 2)),
    8: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'error_code', 0)))))", _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT("0", 2)))))),
    9: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'offset', {_K}, 'error_code', 0)))))", _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT(_K, 8), _INT("0", 2)))))),
    10: (f"named_struct('topics', array(named_struct('name', {_S}, 'partitions', array(named_struct('partition', {_N}, 'error_code', 4, 'offset', -1)))))", _list(_row(_string(_S), _list(_row(_INT(_N, 4), _INT("4", 2), _INT("-1", 8)))))),
    12: ("named_struct('api_keys', array(named_struct('api_key', 0, 'min_version', 1, 'max_version', 1)))", _list(_row(_INT("0", 2), _INT("1", 2), _INT("1", 2)))),
}


def _bodies(bodies: dict) -> str:
    return " UNION ALL ".join(f"SELECT {api} AS api, c_custkey, {text} AS body FROM customer" for api, (_, text) in bodies.items())


def _through(customer: DataFrame, bodies: dict, layouts: dict) -> DataFrame:
    """Each body encoded, decoded, and encoded again: the bytes of the second time."""
    out = None
    for api, (value, _) in bodies.items():
        once = encode_bodies(customer.select("c_custkey", F.expr(value).cast(codec.ddl(layouts[api])).alias("v")), "v", layouts[api], "first").drop("v")
        again = encode_bodies(decode_bodies(once, "first", layouts[api]), "body", layouts[api], "second")
        rows = again.select(F.lit(api).alias("api"), "c_custkey", F.hex("second").alias("body"))
        out = rows if out is None else out.union(rows)
    return out


@query(_bodies(_REQUEST_BODIES))
def request_bodies(spark, sf):
    return _through(derive.table(spark, sf, "customer"), _REQUEST_BODIES, codec.REQUESTS)


@query(_bodies(_RESPONSE_BODIES))
def response_bodies(spark, sf):
    return _through(derive.table(spark, sf, "customer"), _RESPONSE_BODIES, codec.RESPONSES)


_FRAME = _row(_INT("6", 2), _INT("1", 2), _INT(_K, 4), _string(_T), _blob(_S))


@query(f"SELECT c_custkey, {_INT(f'length({_FRAME}) // 2', 4)} || {_FRAME} AS frame, c_custkey AS correlation_id, c_mktsegment AS payload FROM customer")
def request_frames(spark, sf):
    """Frames with their size, and the fields that come out of them."""
    value = F.expr(f"named_struct('api_key', 6, 'api_version', 1, 'correlation_id', {_K}, 'client_id', {_T}, 'payload', cast({_S} as binary))").cast(codec.ddl(codec.REQUEST_FRAME))
    inner = encode_bodies(derive.table(spark, sf, "customer").select("c_custkey", value.alias("v")), "v", codec.REQUEST_FRAME).drop("v")
    # a size and as many bytes: the form of a nullable blob
    framed = encode_bodies(inner.select("c_custkey", F.struct("encoded").alias("v")), "v", (("encoded", "bytes"),), "frame").drop("v")
    back = decode_bodies(decode_bodies(framed, "frame", (("inner", "bytes"),), "cut").select("c_custkey", "frame", F.col("cut.inner").alias("inner")), "inner", codec.REQUEST_FRAME)
    return back.select("c_custkey", F.hex("frame").alias("frame"), F.col("body.correlation_id").cast("long").alias("correlation_id"), F.col("body.payload").cast("string").alias("payload"))


@query(sql(f"""SELECT {Q}, {hex_of('0', 2)} || {hex_of('max(leo) - 10', 8)} || string_agg(record, '' ORDER BY {O}) AS body, count(*) AS records FROM (
  SELECT l.*, e.leo, {hex_of('encoded_size - 4', 4)} || {hex_of(O, 8)} || {hex_of('ts_ms', 8)} || lpad(hex(crc), 8, '0') || body AS record FROM (SELECT *, {queries.oracle.crc32c('unhex(body)')} AS crc FROM (SELECT *, {queries._BODY} AS body FROM log1 WHERE {O} < 5)) l JOIN ends1 e ON e.{Q} = l.{Q}) GROUP BY {Q}""", "log1", "ends1"))  # fmt: skip
def replica_fetch_bodies(spark, sf):
    """Responses to followers: code, watermark and encoded records, and how many records come out again."""
    rows = derive.log1(spark, sf)
    ends = derive.ends(rows).select(*KEYS, "hw")
    sets = encode_sets(rows.where("offset < 5").select(*KEYS, "offset", queries._encoded().alias("record")), KEYS).join(ends, KEYS)
    bodies = sets.select(*KEYS, "record_set", F.concat(F.unhex(F.lit("0000")), F.unhex(F.lpad(F.hex("hw"), 16, "0")), "record_set").alias("body"))
    counts = decode_sets(bodies.select(*KEYS, F.expr("substring(body, 11)").alias("record_set")), keys=KEYS, lenient=True).groupBy(*KEYS).agg(F.count("*").alias("records"))
    return bodies.join(counts, KEYS).select("partition", F.hex("body").alias("body"), "records")


_ASSIGNMENT = _list(_row(_string(_S), _list(_INT(_N, 4), _INT("7", 4))))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE {_ASSIGNMENT} END AS assignment, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS topics FROM customer")
def assignment_codec(spark, sf):
    """Assignments as members get them; empty bytes are an empty assignment."""
    layout = (("topics", codec.ASSIGNMENT),)
    value = F.expr(f"named_struct('topics', array(named_struct('topic', {_S}, 'partitions', array({_N}, 7))))").cast(codec.ddl(layout))
    rows = encode_bodies(derive.table(spark, sf, "customer").select("c_custkey", value.alias("v")), "v", layout).drop("v")
    sent = rows.withColumn("encoded", F.when(F.col("c_custkey") % 3 == 0, F.lit(b"")).otherwise(F.col("encoded")))
    full = decode_bodies(sent.where("octet_length(encoded) > 0"), "encoded", layout).select("c_custkey", F.hex("encoded").alias("assignment"), F.size("body.topics").alias("topics"))
    return full.union(sent.where("octet_length(encoded) = 0").select("c_custkey", F.lit(""), F.lit(0)))


_NUMBERS = {"i8": ("tinyint", 1, "c_custkey % 256 - 128"), "i16": ("smallint", 2, "c_custkey - 20000"), "i32": ("int", 4, "c_custkey * 1000 - 5000000"), "i64": ("bigint", 8, "c_custkey * 1000000000000 - 5")}


@query("SELECT c_custkey, " + " || ".join([*(_INT(f"({e})", w) for _, w, e in _NUMBERS.values()), "CASE WHEN c_custkey % 2 = 0 THEN '01' ELSE '00' END", "CASE WHEN c_custkey % 5 = 0 THEN 'FFFF' ELSE " + _string(_T) + " END", "CASE WHEN c_custkey % 7 = 0 THEN 'FFFFFFFF' ELSE " + _blob(_T) + " END"]) + " AS encoded FROM customer")
def codec_primitives(spark, sf):
    layout = (*((k, k) for k in _NUMBERS), ("flag", "bool"), ("text", "string?"), ("data", "bytes?"))
    # the low bytes of each number, as the SQL has them; a cast alone fails on a number that needs more
    fields = ", ".join(f"'{k}', cast(shiftright(shiftleft(cast({e} as bigint), {64 - 8 * w}), {64 - 8 * w}) as {t})" for k, (t, w, e) in _NUMBERS.items())
    value = F.expr(f"named_struct({fields}, 'flag', c_custkey % 2 = 0, 'text', if(c_custkey % 5 = 0, null, c_name), 'data', if(c_custkey % 7 = 0, null, cast(c_name as binary)))")
    rows = encode_bodies(derive.table(spark, sf, "customer").select("c_custkey", value.alias("v")), "v", layout, "first").drop("v")
    return encode_bodies(decode_bodies(rows, "first", layout), "body", layout).select("c_custkey", F.hex("encoded").alias("encoded"))


# --- catalog


@query(sql("SELECT name, num_partitions, CAST(1 AS SMALLINT) AS replication_factor FROM topics", "topics"))
def topic_metadata_json(spark, sf):
    """A catalog saved twice and loaded; the second time replaces the first."""
    path = f"{workspace(spark, 'catalog').removeprefix('file://')}.json"
    found = derive.topics(spark, sf)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    catalog.save_topics(found.limit(1), path)
    catalog.save_topics(found, path)
    return catalog.load_topics(spark, path)


_WANTED = [("purchase",), ("nosuch",), ("view",)]


@query(sql(f"SELECT w.topic, p.{Q}, CASE WHEN t.name IS NULL THEN 4 ELSE 0 END AS error_code FROM w LEFT JOIN topics t ON t.name = w.topic LEFT JOIN places p ON p.topic = w.topic", "topics", "places", more=f"w(topic) AS (VALUES {_values(_WANTED)})"))
def metadata_wanted(spark, sf):
    rows = catalog.metadata(derive.topics(spark, sf), F.array(F.lit(1)), wanted=[x for (x,) in _WANTED])
    return rows.select(*KEYS, "error_code")


@query(sql("SELECT 'all' AS asked, topic AS name, CAST(count(*) AS INTEGER) AS num_partitions FROM places GROUP BY ALL UNION ALL SELECT 'some', topic, CAST(count(*) AS INTEGER) FROM places WHERE topic IN ('purchase', 'view') GROUP BY ALL", "places"))
def partitions_per_topic(spark, sf):
    """No list of topics means all, an empty one none; topics with an error are left out."""
    found = derive.topics(spark, sf)
    out = None
    for name, wanted in (("all", None), ("some", [x for (x,) in _WANTED]), ("none", [])):
        rows = catalog.partition_counts(catalog.without_errors(catalog.metadata(found, F.array(F.lit(1)), wanted=wanted))).select(F.lit(name).alias("asked"), "name", "num_partitions")
        out = rows if out is None else out.union(rows)
    return out


_BROKERS = [(1, "alpha", 9092), (2, "beta", 9093)]


@query(sql(f"SELECT p.topic, p.{Q}, CAST(p.{Q} % 3 + 1 AS INTEGER) AS leader, b.host, CAST(b.port AS INTEGER) AS port FROM places p LEFT JOIN b ON b.id = p.{Q} % 3 + 1", "places", more=f"b(id, host, port) AS (VALUES {_values(_BROKERS)})"))
def broker_address_lookup(spark, sf):
    rows = catalog.partitions_of(derive.topics(spark, sf)).withColumn("leader", F.col("partition") % 3 + 1)
    return replication.broker_addresses(rows, _local(spark, _BROKERS, "id int, host string, port int"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '7' ELSE array_to_string(list_distinct_ordered, ',') END AS replicas FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = c_nationkey % 3 THEN [c_custkey % 3] ELSE [c_custkey % 3, c_nationkey % 3] END AS list_distinct_ordered FROM customer)")
def distinct_replicas(spark, sf):
    a, b = (F.col("c_custkey") % 3).cast("int"), (F.col("c_nationkey") % 3).cast("int")
    ids = F.when(F.col("c_custkey") % 10 != 0, F.array(a, b, a))
    return derive.table(spark, sf, "customer").select("c_custkey", F.array_join(catalog.distinct_replicas(ids, 7).cast("array<string>"), ",").alias("replicas"))


# --- checkpoints and offsets


@query(sql(f"SELECT topic, {Q}, CAST(CASE WHEN {Q} % 2 = 0 THEN hw + 100 ELSE hw END AS BIGINT) AS hw FROM ends", "ends"))
def checkpoint_upsert(spark, sf):
    """Watermarks written as lines, replaced in part, and read; lines of another form are skipped."""
    ends = derive.ends(derive.log(spark, sf))
    path = workspace(spark, "checkpoint")
    none = ends.limit(0).select(*KEYS, "hw")
    replication.update_checkpoint(none, ends).union(_local(spark, [("not a line of it",), ("",)], "value string")).coalesce(1).write.text(f"{path}/1")
    newer = ends.where("partition % 2 = 0").select(*KEYS, (F.col("hw") + 100).alias("hw"))
    replication.update_checkpoint(replication.read_checkpoint(spark, f"{path}/1"), newer).coalesce(1).write.text(f"{path}/2")
    return replication.read_checkpoint(spark, f"{path}/2")


@query(sql(f"SELECT group_id, topic, {Q}, {O} FROM (SELECT *, row_number() OVER (PARTITION BY group_id, topic, {Q} ORDER BY committed_at DESC, k DESC) AS rn FROM commits WHERE k % 3 <> 0) WHERE rn = 1", "commits"))
def offsets_malformed(spark, sf):
    """Every third record of the offsets log is spoilt: an empty key, a short value, or a key without its parts."""
    logged = offsets.as_log_records(derive.commits(spark, sf), keep=("commit_pos",)).withColumnRenamed("commit_pos", "offset")
    k = F.col("offset.key")
    key = F.when((k % 3 == 0) & (k % 2 == 0), F.lit(b"")).when((k % 9 == 0), F.lit(b"nocolon")).otherwise(F.col("key"))
    value = F.when((k % 3 == 0) & (k % 2 == 1) & (k % 9 != 0), F.substring("value", 1, 7)).otherwise(F.col("value"))
    return offsets.last_commits(offsets.from_log_records(logged.withColumns({"key": key, "value": value})))


# --- groups

_OWNED = f"""old AS (SELECT group_id, member_id, topic, {Q} FROM (SELECT r.group_id, r.member_id, p.topic, p.{Q} FROM (SELECT *, row_number() OVER (ORDER BY topic, {Q}) - 1 AS place FROM places) p JOIN ranked r ON r.i = p.place % r.k)),
new AS (SELECT r.group_id, r.member_id, p.topic, p.{Q} FROM (SELECT *, row_number() OVER (ORDER BY topic, {Q}) - 1 AS place FROM places) p JOIN left_over r ON r.i = p.place % r.k)"""
_LEFT = "left_over AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS k FROM members WHERE member_id <> 'BUILDING')"


@query(sql(f"""SELECT coalesce(n.group_id, o.group_id) AS group_id, coalesce(n.member_id, o.member_id) AS member_id, coalesce(n.topic, o.topic) AS topic, coalesce(n.{Q}, o.{Q}) AS {Q},
  CASE WHEN n.topic IS NULL THEN 'revoked' WHEN o.topic IS NULL THEN 'added' ELSE 'kept' END AS change,
  CAST(CASE WHEN n.topic IS NULL THEN NULL WHEN n.{Q} % 2 = 0 THEN n.{Q} * 10 + 5 WHEN e.leo IS NULL THEN -1 ELSE e.leo END AS BIGINT) AS position,
  CAST(CASE WHEN n.topic IS NULL OR n.{Q} % 2 = 0 OR e.leo IS NOT NULL THEN 0 ELSE 4 END AS INTEGER) AS error_code
FROM old o FULL JOIN new n ON n.group_id = o.group_id AND n.member_id = o.member_id AND n.topic = o.topic AND n.{Q} = o.{Q} LEFT JOIN ends e ON e.topic = n.topic AND e.{Q} = n.{Q}""",
    "ends", "ranked", "places", more=f"{_LEFT}, {_OWNED}"))
def rebalance(spark, sf):
    """A member leaves each group: what the others give up, keep and get, and where they read on."""
    members, topics = derive.members(spark, sf), derive.topics(spark, sf)
    old = groups.assign("roundrobin", members, topics)
    new = groups.assign("roundrobin", members.where("member_id <> 'BUILDING'"), topics)
    committed = old.select("group_id", *KEYS).distinct().where("partition % 2 = 0").withColumn("offset", (F.col("partition") * 10 + 5).cast("long"))
    return groups.rebalance(old, new, committed, derive.ends(derive.log(spark, sf)), F.lit("latest"))


_PLACED = f"placed AS (SELECT r.group_id, r.member_id, p.topic, p.{Q} FROM (SELECT *, row_number() OVER (ORDER BY topic, {Q}) - 1 AS place FROM places) p JOIN ranked r ON r.i = p.place % r.k)"


@query(sql(f"SELECT group_id, member_id, topic, {Q} FROM placed WHERE member_id <> 'MACHINERY'", "ranked", "places", more=_PLACED))
def assignment_apply(spark, sf):
    """Assignments of members that the group does not know are skipped."""
    members = derive.members(spark, sf)
    return groups.apply_assignment(groups.assign("roundrobin", members, derive.topics(spark, sf)), members.where("member_id <> 'MACHINERY'"))


@query(sql(f"SELECT group_id, member_id, topic, array_to_string(list_sort(list({Q})), ',') AS partitions FROM placed GROUP BY ALL", "ranked", "places", more=_PLACED))
def partitions_by_topic(spark, sf):
    rows = catalog.by_topic(groups.assign("roundrobin", derive.members(spark, sf), derive.topics(spark, sf)), ["group_id", "member_id"])
    return rows.withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query(sql("SELECT group_id, array_to_string(list_sort(list(member_id)), ',') AS members FROM members GROUP BY ALL", "members"))
def group_members(spark, sf):
    return groups.membership(derive.members(spark, sf)).withColumn("members", F.array_join("members", ","))


@query("SELECT c_custkey, c_name || '-' || lower(lpad(hex(c_custkey * 7919), 16, '0')) AS member_id FROM customer")
def member_ids(spark, sf):
    return derive.table(spark, sf, "customer").select("c_custkey", groups.member_id(F.col("c_name"), F.col("c_custkey") * 7919).alias("member_id"))


# --- log geometry and statistics


@query(sql(f"SELECT {Q}, count(*) AS records, count(DISTINCT base) AS segments, count(*) FILTER (mark) AS index_entries, CAST(sum(encoded_size) AS BIGINT) AS bytes FROM walk GROUP BY ALL", "log1", recursive=True, more=_BY_BYTES))
def log_counters(spark, sf):
    return L.counters(queries._laid(spark, sf)).drop("topic")


@query(sql(f"SELECT DISTINCT {Q}, lpad(CAST(base AS VARCHAR), 20, '0') || '.log' AS file FROM walk", "log1", recursive=True, more=_BY_BYTES))
def segment_names(spark, sf):
    return L.segments(queries._laid(spark, sf)).select("partition", R.segment_file_name(F.col("base_offset")).alias("file"))


_SIZES = [(a, b) for a in (1 << 10, 1 << 20, 128 << 20, 4 << 30) for b in (-1, 0, 64, 4096, 1 << 20)]


@query(f"SELECT segment_bytes, interval_bytes, CAST(CASE WHEN interval_bytes <= 0 THEN {10 << 20} ELSE least({10 << 20}, greatest({64 << 10}, (segment_bytes // interval_bytes + 1) * {INDEX_ENTRY_BYTES} * 2)) END AS BIGINT) AS index_bytes FROM (VALUES {_values(_SIZES)}) v(segment_bytes, interval_bytes)".replace("segment_bytes, interval_bytes, CAST", "CAST(segment_bytes AS BIGINT) AS segment_bytes, CAST(interval_bytes AS BIGINT) AS interval_bytes, CAST", 1))
def index_capacity(spark, sf):
    return _local(spark, [(a, b, index_max_bytes(a, b)) for a, b in _SIZES], "segment_bytes long, interval_bytes long, index_bytes long")


_SHOWN = "CASE WHEN us = floor(us) AND us >= 1 THEN printf('%.0f', us) ELSE printf('%.3f', us) END"


@query(f"SELECT event_id, {_SHOWN} AS shown, CASE WHEN {_SHOWN} = '0.000' THEN '0.000 [*]' ELSE {_SHOWN} END AS median FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN round(value, 2) WHEN 2 THEN floor(value) ELSE 0.0001 END AS us FROM events)")
def latency_format(spark, sf):
    n = F.col("event_id") % 4
    us = F.when(n == 0, 0.0).when(n == 1, F.round("value", 2)).when(n == 2, F.floor("value").cast("double")).otherwise(0.0001)
    return derive.table(spark, sf, "events").select("event_id", R.format_latency(us).alias("shown"), R.format_median_latency(us).alias("median"))


@query(sql("SELECT round(avg(fill), 9) AS mean_fill, count(*) AS batches FROM (SELECT sum(encoded_size) / 512.0 AS fill FROM b GROUP BY \"partition\", batch)", "log1", recursive=True, more=_BATCHES))
def mean_batch_fill(spark, sf):
    rows = derive.log1(spark, sf).select(*KEYS, "offset", "encoded_size", "ts_ms")
    filled = produce.batch_fill(produce.batch_boundaries(rows, 512, 3_600_000, ["offset"], clock="ts_ms"), 512)
    return produce.mean_fill(filled).select(F.round("mean_fill", 9).alias("mean_fill"), "batches")


@query("SELECT CAST(n AS INTEGER) AS n, CAST(w AS INTEGER) AS workers, CAST(i AS INTEGER) AS worker, CAST(n // w + CASE WHEN i < n % w THEN 1 ELSE 0 END AS INTEGER) AS samples FROM (VALUES (1000, 16), (7, 3), (2, 5), (0, 4)) v(n, w), range(16) t(i) WHERE i < w")
def work_split(spark, sf):
    rows = [(n, w, i, x) for n, w in ((1000, 16), (7, 3), (2, 5), (0, 4)) for i, x in enumerate(stats.split_work(n, w))]
    return _local(spark, rows, "n int, workers int, worker int, samples int")


_POLLS = "polls AS (SELECT CAST(user_id % 16 AS INTEGER) AS worker, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS n_messages, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS try FROM events)"


@query(f"""WITH {_POLLS}, seen AS (SELECT *, sum(n_messages) OVER w AS done, sum(CASE WHEN n_messages > 0 THEN 1 ELSE 0 END) OVER w AS hits FROM polls WHERE try <= 400 WINDOW w AS (PARTITION BY worker ORDER BY try)),
idle AS (SELECT *, sum(CASE WHEN n_messages = 0 AND done >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY worker, hits ORDER BY try) AS quiet FROM seen),
stop AS (SELECT worker, min(try) AS stopped FROM idle WHERE quiet >= 2 GROUP BY ALL)
SELECT i.worker, i.event_id, CAST(i.n_messages AS BIGINT) AS n_messages FROM idle i LEFT JOIN stop s ON s.worker = i.worker WHERE i.n_messages > 0 AND i.hits <= 60 AND i.try < coalesce(s.stopped, 1000000)""")  # fmt: skip
def poll_samples(spark, sf):
    """Polls of a consumer benchmark, until it has its samples or has read all and gets nothing."""
    events = derive.table(spark, sf, "events")
    n = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 7).cast("long")
    polls = events.select((F.col("user_id") % 16).cast("int").alias("worker"), "event_id", "ts", n.alias("n_messages"))
    return stats.limit_polls(polls, ["worker"], ["ts", "event_id"], F.lit(150), samples=60, attempts=400, empty=2).select("worker", "event_id", "n_messages")


@query(sql("""SELECT worker, CAST(len(l) AS BIGINT) AS n, l[CAST(least(len(l) * 50 // 100, len(l) - 1) + 1 AS BIGINT)] AS p50, l[len(l)] AS max, round(len(l) / (any_value(ms) / 1000.0), 2) AS msgs_per_s FROM (
  SELECT worker, list_sort(list(us)) AS l, any_value(ms) AS ms FROM (SELECT *, greatest(max(ts_ms) OVER (PARTITION BY worker) - min(ts_ms) OVER (PARTITION BY worker), 1) AS ms, row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY worker) AS n FROM lat)
  WHERE rn > greatest(1, n // 10) GROUP BY worker) GROUP BY worker, l""", "lat"))  # fmt: skip
def bench_report(spark, sf):
    """A benchmark's report, read back from its JSON."""
    rows = derive.latencies(spark, sf)
    span = rows.groupBy("worker").agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"))
    found = stats.report(rows.join(span, "worker").withColumn("bytes", F.lit(1024)), ["worker"], "us", ["ts", "event_id"], "ms", "bytes")
    back = F.from_json("json", "worker int, n bigint, p50 bigint, max bigint, msgs_per_s double")
    return found.select(back.alias("r")).select("r.*")


@query("SELECT CAST('lines' AS VARCHAR) AS topic, CAST(0 AS INTEGER) AS \"partition\", c_name AS value FROM customer")
def text_lines(spark, sf):
    """Lines of text as records; blank ones are none."""
    path = workspace(spark, "lines")
    names = derive.table(spark, sf, "customer").select(F.explode(F.array("c_name", F.lit(""), F.lit("   "))).alias("value"))
    names.write.text(path)
    return line_records(spark, path, "lines").select(*KEYS, F.col("value").cast("string").alias("value"))


_SETTINGS = """
broker:
  id: 3
  port: 0        # zero means the default
log:
  segment_bytes: 1048576
  index_interval_bytes: 1024
  retention_ms: 3600000
group:
  session_timeout_ms: 6000
"""


@query(f"SELECT * FROM (VALUES ('broker.id', 3), ('broker.port', 9092), ('log.segment_bytes', 1048576), ('log.index_max_bytes', {max(64 << 10, (1048576 // 1024 + 1) * 16)}), ('log.retention_ms', 3600000), ('log.segment_ms', {7 * DAY_MS}), ('group.session_timeout_ms', 6000), ('replication.min_insync_replicas', 1)) v(setting, value)".replace("SELECT *", "SELECT setting, CAST(value AS BIGINT) AS value"))
def config_settings(spark, sf):
    """Settings of a file, with defaults where it says nothing or zero."""
    found = Config.from_text(_SETTINGS)
    names = ["broker.id", "broker.port", "log.segment_bytes", "log.index_max_bytes", "log.retention_ms", "log.segment_ms", "group.session_timeout_ms", "replication.min_insync_replicas"]
    return _local(spark, [(n, getattr(getattr(found, n.split(".")[0]), n.split(".")[1])) for n in names], "setting string, value long")
