import pytest
from pyspark.sql import functions as F

from tidelog import schema
from tidelog.functions import codec as C
from tidelog.functions import records as R
from tidelog.functions.bytes import big_endian, from_big_endian
from tidelog.functions.hashing import crc32c, fnv1a32, murmur2
from tidelog.schema import Config, index_max_bytes

# Published vectors of the routing hash.
MURMUR2 = {b"": 590343075, b"a": 242020996, b"test": 146065218, b"kafka": 1519210584, bytes.fromhex("6d696e692d6b61666b61"): 1423008314}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_murmur2_vectors(spark):
    rows = spark.createDataFrame(list(MURMUR2.items()), "k binary, h long")
    assert rows.where(murmur2(F.col("k")) != F.col("h")).count() == 0
    assert one(spark, murmur2(F.lit(None).cast("binary"))) == (590343075,)


def _murmur2(data: bytes, seed: int = 0x973AFB51) -> int:
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = seed ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
    if rest := data[whole:]:
        h = (h ^ int.from_bytes(rest, "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return (h ^ h >> 15) & 0x7FFFFFFF


def test_hashes_of_any_bytes(spark):
    data = [bytes((i * 37 + j * 11) % 256 for j in range(i)) for i in range(40)]
    got = spark.createDataFrame([(d,) for d in data], "d binary").select("d", murmur2(F.col("d")), crc32c(F.col("d")), fnv1a32(F.col("d"))).collect()
    for d, m, c, f in got:
        fnv = 2166136261
        for b in d:
            fnv = (fnv ^ b) * 16777619 & 0xFFFFFFFF
        assert (m, c, f) == (_murmur2(bytes(d)), C.crc32c(bytes(d)), fnv)


def test_encode_matches_codec(spark):
    rows = [(42, 1000, b"test", b"hello", 0), (0, -1, None, None, 0), (2**63 - 1, 5, b"", b"", 1), (7, 2**40, b"\xff\0", b"v" * 300, -1)]
    df = spark.createDataFrame(rows, "o long, t long, k binary, v binary, a tinyint")
    got = df.select("*", R.encode_record(F.col("o"), F.col("t"), F.col("k"), F.col("v"), F.col("a")).alias("r"), R.encoded_size(F.col("k"), F.col("v")).alias("n")).collect()
    for r in got:
        k, v = (None if x is None else bytes(x) for x in (r.k, r.v))
        assert bytes(r.r) == C.encode_record(C.Record(r.o, r.t, k, v, r.a)) and r.n == len(r.r)


def test_too_large_a_record_is_null(spark):
    df = spark.range(1).select(F.repeat(F.lit("x"), (1 << 20) - 32).cast("binary").alias("v"))
    assert df.select(R.encode_record(F.lit(0), F.lit(0), F.lit(None).cast("binary"), F.col("v"))).first()[0] is None


def test_big_endian(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 255, 256]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", big_endian(F.col("v"), 8).alias("b"), from_big_endian(big_endian(F.col("v"), 8)).alias("w")).collect():
        assert bytes(r.b) == r.v.to_bytes(8, "big", signed=True) and r.w == r.v


@pytest.mark.parametrize("name, ok", [("a", True), ("A-b_c.9", True), ("", False), (".", False), ("..", False), ("...", True), ("a b", False), ("a/b", False), ("x" * 249, True), ("x" * 250, False), ("a\n", False), (None, False)])
def test_topic_names(spark, name, ok):
    assert one(spark, R.valid_topic_name(F.lit(name).cast("string"))) == (ok,)


def test_small_expressions(spark):
    assert one(spark, R.segment_file_name(F.lit(42)), R.format_latency(F.lit(12)), R.format_latency(F.lit(2500.25)), R.format_median_latency(F.lit(0.0001))) == ("0" * 18 + "42.log", "12", "2500.250", "0.000 [*]")


def test_index_sizes_and_config():
    assert [index_max_bytes(1 << 20, 64), index_max_bytes(1024, 4096), index_max_bytes(1 << 30, 1), index_max_bytes(1, 0)] == [262160, 65536, 10485760, 10485760]
    c = Config.from_dict({"broker": {"id": 7, "port": 0}, "log": {"segment_bytes": 1 << 20, "index_interval_bytes": 64}})
    assert (c.broker.id, c.broker.port, c.log.index_max_bytes, c.group.session_timeout_ms) == (7, 9092, 262160, 45_000)
    for bad in ({"log": {"segment_bytes": 1 << 32}}, {"broker": {"request_timeout_ms": -1}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


@pytest.mark.parametrize("name", ["RECORD", "LOG", "SEGMENTS", "INDEX_ENTRIES", "TOPICS", "BROKERS", "PARTITIONS", "REPLICAS", "OFFSETS", "MEMBERS", "GROUPS", "ASSIGNMENTS", "PENDING_ACKS"])
def test_schemas_parse(spark, name):
    assert spark.createDataFrame([], getattr(schema, name)).count() == 0
