"""Every query of the log engine against its oracle SQL, on the smallest tables."""

import math
import os

import pytest

from tidelog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def _rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_streams_equal_batch(spark):
    q = registry.queries()
    for stream, batch in (("stream_group_state", "group_state_fold"), ("stream_isr", "isr_fold")):
        assert sorted(map(tuple, q[stream](spark, SF).collect()), key=repr) == sorted(map(tuple, q[batch](spark, SF).collect()), key=repr)


@pytest.mark.parametrize("shift", [0, 52_767, 2_152_484, -2_142_484])
def test_primitives_take_low_bytes_of_large_keys(spark, duck, tmp_path, shift):
    """Keys past what 8, 16 and 32 bits hold, on both sides."""
    duck.execute(f"COPY (SELECT c_custkey + {shift} - 75 AS c_custkey, c_name FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    got = registry.queries()["codec_primitives"](spark, str(tmp_path))
    found = duck.execute(f"WITH customer AS (SELECT * FROM '{tmp_path}/customer.parquet') " + registry.oracle_sql()["codec_primitives"])
    names = [d[0] for d in found.description]
    assert _rows(got.columns, got.collect()) == _rows(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
