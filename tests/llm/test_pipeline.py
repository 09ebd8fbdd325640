"""The pipeline's stages on a small corpus, each against what brute force says of its own input."""

import collections
import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_llm import SCHEMA, _base, _languages, _removed, _similar


def test_stages(spark, tmp_path):
    rows, syllables, make = _languages()
    rows = [(i, t + " " + make(syllables[k], 40), k, "s", 0) for i, t, k, *_ in rows]
    passage = make(syllables["aa"], 60)
    rows += [(1000 + i, make(syllables["aa"], 30) + " " + passage + " " + make(syllables["aa"], 30), "aa", "s", 0) for i in range(4)]
    rows += [(2000 + i, rows[i][1], rows[i][2], "s", 0) for i in range(10)]  # copies
    rows += [(3000, make(syllables["bb"], 50) + " password=abcdef123 " + make(syllables["bb"], 5), "bb", "s", 0), (3001, "Жили были дед и баба " * 30, None, "s", 0), (3002, None, None, None, None), (3003, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "packing"]

    def run(name, df):
        out = stages[name](spark, df, "")
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    known = run("language_id", docs)
    assert known.columns == docs.columns
    assert {r[0] for r in rows} - {r.doc_id for r in known.collect()} == {3001, 3002, 3003}

    one = run("near_dedup", known)
    want = {c for _, c in _similar([(r.doc_id, r.text) for r in known.collect()])}
    assert {r.doc_id for r in one.collect()} == want and not want & set(range(2000, 2010))

    cut = run("substring_dedup", one)
    expect = {i: (gone, kept) for i, _, gone, kept in _removed([(r.doc_id, r.text) for r in one.collect()])}
    before = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == {i: kept if gone else before[i] for i, (gone, kept) in expect.items() if kept or not gone}
    assert cut.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert sum(passage in r.text for r in cut.collect()) == 1

    safe = run("secret_scan", cut)
    assert [r.doc_id for r in safe.where("text like '%[SECRET]%'").collect()] == [3000] and not any(_base(r.text)[2] for r in safe.collect())

    packed = run("packing", safe)
    assert collections.Counter(r.doc_id for r in packed.collect()) == collections.Counter(r.doc_id for r in safe.collect())
    assert packed.where("padding < 0").count() == 0
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
