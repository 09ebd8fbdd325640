"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm, packing, quality, secrets, segmentation, simhash, spotsigs, substring, warc
from .common import documents, remainder_of_id


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.fit_and_identify(documents(spark, sf_dir))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = segmentation.encode_documents(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "ids", "n_pieces", "n_bytes", "log_score", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(documents(spark, sf_dir), remainder_of_id(10) != 0)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_secret_scan, op4_document_fingerprints, op5_sentencepiece, op6_substring_dedup, op7_lm_scoring, op8_warc, op9_quality_rules, op10_packing)}


#: The archives are the operator's way; what they must give back is plain SQL.
_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM r
"""


def _op3_sql() -> str:
    q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    patterns = (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.ENDPOINT, secrets.WEAK_ID, secrets.WEAK_SECRET)
    raw = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(t, {q(p)}) AS m, regexp_split_to_array(t, {q(p)}) AS g FROM d" for i, p in enumerate(patterns))
    near = lambda kinds, scope: f"EXISTS (SELECT 1 FROM {{0}} p WHERE p.doc_id = c.doc_id AND p.kind IN ({kinds}) AND p.e > c.s - {scope} AND p.s < c.e + {scope})"
    identifier, secret = near("1, 4", secrets.SCOPE).format("parts"), near("0, 2, 5", secrets.SCOPE).format("parts")
    names = "[" + ", ".join(q(k) for k in secrets.KINDS) + "]"
    listed = f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) {{}}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({raw}),
cut AS (SELECT doc_id, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
loc AS (SELECT doc_id, kind, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM cut),
sp AS (SELECT doc_id, kind, e - length(m) AS s, e FROM loc WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, {q(secrets.ASSIGN)}, 2)) >= 6
  WHEN 5 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
parts AS (SELECT * FROM sp WHERE kind < 3 UNION ALL SELECT * FROM sp c WHERE kind >= 3 AND NOT {near("0, 1, 2", 0).format("sp")}),
kept AS (SELECT * FROM parts c WHERE CASE kind WHEN 3 THEN {identifier} AND {secret} WHEN 4 THEN {secret} WHEN 5 THEN {identifier} ELSE true END)
SELECT d.doc_id, {counts}, sha256({listed.format("FILTER (kind < 3)")}) AS base_sha256, {listed.format("FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: Windows as joined words.
_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
starts AS (SELECT doc_id, l, unnest(range(1, greatest(1, len(l) - 48))) AS p FROM d WHERE len(l) >= 50),
windows AS (SELECT doc_id, p, array_to_string(l[p:p + 49], ' ') AS s FROM starts),
repeats AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM repeats, range(50) t(k)),
words AS (SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM d),
marked AS (SELECT words.*, gone.i IS NOT NULL AS removed FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i)
SELECT d.doc_id, count(m.i) AS n_words, count(*) FILTER (m.removed) AS n_removed,
  sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.i) FILTER (NOT m.removed), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": _op3_sql(), "op6_substring_dedup": _OP6_SQL, "op8_warc": _OP8_SQL}
