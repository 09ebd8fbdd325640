"""The corpus pipeline: from raw documents to length-bucketed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

Every stage takes an empty table (and gives one), null ids and null texts, repeated rows, and more columns than ``documents`` has, which pass
through whatever their names. Texts are whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid, packing, secrets, similar, substring
from tidelog.llm.common import documents, materialize


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts; the models come from a bounded sample of the labelled ones. Null texts, and those
    without a letter, go."""
    return langid.drop_rejected(docs, langid.train(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id (a null one is the largest): 0.8 or more over 5-word
    shingles. Of rows with equal id and text one stays, and one of all texts without words."""
    return similar.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more go wherever a smaller id has them too; rows of whose text nothing is left go. Rows with null ids come
    after all others and keep what they share among themselves."""
    return _measured(substring.drop_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the parts of linked credentials are masked. Null texts stay null, ids are not looked at, and no row goes."""
    return _measured(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in batches of a token budget, inside length buckets of least padding: doc_id, n_tokens, bucket, bucket_tokens, batch,
    place, padding. Null and empty texts have no tokens; null and repeated ids have a place each."""
    return packing.pack(packing.token_counts(docs)).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: Character models, fingerprints and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
