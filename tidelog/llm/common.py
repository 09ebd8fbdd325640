"""What the corpus operators share: row keys, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id: after every real one.
NO_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster, whose machines share no such folder, that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidelog.shared.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("tidelog.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, so that lost executors cost no recomputation.

    What the writing shuffled is no longer needed; the collection lets Spark delete those files.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._tidelog_path = path
    return out


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def discard(*tables: DataFrame | str) -> None:
    """Delete tables made by ``materialize``, or folders of ``shared_path``, that nothing reads any more."""
    for df in tables:
        context = SparkSession.active().sparkContext
        path = df if isinstance(df, str) else df._tidelog_path
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_key(id_col: str = "doc_id") -> Column:
    """The document id as a long; null ids come after all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def from_key(col: str) -> Column:
    """The inverse of ``id_key``."""
    return F.when(F.col(col) != NO_ID, F.col(col))


def hash_below(column: str, total: int, n: int) -> Column:
    """Whether the hash of ``column`` is among the smallest, about ``n`` of ``total`` values: a share of the hash's whole range, so it
    holds for any total."""
    top = -(2**63) + min(2**64 - 1, 2**64 * n // max(1, total))
    return F.xxhash64(column, F.lit(977)) <= F.lit(top)


def hash_sample(df: DataFrame, column: str, total: int, n: int) -> DataFrame:
    """The ``n`` rows of ``df``, which has ``total``, whose ``column`` has the smallest hash; all, if there are no more."""
    return df.where(hash_below(column, total, 2 * n)).orderBy(F.xxhash64(column, F.lit(977)), column).limit(n)


def text_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def remainder_of_id(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
