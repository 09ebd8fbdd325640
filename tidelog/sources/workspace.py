"""Where queries keep files of their own: the folder that the session names for all machines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster, whose machines share
    no such folder, that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tidelog/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read from there, for plans that would compute it for each use."""
    path = workspace(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path
