"""Registry of the log engine's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import node_queries as _node
from . import queries as _batch
from . import stream_queries as _stream


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _batch.QUERIES | _node.QUERIES | _stream.QUERIES


def oracle_sql() -> dict[str, str]:
    return _batch.ORACLE | _node.ORACLE | _stream.ORACLE
