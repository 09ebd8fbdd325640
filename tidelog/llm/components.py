"""Connected components of a graph that no single machine could hold.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
the number of rounds grows with the logarithm of the longest path. Each half round aggregates the smallest neighbour
of each node with map-side combining, writes it, and joins it back, so that Spark can split a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _rewire(edges: DataFrame, lows: DataFrame) -> DataFrame:
    return edges.join(lows, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
    new = _rewire(both, lows).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    out = materialize(new, "star")
    discard(lows)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = materialize(down.groupBy("u").agg(F.min("v").alias("low")), "low")
    moved = _rewire(down, lows).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    out = materialize(moved.union(lows.select("u", F.col("low").alias("v"))).distinct(), "star")
    discard(lows)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, undirected) to (node, root): every node of an edge, with the smallest node it reaches.

    Self links and repeated edges change nothing; an empty table gives an empty one.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        large = _large_star(edges)
        small = _small_star(large)
        discard(edges, large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
