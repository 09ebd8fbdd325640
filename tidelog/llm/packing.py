"""Packing into optimal length buckets.

The global histogram of token counts (aggregated by Spark) goes to the driver, where dynamic programming picks the ``buckets``
boundaries with the least padding. The histogram has one row for each distinct length: n of them need n^2 / 2 tokens, so a corpus of
10^13 tokens has 4.5 million at most, 70 MB. Each document goes to the smallest bucket that
holds it whole, and documents are numbered inside their bucket to form batches of ``budget`` padded tokens. The numbering
is two-level: rows are dealt to shards inside a bucket and numbered there, and the shards' sizes, a table of bounded
size, give where each shard begins. So a bucket that holds most rows is still spread over many tasks, and a shard that
repeated rows fill is dealt out once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize
from .pieces import PieceCounter, read_model, shared

BUCKETS = 16
BUDGET = 65_536
#: Rows that a shard should hold over all buckets, and the most shards there are.
SHARD_ROWS = 1_000
SHARDS = 65_536
#: Rows from which on a shard of four times the mean size is dealt out.
FULL = 50_000
#: Costs that the dynamic programming looks at together, about.
_COSTS = 1 << 20


def token_counts(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for each row: pieces of a public vocabulary. Null and empty texts have none.

    Each row is counted by itself, its whole text: repeated rows stay, null ids stay null, columns of other names are not read, and an
    empty table gives an empty result.
    """
    model = model or read_model()

    def run(batches):
        counter = shared(PieceCounter, model)
        for b in batches:
            n = [counter.count(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_tokens long")


def _least_costs(lo, hi, a, z, cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, first i with the least cost(i, j), that cost) for the middle j of each range lo..hi, with i from a to z and up to j."""
    j = (lo + hi) // 2
    width = np.minimum(j, z) - a + 1
    pick, least = np.empty(len(j), np.int64), np.empty(len(j))
    for some in np.split(np.arange(len(j)), np.flatnonzero(np.diff(np.cumsum(width) // _COSTS)) + 1):
        begins = np.cumsum(width[some]) - width[some]
        which = np.repeat(np.arange(len(some)), width[some])
        i = np.arange(len(which)) - begins[which] + a[some][which]
        c = cost(i, j[some][which])
        least[some] = np.minimum.reduceat(c, begins)
        hits = np.flatnonzero(c == least[some][which])
        _, first = np.unique(which[hits], return_index=True)
        pick[some] = i[hits[first]]
    return j, pick, least


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted ``lengths`` that minimise the padded total.

    cost(i, j) = lengths[j] * (rows in i..j) is Monge, so each row of the table is found by divide and conquer on the
    monotone positions of its minima, all ranges of one depth together: O(buckets * n log n).
    """
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
    best = lengths * below[1:]
    choice = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        now, picks = np.empty(n), np.empty(n, np.int64)
        before = np.concatenate([[0.0], best])
        lo, hi, a, z = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j, pick, least = _least_costs(lo, hi, a, z, lambda i, j: before[i] + lengths[j] * (below[j + 1] - below[i]))
            now[j], picks[j] = least, pick
            lo, hi, a, z = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, pick), (pick, z)))
            some = lo <= hi
            lo, hi, a, z = lo[some], hi[some], a[some], z[some]
        choice.append(picks)
        best = now
    out, j = [], n - 1
    for pick in reversed(choice):
        out.append(int(lengths[j]))
        j = int(pick[j]) - 1
        if j < 0:
            break
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "id", length: str = "n_tokens") -> DataFrame:
    """``lengths`` (key, length, more) with bucket (from 0), bucket_tokens (its bound), batch, place, padding.

    A batch of bucket b holds as many rows as fit into ``budget`` tokens when each is padded to the bound, one at
    least (a document longer than the budget is a batch of its own). A null length counts as zero. The order inside a
    bucket follows a hash of key and length; rows with both equal may stand in any order. Columns of ``lengths`` that are named like
    the new ones are replaced. An empty table gives an empty result.
    """
    lengths = materialize(lengths.withColumn("__salt", F.monotonically_increasing_id()), "lengths")
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    rows = lengths.withColumn("__n", n)
    histogram = rows.groupBy("__n").count().orderBy("__n").toPandas()
    bounds = optimal_boundaries(histogram["__n"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    total = int(histogram["count"].sum())
    edges = F.array(*[F.lit(int(x)).cast("long") for x in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    shards = min(SHARDS, max(1, -(-total // SHARD_ROWS)))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("__n"))))
    rows = rows.withColumn("bucket_tokens", F.element_at(edges, F.col("bucket") + 1)).withColumn("__hash", F.xxhash64(F.col(key), F.col("__n")))
    rows = rows.withColumn("__shard", F.pmod("__hash", F.lit(shards)).cast("int"))
    # shards that repeated rows fill: the salt, written with the table, deals them out
    full = {r["__shard"]: -(-r["count"] // FULL) for r in rows.groupBy("__shard").count().where(F.col("count") > FULL + 4 * total // shards).collect()}
    parts = F.coalesce(F.create_map(*[F.lit(x) for k, v in full.items() for x in (k, v)])[F.col("__shard")], F.lit(1)) if full else F.lit(1)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__salt"), parts).cast("int"))
    place_of = ["__shard", "__part", "bucket"]
    sizes = rows.groupBy(place_of).agg(F.count("*").alias("__size"))
    first = F.coalesce(F.sum("__size").over(W.Window.partitionBy("bucket").orderBy("__shard", "__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    begins = materialize(sizes.select(*place_of, first.alias("__begin")), "begins")
    spread = W.Window.partitionBy(place_of).orderBy("__hash", key, "__salt")
    numbered = rows.withColumn("__row", F.row_number().over(spread)).join(begins, place_of)
    place = F.col("__begin") + F.col("__row") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    kept = [c for c in lengths.columns if c.lower() not in ("__salt", "bucket", "bucket_tokens", "batch", "place", "padding")]
    return numbered.select(*kept, "bucket", "bucket_tokens", F.floor(place / room).cast("long").alias("batch"), (place % room).cast("int").alias("place"), (F.col("bucket_tokens") - F.col("__n")).alias("padding"))
