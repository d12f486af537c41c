"""Connected components of a graph given as edges, as Spark jobs.

Alternating large-star and small-star rounds: every round hangs each vertex
on the least neighbour it knows, until only stars are left. The number of
rounds grows with the logarithm of the vertices. Minima are pre-aggregated
before the shuffle, and each round is landed, so a hub is one row on the
other side of a join and a lost executor costs one round at most. A round is
landed in as many files as the edges of the one before fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import land

FILE_EDGES = 200_000        # edges of a landed file, about


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", "m").toDF("u", "v")))


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(vertex, root): every vertex of `edges` (u, v) with the least vertex of its component.

    Vertices without an edge to another vertex are not listed. `most`, if
    known, is the most rows of `edges`, which are landed in as many files as
    those fill.
    """
    def state(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
                     .first())

    now = edges.toDF("u", "v").where("u != v").distinct()
    if most is not None:
        now = now.coalesce(max(1, -(-most // FILE_EDGES)))
    now = land(now, "edges")
    was, is_ = None, state(now)
    while is_[0] and is_ != was:
        stars = _small_star(_large_star(now)).where("u != v").distinct()
        now = land(stars.coalesce(-(-is_[0] // FILE_EDGES)), "edges")
        was, is_ = is_, state(now)
    roots = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root")).distinct()
