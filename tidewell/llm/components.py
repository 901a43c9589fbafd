"""Connected components of a graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed

#: Alternating stars halve the depth of every tree, so this many rounds settle any graph that fits a cluster.
MAX_ROUNDS = 60
#: Nodes with more edges than this, and than their share of all edges lets so many nodes have, are heavy.
HEAVY_EDGES, HEAVY_NODES = 1000, 100_000


def components(edges: DataFrame, heavy_edges: int = HEAVY_EDGES) -> DataFrame:
    """The smallest node that each node of ``edges`` (a, b: long) can reach.

    Returns ``node, component``, one row per node that has an edge to another
    node.  Alternates large-star and small-star steps until the edges form
    stars; every round ends in a checkpoint, so lost executors repeat one round
    at most.  Sums and minima are combined before each shuffle.  The edges of a
    node that has very many stay where they are: its minimum goes to them, and no
    task gets them all.
    """
    edges = checkpointed(_ordered(edges))
    before = None
    count = edges.count()
    for _ in range(MAX_ROUNDS):
        least = max(heavy_edges, 2 * count // HEAVY_NODES)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b", least).where("b > a").select(F.least("a", "m").alias("a"), "b")
        large = checkpointed(_ordered(large))
        joined = _with_least(large, "b", "a", least)
        small = joined.select(F.col("m").alias("a"), F.when(F.col("a") != F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"))
        small = small.union(joined.where("a <> m").groupBy("b").agg(F.min("m").alias("a")).select("a", "b"))
        edges = checkpointed(_ordered(small))
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == before:
            break
        before, count = after, after[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _with_least(edges: DataFrame, key: str, other: str, least: int) -> DataFrame:
    """Each edge with the least neighbour ``m`` of its ``key``; heavy keys are at most 2 / ``least`` of the edges."""
    low = edges.groupBy(key).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("degree"))
    heavy = checkpointed(low.where(F.col("degree") > least).select(key, "m"))
    if heavy.isEmpty():
        return edges.join(low.drop("degree"), key)
    heavy = F.broadcast(heavy)
    light = edges.join(heavy, key, "left_anti").join(low.where(F.col("degree") <= least).drop("degree"), key)
    return light.unionByName(edges.join(heavy, key))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
