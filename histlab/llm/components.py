"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: (node, root), root being the smallest node reachable.

    Nodes without edges do not occur. Each round replaces the edges by ones to the smallest
    neighbour and is written to shared storage; the number of rounds grows with the logarithm
    of the longest path. Minima are aggregated before the join back, so no neighbourhood is
    ever gathered in one place. Loops and repeated edges make no difference.
    """
    current = materialize(_large_to_small(edges.where("u <> v")), "stars")
    state = _state(current)
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_large_to_small(large), "stars-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(_large_to_small(small.unionByName(least.select("u", F.col("m").alias("v")))), "stars")
        release(large)
        release(current)
        current, before = small, state
        state = _state(current)
        if state == before:
            break
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_to_small(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
