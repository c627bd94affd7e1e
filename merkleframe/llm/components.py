"""Connected components by alternating large-star and small-star steps on an edge table.

Each step is an aggregate and a join, so neither links nor components ever meet in one task or in the
driver; a hub is pre-aggregated before the shuffle and its joins can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, parts_for


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), where root is the smallest node of its component.

    Null ends and loops are ignored; repeated and reversed edges count once. Raises if the rounds don't
    suffice (they grow with the logarithm of the longest path).
    """
    edges = edges.filter("u is not null and v is not null and u <> v")
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = _stamp(edges)
    parts = parts_for(stamp[0])
    for _ in range(most_rounds):
        if not stamp[0]:
            break
        edges = checkpoint(_small_star(_large_star(edges)).coalesce(parts))
        was, stamp = stamp, _stamp(edges)
        if was == stamp:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
