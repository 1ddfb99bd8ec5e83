"""Connected components by alternating large-star and small-star steps.

Each step moves edges towards the smallest node seen; the edges end as stars
whose centres are the smallest nodes of their components.  The number of rounds
grows with the logarithm of the longest path.  A node of very many edges is met
only by partial aggregates and by joins that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) with v < u are stars: no u has two of them or is another's v. No round changes them then."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is its smallest node. Nodes without edges are left out."""
    a, b = edges.columns[:2]
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _are_stars(now):
        last, now = now, cut(_small_star(_large_star(now)))
        discard(last)
    out = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()))
    discard(now)
    return out
