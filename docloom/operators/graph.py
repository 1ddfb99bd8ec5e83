"""Relations as edges: components, reduction, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut, discard


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each component, by label passing with shortcuts.

    Each round a node takes the least label around it, then the label of its label, so rounds grow with the
    logarithm of a path's length; state is kept in the shared checkpoint folder after each round.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct())
    labels = both.groupBy("u").agg(F.least("u", F.min("v")).alias("l"))
    before = None
    while True:
        least = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        moved = labels.join(least, "u").select("u", F.least("l", "m").alias("l"))
        jump = moved.select(F.col("u").alias("l"), F.col("l").alias("far"))
        last, labels = labels, cut(moved.join(jump, "l", "left").select("u", F.least("l", F.coalesce("far", "l")).alias("l")))
        now = labels.agg(F.sum(F.xxhash64("u", "l").cast("decimal(38,0)"))).first()[0]
        discard(last)
        if now == before:
            discard(both)
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
        before = now


def transitive_reduction(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges that no path of two edges implies.

    For each edge the way round is looked for among the edges that leave its start or those that enter its end,
    whichever are fewer, so that a node of many edges both ways does not multiply them.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    leaving, entering = e.groupBy("a").agg(F.count("*").alias("out")), e.groupBy("b").agg(F.count("*").alias("into"))
    sized = e.join(leaving, "a").join(entering, "b")
    by_start = sized.where("out <= into").select("a", "b").join(e.toDF("a", "m"), "a").join(e.toDF("m", "b"), ["m", "b"], "left_semi")
    by_end = sized.where("out > into").select("a", "b").join(e.toDF("m", "b"), "b").join(e.toDF("a", "m"), ["a", "m"], "left_semi")
    implied = by_start.select("a", "b").unionByName(by_end.select("a", "b")).distinct()
    return e.join(implied, ["a", "b"], "left_anti").toDF(a, b)
