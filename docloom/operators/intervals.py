"""Half-open intervals: unions, gaps, partitions and what they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, group: list[str], start: str = "start", end: str = "end", touch: int = 0) -> DataFrame:
    """(group, start, end) of the maximal runs; intervals that meet (or lie within touch) are one run."""
    before = Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col(start) > F.max(end).over(before) + touch, F.lit(True)).cast("int")
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(Window.partitionBy(*group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def segments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, first, last) of runs of consecutive integers."""
    w = Window.partitionBy(*group).orderBy(value)
    runs = df.select(*group, value).distinct().withColumn("__run", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*group, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__run")


def gaps(covered: DataFrame, wholes: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end) of what the intervals leave uncovered of [0, size); wholes has (key, size)."""
    runs = union(covered, [key], start, end).select(key, start, end)
    edges = runs.unionByName(wholes.select(key, F.col("size").alias(start), F.col("size").alias(end)))
    before = Window.partitionBy(key).orderBy(start, end)
    left = edges.withColumn("__from", F.coalesce(F.lag(end).over(before), F.lit(0)))
    return left.where(F.col("__from") < F.col(start)).select(key, F.col("__from").alias(start), F.col(start).alias(end))


def partition(intervals: DataFrame, wholes: DataFrame, key: str, label: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, labels): [0, size) cut at every boundary; labels of the intervals over each piece, sorted.

    Pieces and intervals meet on the boundaries an interval covers, so long texts are not compared pairwise.
    """
    points = intervals.select(key, F.explode(F.array(start, end)).alias("at")).unionByName(wholes.select(key, F.explode(F.array(F.lit(0), F.col("size").cast("int"))).alias("at"))).distinct()
    w = Window.partitionBy(key).orderBy("at")
    pieces = points.withColumn("until", F.lead("at").over(w)).where("until is not null").withColumn("n", F.row_number().over(w))
    at = pieces.select(F.col(key).alias("__k"), F.col("at").alias("__at"), F.col("n").alias("first"))
    until = pieces.select(F.col(key).alias("__k"), F.col("until").alias("__until"), F.col("n").alias("last"))
    spans = intervals.join(at, (F.col(key) == F.col("__k")) & (F.col(start) == F.col("__at"))).drop("__k", "__at")
    spans = spans.join(until, (F.col(key) == F.col("__k")) & (F.col(end) == F.col("__until"))).drop("__k", "__until")
    over = spans.select(key, F.explode(F.sequence("first", "last")).alias("n"), label).groupBy(key, "n").agg(F.array_sort(F.collect_set(label)).alias("labels"))
    out = pieces.join(over, [key, "n"], "left")
    return out.select(key, F.col("at").alias(start), F.col("until").alias(end), F.coalesce("labels", F.array().cast(over.schema["labels"].dataType)).alias("labels"))


def depth(intervals: DataFrame, wholes: DataFrame, key: str, label: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, n_labels): the pieces of partition() with how many labels lie over each, by a sweep.

    Intervals of a label are first made one where they meet; then each begins and ends once, so that what nests is
    never multiplied by the pieces it covers.
    """
    point = lambda at, step: F.struct(F.col(at).cast("long").alias("at"), F.lit(step).alias("step"))
    runs = union(intervals, [key, label], start, end).select(key, F.inline(F.array(point(start, 1), point(end, -1))))
    cuts = intervals.select(key, F.inline(F.array(point(start, 0), point(end, 0))))
    whole = wholes.withColumn("__from", F.lit(0)).select(key, F.inline(F.array(point("__from", 0), point("size", 0))))
    every = runs.unionByName(cuts).unionByName(whole)
    points = every.groupBy(key, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(key).orderBy("at")
    open_ = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return points.select(key, F.col("at").alias(start), F.lead("at").over(w).alias(end), open_.alias("n_labels")).where(F.col(end).isNotNull())


def contained(inner: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The inner intervals that lie in one of the runs of the outer ones."""
    runs = union(outer, [key], start, end).select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    return inner.join(runs, (F.col(key) == F.col("__k")) & (F.col(start) >= F.col("__s")) & (F.col(end) <= F.col("__e")), "left_semi")


def outermost(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The distinct intervals that no other interval of the key holds: in order of start, those that reach past all before."""
    before = Window.partitionBy(key).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return df.select(key, start, end).distinct().withColumn("__r", reach).where(F.col("__r").isNull() | (F.col(end) > F.col("__r"))).drop("__r")
