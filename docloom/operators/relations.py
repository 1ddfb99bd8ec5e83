"""Context by order: neighbours, latest heading, nearest table, declared identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, partition: list[str], order: list[str], value: str, stop: Column | None = None, reach: int = 2) -> DataFrame:
    """df with before_1.. and after_1..: values of up to reach rows each side; a stop row ends the search on its side."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("__stop", stop if stop is not None else F.lit(False))
    for name, step in (("before", F.lag), ("after", F.lead)):
        free = F.lit(True)
        for i in range(1, reach + 1):
            free = free & ~F.coalesce(step("__stop", i).over(w), F.lit(False))
            out = out.withColumn(f"{name}_{i}", F.when(free, step(value, i).over(w)))
    return out.drop("__stop")


def inherited(df: DataFrame, partition: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the latest non-null value at or before each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nearest(df: DataFrame, partition: list[str], order: list[str], marked: Column, value: str, before: str, after: str) -> DataFrame:
    """df with the value of the nearest marked row strictly before and strictly after each row."""
    w = Window.partitionBy(*partition).orderBy(*order)
    picked = F.when(marked, F.col(value))
    return df.withColumn(before, F.last(picked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(after, F.first(picked, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def unique_token_join(left: DataFrame, right: DataFrame, token: str, left_ref: str, right_ref: str) -> DataFrame:
    """(token, left_ref, right_ref) where a positive token stands once on each side."""
    once = lambda df, ref: df.where(F.col(token) > 0).groupBy(token).agg(F.count("*").alias("__n"), F.min(ref).alias(ref)).where("__n = 1").drop("__n")
    return once(left, left_ref).join(once(right, right_ref), token)


def resolve_references(refs: DataFrame, bodies: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The references with their bodies, and those without one."""
    return refs.join(bodies, on), refs.join(bodies, on, "left_anti")


def outline_certain(df: DataFrame, partition: list[str], order: str, level: str, ref: str, deepest: int = 9) -> DataFrame:
    """df with parent: of a heading the latest heading of a smaller level with no smaller-or-equal one between; of others the latest heading.

    One running value for each level: a heading of level k hides those of k and deeper before it.
    """
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for k in range(1, deepest + 1):
        # The latest heading at level k or above; it counts for level k only if it is of level k.
        out = out.withColumn(f"__h{k}", F.last(F.when(F.col(level) <= k, F.struct(F.col(level).alias("l"), F.col(ref).alias("r"))), ignorenulls=True).over(w))
    parent = F.lit(None).cast(df.schema[ref].dataType)
    for k in range(1, deepest + 1):
        own = F.when(F.col(f"__h{k}.l") == k, F.col(f"__h{k}.r"))
        parent = F.when(own.isNotNull() & (F.col(level).isNull() | (F.col(level) > k)), own).otherwise(parent)
    return out.withColumn("parent", parent).drop(*(f"__h{k}" for k in range(1, deepest + 1)))
