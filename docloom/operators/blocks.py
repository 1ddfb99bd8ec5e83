"""Groups too large for one task: rows in order, cut into blocks that carry what came before from one to the next.

A block is a range of the whole order, so that a group of a third of all rows lies in many.  Rows are dealt out by
range once and kept in the shared folder; a block's number and rows are then the same for all that read them, also
where executors are lost in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut

#: Column that holds the number of a row's block.
BLOCK = "__block"


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the number of its block: rows of a lower block come before those of a higher one in the order of keys."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys).withColumn(BLOCK, F.spark_partition_id()))


def same_block(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """left with the other columns of right, a table of one row a group and block; null groups meet."""
    named = right.withColumnsRenamed({c: f"__of_{c}" for c in [*group, BLOCK]})
    met = F.col(BLOCK) == F.col(f"__of_{BLOCK}")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return left.join(named, met).drop(*(f"__of_{c}" for c in [*group, BLOCK]))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over the rows of the group up to this one; nulls add nothing.

    Totals of blocks are summed first, a row a block, and a row adds what precedes it in its own block.
    """
    rows = ordered(df.withColumn("__v", F.coalesce(value, F.lit(0)).cast("long")), [*group, *order])
    totals = rows.groupBy(*group, BLOCK).agg(F.sum("__v").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*group, BLOCK, F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.sum("__v").over(Window.partitionBy(*group, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return same_block(rows.withColumn("__own", own), starts, group).withColumn(out, F.col("__start") + F.col("__own")).drop("__v", "__own", "__start", BLOCK)
