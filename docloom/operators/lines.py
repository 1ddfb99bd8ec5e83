"""Lines, paragraphs, chunks and what is measured on them.

Arrays are exploded by the outer forms with a filter behind: before the inner ones the optimizer puts a filter on the
array's size, and so computes the array twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.blocks import running_sum

#: Code points of a unit beyond which it is cut into numbered chunks.
CHUNK = 50_000


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, content, offset, blank): every line, with its offset in code points of the raw text.

    Lengths are taken before the window, so contents are only dealt out where they are asked for.
    """
    parts = df.where(F.col(text).isNotNull()).select(key, F.posexplode_outer(F.split(text, "\n")).alias("line", "content")).where("line is not null")
    parts = parts.withColumn("__n", F.length("content") + 1).withColumn("blank", F.trim("content") == "")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long")).select(key, "line", "content", "offset", "blank")


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    r"""(key, paragraph from 1, content): the text split at blank lines, empty parts left out but counted."""
    return df.select(key, F.posexplode_outer(F.split(text, r"\n\s*\n")).alias("paragraph", "content")).select(key, (F.col("paragraph") + 1).alias("paragraph"), "content").where(F.length(F.trim("content")) > 0)


def chunked(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """(key, chunk from 1, content, split): parts of size code points; split marks texts of more than one."""
    parts = df.select(key, F.posexplode_outer(X.chunks(F.col(text), size)).alias("chunk", "content"), (F.length(text) > size).alias("split"))
    return parts.where("chunk is not null").withColumn("chunk", F.col("chunk") + 1)


def continued(df: DataFrame, identity: list[str], chunk: str, order: list[str], partition: list[str]) -> Column:
    """Whether a row's chunk follows the chunk of the row before, which is otherwise the same unit.

    Where the order begins with columns of the identity, rows of one unit stand together, so that a unit is a group of
    its own and no window holds a whole partition.
    """
    together = []
    for c in order:
        if c not in identity:
            break
        together.append(c)
    w = Window.partitionBy(*partition, *together).orderBy(*order)
    same = F.lag(chunk).over(w) + 1 == F.col(chunk)
    for c in identity:
        if c not in together:
            same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return F.coalesce(same, F.lit(False))


def bounded_text(df: DataFrame, group: str, order: list[str], text: str, limit: int, separator: str = "\n\n") -> DataFrame:
    """(group, content, truncated): texts joined in order up to limit code points, cut inside the last one.

    A running length, taken in blocks, finds the rows that count before any text is gathered, so a group never holds
    more than limit; of a text only its first limit code points travel.  Null texts are empty.
    """
    gap = len(separator)
    whole = F.coalesce(F.col(text), F.lit(""))
    # Every text is preceded by a separator here, the first one too: its place is what the sums begin below.
    rows = df.select(group, *order, F.left(whole, F.lit(limit)).alias("__t"), (F.length(whole) + gap).alias("__n"))
    rows = running_sum(rows, [group], order, F.col("__n"), "__sum").withColumn("__end", F.col("__sum") - gap)
    start = F.col("__end") - F.col("__n")
    full = rows.groupBy(group).agg((F.max("__end") > limit).alias("truncated"))
    joint = F.when(start >= 0, separator).otherwise("")
    piece = F.substring(F.concat(joint, F.col("__t")), F.lit(1), (limit - F.greatest(start, F.lit(0))).cast("int"))
    kept = rows.where(start < limit).select(group, F.struct(*order, piece.alias("piece")).alias("p"))
    joined = kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("content"))
    other = full.withColumnRenamed(group, "__g")
    return joined.join(other, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def pages(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """The rows from offset on, limit at most, in order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_rows(df: DataFrame, group: list[str], order: list[str | Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def budget_prefix(df: DataFrame, group: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows in order while their running cost, summed in blocks, stays within the budget; costs are not negative."""
    return running_sum(df, group, order, cost, "__sum").where(F.col("__sum") <= budget).drop("__sum")


def runs(df: DataFrame, group: str, order: str, key: str, content: str, separator: str = " ") -> DataFrame:
    """(group, line from 0, key, content): consecutive rows of equal key, joined in order."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__new", new).withColumn("line", F.sum("__new").over(w) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(content).alias("__c")))), lambda r: r["__c"]), separator)
    return numbered.groupBy(group, "line").agg(F.min(key).alias(key), joined.alias("content"))
