"""Decisions as tables: what may be bound, replayed, bridged, packed or shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(choices: DataFrame, key: str) -> DataFrame:
    """choices with independent: whether the key has no other choice; the others stay to be seen."""
    return choices.withColumn("independent", F.count("*").over(Window.partitionBy(key)) == 1)


def replay(saved: DataFrame, current: DataFrame, key: str, fingerprint: str, value: str) -> DataFrame:
    """(key, outcome) of saved decisions: stale for another fingerprint, changed for another value, gone, or replayed."""
    now = current.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__f"), F.col(value).alias("__v"))
    met = saved.join(now, F.col(key) == F.col("__k"), "left")
    outcome = F.when(F.col("__k").isNull(), "gone").when(F.col("__f") != F.col(fingerprint), "stale").when(~F.col("__v").eqNullSafe(F.col(value)), "changed").otherwise("replayed")
    return met.select(key, outcome.alias("outcome"))


def bridged(tables: DataFrame, document: str, order: str, qualifies: Column) -> DataFrame:
    """(first, second) of each qualifying table and the next one, across those that do not qualify."""
    kept = tables.where(qualifies)
    nxt = F.lead(order).over(Window.partitionBy(document).orderBy(order))
    return kept.select(F.col(order).alias("first"), nxt.alias("second")).where("second is not null")


def extended_context(regions: DataFrame, cited: DataFrame, region: str, refs: str, ref: str) -> DataFrame:
    """regions with the cited refs that their lists lack put behind, in order and once."""
    more = cited.groupBy(region).agg(F.array_sort(F.collect_set(ref)).alias("__more"))
    return regions.join(more, region, "left").withColumn(refs, F.array_union(F.col(refs), F.coalesce("__more", F.array().cast(regions.schema[refs].dataType)))).drop("__more")


def unknown_keys(objects: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object outside the allowed ones, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_except(F.json_object_keys(objects), F.array(*map(F.lit, allowed)))), ",")


def missing_keys(objects: Column, required: tuple[str, ...]) -> Column:
    return F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(objects))), ",")


def explicit_bindings(values: DataFrame, texts: DataFrame, key: str, raw: str, text: str) -> DataFrame:
    """(key, raw, start, end) of raw values that stand exactly once in their text."""
    met = values.join(texts, key)
    n = F.when(F.length(raw) > 0, (F.length(text) - F.length(F.replace(F.col(text), F.col(raw), F.lit("")))) / F.length(raw)).otherwise(0)
    start = F.instr(text, F.col(raw)) - 1
    # An occurrence that overlaps the first counts too, so the text after its first character is searched again.
    again = F.contains(F.substring(F.col(text), start + 2, F.length(text)), F.col(raw))
    return met.where((n >= 1) & ~again).select(key, raw, start.alias("start"), (start + F.length(raw)).alias("end"))


def shown_text(kind: Column, value: Column, formula: Column, raw: Column, text: Column) -> Column:
    """The text that stands for a cell: a formula's expression, a stored value, its raw form, else the unit's text."""
    return F.coalesce(F.when(kind == "formula", formula), F.when(kind.isin("string", "integer", "number", "boolean"), value), raw, text)


def output_budget(ids: Column, blocks: Column, cap: int) -> Column:
    """Tokens that an answer over so many ids and blocks may take."""
    return F.least(F.lit(cap), 128 + 12 * ids + 8 * blocks)


def grid_cells(rows: DataFrame, columns: DataFrame, page: str) -> DataFrame:
    """(page, r, c, left, top, right, bottom) of each pair of neighbouring row and column lines of one page.

    Lines are at most a few hundred a page, and pages are the join's key.
    """
    edges = lambda df, a, b: df.withColumn(b, F.lead(a).over(Window.partitionBy(page).orderBy(a))).where(F.col(b).isNotNull())
    number = lambda df, a, n: df.withColumn(n, F.row_number().over(Window.partitionBy(page).orderBy(a)) - 1)
    down = number(edges(rows.select(page, F.col("at").alias("top")).distinct(), "top", "bottom"), "top", "r")
    across = number(edges(columns.select(page, F.col("at").alias("left")).distinct(), "left", "right"), "left", "c")
    return down.join(across, page).select(page, "r", "c", "left", "top", "right", "bottom")


def tables_and_fields(cells: DataFrame, table: str, budget: int) -> DataFrame:
    """(table, n_rows, n_cols, n_cells, chars, shown): shapes of tables, and whether each fits a budget of cells."""
    shape = cells.groupBy(table).agg(
        (F.max(F.col("row")) + 1).alias("n_rows"), (F.max(F.col("col")) + 1).alias("n_cols"), F.count("*").alias("n_cells"), F.sum(F.length("value")).alias("chars")
    )
    return shape.withColumn("shown", F.col("n_cells") <= budget)


def packed_is_smaller(rows: Column, columns: Column, overhead: int) -> Column:
    """Whether the columnar form of a payload, with its instructions, is shorter."""
    return F.length(columns) + overhead < F.length(rows)
