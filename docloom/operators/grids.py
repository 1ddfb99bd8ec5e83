"""Spanned table cells: grids, headers, merges, rows, columns.

A cell has (table, row, col, row_span, col_span) counted from 0, and a source reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NATIVE = ("native_structure", "native_html", "markdown_table_tokens")


def grid(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """cells with a row for each coordinate they cover: columns r and c are added."""
    rows = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    return cells.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))


def conflicts(cells: DataFrame, source: str, table: str = "table_id") -> DataFrame:
    """(table, r, c, n): coordinates that more than one cell covers."""
    return grid(cells, table).groupBy(table, "r", "c").agg(F.count_distinct(source).alias("n")).where("n > 1")


def merge_covered(points: DataFrame, merges: DataFrame, on: str, block: int = 64) -> DataFrame:
    """The points (on, row, col) inside a merge (on, r0, r1, c0, c1) but not at its origin.

    Both sides meet by blocks of rows, so a large sheet is not compared with all its merges.
    """
    m = merges.withColumn("__b", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor(F.col("r1") / block))))
    m = m.select(F.col(on).alias("__on"), "__b", "r0", "r1", "c0", "c1")
    p = points.withColumn("__b", F.floor(F.col("row") / block))
    inside = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    origin = (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))
    met = p.alias("p").join(m.alias("m"), (F.col(f"p.{on}") == F.col("m.__on")) & (F.col("p.__b") == F.col("m.__b")) & inside & ~origin, "left_semi")
    return met.drop("__b")


def declared_header(is_header: Column, basis: Column) -> Column:
    """A header mark is a declaration only where the table's basis is native."""
    return F.coalesce(is_header, F.lit(False)) & basis.isin(*NATIVE)


def fixed_header_rows(cells: DataFrame, declared: Column, table: str = "table_id") -> DataFrame:
    """(table, row): rows whose every cell, those that span it included, is a declared header."""
    rows = cells.withColumn("__d", declared).withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
    return rows.groupBy(table, F.col("r").alias("row")).agg(F.every("__d").alias("__all")).where("__all").drop("__all")


def effective_roles(cells: DataFrame, headers: DataFrame, roles: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, row, role): header rows are "header"; the others take the role list of their table by position."""
    observed = cells.select(table, "row").distinct()
    rest = observed.join(headers, [table, "row"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy(table).orderBy("row")) - 1)
    listed = rest.join(roles, [table, "at"], "left").select(table, "row", F.coalesce("role", F.lit("unresolved")).alias("role"))
    return headers.select(table, "row", F.lit("header").alias("role")).unionByName(listed)


def column_headers(cells: DataFrame, declared: Column, separator: str = " / ", table: str = "table_id", text: str = "value") -> DataFrame:
    """(table, c, n_headers, path): per column the declared headers above it, joined in row and column order."""
    width = cells.groupBy(table).agg(F.max(F.col("col") + F.col("col_span")).alias("w"))
    columns = width.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    heads = cells.where(declared).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    listed = heads.groupBy(table, "c").agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col(text).alias("t")))).alias("hs"))
    out = columns.join(listed, [table, "c"], "left")
    return out.select(table, "c", F.coalesce(F.size("hs"), F.lit(0)).alias("n_headers"), F.coalesce(F.array_join(F.transform("hs", lambda h: h["t"]), separator), F.lit("")).alias("path"))


def blank_conflicts(cells: DataFrame, roles: DataFrame, table: str = "table_id", text: str = "value") -> DataFrame:
    """(table, row, cols): rows called blank that hold text; cols lists where."""
    called = roles.where(F.col("role") == "blank").select(table, "row")
    held = cells.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return held.join(called, [table, "row"]).groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_set("col")), lambda c: c.cast("string")), ",").alias("cols"))


def cell_status(unresolved: Column, raw: Column, bound: Column, basis: Column) -> Column:
    """uncertain, blank, present or absent of a cell."""
    return F.when(bound & unresolved, "uncertain").when(bound & (raw == ""), "blank").when(bound, "present").when(basis == "native_structure", "absent").otherwise("uncertain")


def preferred_binding(bindings: DataFrame, source: str, mode: str = "source") -> DataFrame:
    """One binding for each source: by the mode's paths, whole text first, then earliest, longest, smallest id.

    bindings has (source, path, start, end, role, binding_id).
    """
    paths = {
        "formula": ["/semantic/value/formula"],
        "cached": ["/semantic/value/cachedValue/raw", "/semantic/value/cachedValue/value"],
        "text": ["/text"],
        "source": ["/semantic/value/raw", "/semantic/value/value", "/semantic/value/formula", "/text"],
    }[mode]
    rank = F.array_position(F.array(*map(F.lit, paths)), F.col("path"))
    usable = (rank > 0) & ((F.col("path") != "/text") | F.col("role").isin("content", "cell"))
    order = Window.partitionBy(source).orderBy(rank, F.col("start").isNotNull(), F.coalesce("start", F.lit(0)), -F.coalesce("end", F.lit(0)), "binding_id")
    return bindings.where(usable).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def permitted_reads(cells: DataFrame, kinds: dict[str, Column], table: str = "table_id") -> DataFrame:
    """(table, col, kinds): the kinds that every cell of a column can be read as, sorted and comma-joined."""
    every = [F.every(F.coalesce(c, F.lit(False))).alias(f"k_{k}") for k, c in kinds.items()]
    found = cells.groupBy(table, "col").agg(*every)
    names = F.array_compact(F.array(*(F.when(F.col(f"k_{k}"), F.lit(k)) for k in sorted(kinds))))
    return found.select(table, "col", F.array_join(names, ",").alias("kinds"))


def expectation_errors(cells: DataFrame, plan: DataFrame, table: str = "table_id") -> DataFrame:
    """plan rows (table, row, col, expected) whose cell has other text, with found; null where there is no cell."""
    at = [table, "row", "col"]
    met = plan.join(cells.select(*at, F.col("value").alias("found")), at, "left")
    return met.where(~F.col("found").eqNullSafe(F.col("expected")))


def edit_collisions(plan: DataFrame, cells: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, source, n): physical cells that more than one planned edit reaches, through any place they cover."""
    covered = grid(cells, table).select(table, F.col("r").alias("row"), F.col("c").alias("col"), "source")
    return plan.join(covered, [table, "row", "col"]).groupBy(table, "source").agg(F.count("*").alias("n")).where("n > 1")
