"""Records from decided tables: values with evidence, merged regions, continuations, scopes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X


def records(cells: DataFrame, roles: DataFrame, columns: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, record, key, value, source): cells of data rows under the decided column keys, records counted from 0."""
    data = roles.where(F.col("role") == "data").select(table, "row")
    numbered = data.withColumn("record", F.row_number().over(Window.partitionBy(table).orderBy("row")) - 1)
    return cells.join(numbered, [table, "row"]).join(columns, [table, "col"]).select(table, "record", "key", "value", "source")


def role_issues(cells: DataFrame, roles: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, row, code): observed rows without a role, or with an unresolved one."""
    seen = cells.select(table, "row").distinct()
    met = seen.join(roles, [table, "row"], "left")
    code = F.when(F.col("role").isNull(), "row_role_missing").when(F.col("role") == "unresolved", "row_role_unresolved")
    return met.select(table, "row", code.alias("code")).where("code is not null")


def combine(values: DataFrame, path: list[str], order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The first value of each path, and (path, n): paths whose later writers gave another value."""
    w = Window.partitionBy(*path).orderBy(*order)
    first = values.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    lost = values.groupBy(*path).agg(F.count_distinct(value).alias("n")).where("n > 1")
    return first, lost


def continue_tables(left: DataFrame, right: DataFrame, pairs: DataFrame, table: str = "table_id") -> DataFrame:
    """(table, record, position, value): rows of the right table of each pair (left, right) stand after the left's.

    Columns are matched by position; records of the right are counted on from those of the left.
    """
    size = left.groupBy(table).agg((F.max("record") + 1).alias("__size"))
    moved = right.join(pairs.select(F.col("right").alias(table), F.col("left").alias("__left")), table)
    moved = moved.drop(table).withColumnRenamed("__left", table).join(size, table, "left")
    moved = moved.withColumn("record", F.col("record") + F.coalesce("__size", F.lit(0))).drop("__size")
    return left.unionByName(moved)


def duplicate_tables(rows: DataFrame, table: str, order: list[str], content: Column) -> DataFrame:
    """(first, other): tables whose ordered rows are all equal to those of an earlier table.

    Tables meet on a digest of their rows; rows are digested before they are gathered.
    """
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.sha2(content, 256).alias("h")))), lambda r: r["h"]), ","), 256)
    sums = rows.groupBy(table).agg(digest.alias("d"))
    first = sums.groupBy("d").agg(F.min(table).alias("first"))
    return sums.join(first, "d").where(F.col(table) > F.col("first")).select("first", F.col(table).alias("other"))


def scope_apply(targets: DataFrame, pointers: DataFrame, scope: str = "scope", pointer: str = "pointer") -> DataFrame:
    """targets with each pointer equal to or below their scope; prefixes are exploded, so it is an equi join."""
    spread = pointers.withColumn("__p", F.explode(X.pointer_prefixes(F.col(pointer))))
    return targets.join(spread, targets[scope] == spread["__p"]).drop("__p")


def covers(handles: DataFrame, handle: str = "handle", pointer: str = "pointer") -> DataFrame:
    """(a, b): all pointers of handle b lie under pointers of another handle a."""
    size = handles.groupBy(handle).agg(F.count_distinct(pointer).alias("n"))
    spread = handles.select(F.col(handle).alias("b"), F.col(pointer).alias("bp"), F.explode(X.pointer_prefixes(F.col(pointer))).alias("p"))
    under = spread.join(handles.select(F.col(handle).alias("a"), F.col(pointer).alias("p")), "p").where("a <> b")
    met = under.groupBy("a", "b").agg(F.count_distinct("bp").alias("m"))
    return met.join(size.withColumnRenamed(handle, "b"), "b").where("m = n").select("a", "b")


def unused(required: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return required.join(used, on, "left_anti")


def constant_columns(cells: DataFrame, group: str, column: str, value: str) -> DataFrame:
    """(group, column, value): columns whose every row of a group has the same, non-null value."""
    rows = cells.groupBy(group).agg(F.count_distinct("row").alias("rows"))
    per = cells.groupBy(group, column).agg(F.count(value).alias("n"), F.count_distinct(value).alias("d"), F.min(value).alias(value))
    return per.join(rows, group).where("d = 1 and n = rows").select(group, column, value)


def component_names(df: DataFrame, group: str, key: str, at: str, limit: int = 120) -> DataFrame:
    """df with name: the key, and for keys that occur more than once in a group a suffix with their place."""
    many = F.count("*").over(Window.partitionBy(group, key)) > 1
    suffix = F.concat(F.lit("__column_"), F.col(at).cast("string"))
    return df.withColumn("name", F.when(many, F.concat(F.substring(F.col(key), F.lit(1), limit - F.length(suffix)), suffix)).otherwise(F.substring(F.col(key), F.lit(1), F.lit(limit))))


def sticky_empty(fragments: DataFrame, owner: str, n: Column, uncertain: Column) -> DataFrame:
    """(owner, uncertain): owners whose fragments hold no record at all; uncertainty of any stays."""
    return fragments.groupBy(owner).agg(F.sum(n).alias("__n"), F.bool_or(uncertain).alias("uncertain")).where("__n = 0").drop("__n")


def repeat_signature(kind: Column, targets: Column, scope: Column) -> Column:
    """Identity of a statement: kind, set of targets, set of scopes."""
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), F.array_sort(targets).alias("targets"), F.array_sort(scope).alias("scope"))), 256)


def revision_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed or kept entities of two revisions."""
    a, b = old.select(F.col(key).alias("__a"), F.col(digest).alias("__x")), new.select(F.col(key).alias("__b"), F.col(digest).alias("__y"))
    met = a.join(b, F.col("__a") == F.col("__b"), "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__x") == F.col("__y"), "kept").otherwise("changed")
    return met.select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


def many_owners(cited: DataFrame, entry: str, owner: str) -> DataFrame:
    """(entry, n_owners): entries that cite sources of more than one owner."""
    return cited.groupBy(entry).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def route(read: Column, unresolved: Column, definition: Column, open_rows: Column) -> Column:
    """record_value, unresolved, definition or scalar_region of a cell, in this order of precedence."""
    return F.when(read & ~unresolved, "record_value").when(read, "unresolved").when(definition, "definition").when(open_rows, "unresolved").otherwise("scalar_region")


def resolve_rows(ranges: DataFrame, rows: DataFrame, key: str, row: str) -> DataFrame:
    """(key, asked, found, complete) of ranges (key, first, last) over the rows that exist."""
    asked = ranges.select(key, F.explode(F.sequence("first", "last")).alias(row))
    met = asked.join(rows.select(key, row, F.lit(1).alias("__hit")).distinct(), [key, row], "left")
    return met.groupBy(key).agg(F.count("*").alias("asked"), F.count("__hit").alias("found")).withColumn("complete", F.col("asked") == F.col("found"))


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def all_accepted(views: DataFrame, node: str, accepted: Column) -> DataFrame:
    return views.groupBy(node).agg(F.every(accepted).alias("read"))


def continuation_candidates(tables: DataFrame, document: str, order: str, native: str, columns: str) -> DataFrame:
    """(first, second, confirmed): consecutive tables, confirmed if one native table, else with equal columns."""
    w = Window.partitionBy(document).orderBy(order)
    same = F.lead(native).over(w) == F.col(native)
    met = tables.select(F.col(order).alias("first"), F.lead(order).over(w).alias("second"), same.alias("confirmed"), (F.lead(columns).over(w) == F.col(columns)).alias("__fit"))
    return met.where(F.col("second").isNotNull() & (F.col("confirmed") | F.col("__fit"))).drop("__fit")


def nonrecord(roles: DataFrame, table: str) -> DataFrame:
    """(table, nonrecord, notes): only notes, subtotals and blanks with one of the first two; only notes and blanks."""
    r = F.col("role")
    return roles.groupBy(table).agg(
        (F.every(r.isin("note", "subtotal", "blank")) & F.bool_or(r.isin("note", "subtotal"))).alias("nonrecord"), (F.every(r.isin("note", "blank")) & F.bool_or(r == "note")).alias("notes")
    )
