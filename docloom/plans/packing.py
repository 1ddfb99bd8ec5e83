"""Folds whose next step depends on the last: packing under a budget, admission that skips, windows of text.

The result of a row depends on all before it, yet no group has to pass through one task: packing goes block by block,
each block telling first how it would go on from every state it can be entered in, and admission only folds the rows
that could be taken at all.  List counters need no fold: they count within windows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.blocks import BLOCK, ordered


def greedy_bins(sizes: Iterable[int], budget: int, most: int | None = None, used: int | None = None, n: int = 0, bin_no: int = -1) -> list[int]:
    """Bin of each item: an item opens a new bin when it would overflow the last one in size or number.

    used, n and bin_no describe the bin that is open before the first item; used is None where there is none.
    """
    used, out = budget + 1 if used is None else used, []
    for s in sizes:
        if used + s > budget or (most is not None and n >= most):
            bin_no, used, n = bin_no + 1, 0, 0
        used, n = used + s, n + 1
        out.append(bin_no)
    return out


class Passage:
    """How greedy packing passes a block of items, whatever bin is open before it.

    Only the item that opens the first new bin depends on that bin; from there on the block decides alone.  So for each
    item that can be that one, at most budget or most of them, it is enough to keep where it leads.
    """

    def __init__(self, sizes: list[int], budget: int, most: int | None):
        m, total = len(sizes), np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        at = np.arange(m)
        after = np.maximum(np.searchsorted(total, total[:-1] + budget, "right") - 1, at + 1)
        if most is not None:
            after = np.minimum(after, at + max(most, 1))
        after = np.minimum(after, m)
        leaves, bins = at.copy(), np.ones(m, np.int64)
        for i in range(m - 1, -1, -1):
            if after[i] < m:
                leaves[i], bins[i] = leaves[after[i]], bins[after[i]] + 1
        last = int(np.searchsorted(total, budget, "right"))
        if most is not None:
            last = min(last, max(most, 0) + 1)
        # Items without a size open no bin, but for the first one and where items are counted.
        first = [i for i in range(min(last, m)) if i == 0 or most is not None or sizes[i] > 0]
        self.first, self.reach = first, [int(total[i + 1]) for i in first]
        self.used, self.n = [int(total[m] - total[leaves[i]]) for i in first], [int(m - leaves[i]) for i in first]
        self.bins, self.total, self.items = [int(bins[i]) for i in first], int(total[m]), m


def leave(p: dict, budget: int, most: int | None, used: int, n: int, bin_no: int) -> tuple[int, int, int]:
    """The bin that is open behind a block with this passage, given the one before it."""
    for first, reach, u, k, bins in zip(p["first"], p["reach"], p["used"], p["n"], p["bins"], strict=True):
        if used + reach > budget or (most is not None and n + first >= most):
            return u, k, bin_no + bins
    return used + p["total"], n + p["items"], bin_no


def admitted(sizes: Iterable[int], budget: int, most: int) -> list[bool]:
    """Whether each item is taken: one that does not fit is passed by and later, smaller ones may still be."""
    out, used, n = [], 0, 0
    for s in sizes:
        take = n < most and used + s <= budget
        used, n = used + s * take, n + take
        out.append(take)
    return out


def whitespace_cuts(text: str, budget: int) -> list[tuple[int, int]]:
    """Half-open windows of at most budget characters, cut after white space where there is some."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + budget)
        if end < len(text):
            cut = max((i + 1 for i in range(end - 1, start, -1) if text[i].isspace()), default=end)
            end = cut if cut > start else end
        out.append((start, end))
        start = end
    return out


def list_counters(events: Iterable[tuple[int, int | None]], starts: dict[int, int], restarts: dict[int, bool] | None = None) -> list[int | None]:
    """Counter of each (level, explicit start) event of one list; a shallower event restarts deeper levels."""
    now: dict[int, int] = {}
    out: list[int | None] = []
    for level, start in events:
        value = start if start is not None else now[level] + 1 if level in now else starts.get(level)
        if value is None:
            now.pop(level, None)
        else:
            now[level] = value
        for deeper in [k for k in now if k > level and (restarts or {}).get(k, True)]:
            del now[deeper]
        out.append(value)
    return out


def _sorted(table: pa.Table, order: list[str]) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in order])


def _sizes(table: pa.Table, size: str) -> list[int]:
    return [s or 0 for s in table[size].to_pylist()]


def pack(df: DataFrame, group: str, order: list[str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """df with bin, by greedy packing in order within each group; a null size is 0.

    Blocks of a group are scanned at the same time: first for their passages, at most a few thousand numbers each,
    which are followed in order from block to block, then for the bins of their rows.
    """
    rows = ordered(df, [group, *order])
    kind = df.schema[group].dataType
    lists = {name: T.ArrayType(T.LongType()) for name in ("first", "reach", "used", "n", "bins")}
    passages = T.StructType([T.StructField(group, kind), T.StructField(BLOCK, T.IntegerType()), *(T.StructField(k, v) for k, v in lists.items()), T.StructField("total", T.LongType()), T.StructField("items", T.LongType())])
    entries = T.StructType([T.StructField(group, kind), T.StructField(BLOCK, T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("__used", "__n", "__bin"))])
    names = passages.names[2:]

    def passage(table: pa.Table) -> pa.Table:
        p = Passage(_sizes(_sorted(table, order), size), budget, most)
        columns = [pa.array([getattr(p, c)], pa.list_(pa.int64()) if c in lists else pa.int64()) for c in names]
        return pa.table([table[group].slice(0, 1), table[BLOCK].slice(0, 1), *columns], [group, BLOCK, *names])

    def follow(table: pa.Table) -> pa.Table:
        table = _sorted(table, [BLOCK])
        state, out = (budget + 1, 0, -1), []
        for p in table.select(names).to_pylist():
            out.append(state)
            state = leave(p, budget, most, *state)
        return pa.table([table[group], table[BLOCK], *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], entries.names)

    def bins(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted(left, order)
        used, n, bin_no = (right[c][0].as_py() for c in ("__used", "__n", "__bin"))
        found = greedy_bins(_sizes(left, size), budget, most, used, n, bin_no)
        return left.drop_columns([BLOCK]).append_column("bin", pa.array(found, pa.int64()))

    opened = rows.groupBy(group, BLOCK).applyInArrow(passage, passages).groupBy(group).applyInArrow(follow, entries)
    schema = T.StructType([*df.schema.fields, T.StructField("bin", T.LongType())])
    return rows.groupBy(group, BLOCK).cogroup(opened.groupBy(group, BLOCK)).applyInArrow(bins, schema)


def admit(df: DataFrame, group: str, order: list[str], size: str, budget: int, most: int) -> DataFrame:
    """df with taken, by admission in order within each group; a null size is 0, equal rows are taken from the first on.

    A row with `most` rows before it in its group that are of its own size is never taken: either they all were, or one
    of them did not fit and neither does the row.  The others, at most `most` of each size up to the budget, are folded.
    """
    s = F.coalesce(F.col(size), F.lit(0)).cast("long")
    identity = list(dict.fromkeys([group, *order]))
    place = F.row_number().over(Window.partitionBy(F.col(group), F.col("__size")).orderBy(*order))
    rows = df.select(*identity, s.alias("__size")).where(F.col("__size") <= budget)
    could = rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table, [*order, "__size"])
        return table.filter(pa.array(admitted(table["__size"].to_pylist(), budget, most), pa.bool_()))

    taken = could.groupBy(group).applyInArrow(run, could.schema).groupBy(*identity, "__size").agg(F.count("*").alias("__taken"))
    named = taken.withColumnsRenamed({c: f"__of_{c}" for c in [*identity, "__size"]})
    met = F.col("__size") == F.col("__of___size")
    for c in identity:
        met = met & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    same = F.row_number().over(Window.partitionBy(*identity, "__size").orderBy(F.lit(0)))
    marked = df.withColumn("__size", s).withColumn("__same", same).join(named, met, "left")
    return marked.select(*df.columns, F.coalesce(F.col("__same") <= F.col("__taken"), F.lit(False)).alias("taken"))


def count_lists(df: DataFrame, group: str, order: list[str], level: str, starts: dict[int, int]) -> DataFrame:
    """df with counter, by the list levels of each group in order; the counter of a level restarts behind each shallower one."""
    counter = F.lit(None).cast("int")
    upto = Window.rowsBetween(Window.unboundedPreceding, 0)
    for at, start in starts.items():
        # Counters of a level belong to one run: what stands between two shallower events.
        run = f"__run_{at}"
        df = df.withColumn(run, F.sum((F.col(level) < at).cast("int")).over(upto.partitionBy(group).orderBy(*order)))
        own = F.sum((F.col(level) == at).cast("int")).over(upto.partitionBy(group, run).orderBy(*order))
        counter = F.when(F.col(level) == at, (own + (start - 1)).cast("int")).otherwise(counter)
    return df.withColumn("counter", counter).drop(*(f"__run_{at}" for at in starts))
