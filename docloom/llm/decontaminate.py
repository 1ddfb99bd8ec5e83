r"""Benchmark decontamination by winnowing; DataFrame functions only.

A word is a maximal run of digits, Latin letters and characters beyond ASCII,
with A-Z lower-cased.  The hashes of all K-word grams of a text are winnowed:
of every W hashes in a row the smallest is kept.  Two texts that share a span of
K + W - 1 words, which is WINDOW, keep a common hash inside it, so no shared
span of WINDOW words is missed.

1. One pass over the documents splits their words, counts and winnows them; the
   kept hashes go to the shared folder and are joined with those of the items.  A
   document with a common hash is a candidate.
2. Hits are extended in candidate documents only, the only ones whose words are
   split again: their WINDOW-word spans are joined with the distinct windows of
   the items on a 64-bit hash of the words, and the words themselves are
   compared.  The items of a window are looked up once for each document and window.

Items of fewer than WINDOW words are one window of their own length; for each
such length (nine at most) the documents' grams of that length are joined in
place of kept hashes.

Document rows are told apart by (id, row) where row is a hash of the text, so
repeated ids with other texts are kept apart and repeated rows get equal
results.  The items' side is broadcast while it has at most BROADCAST_ROWS
rows, else joined by a shuffle; candidates likewise.

Defined results: a null text has no words; a document or item without words has
no hits; items that repeat under one id count once; an item with a null item_id
marks words like any other, but is not counted or listed; an item_id is listed as
a string; a null doc_id is treated like any other value, here and where rows are
dropped; empty tables give no hits; texts may be of any length; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, cut

WINDOW = 10
K = 6
W = WINDOW - K + 1

# Fixed value: what separates words; capitals are letters here and lower-cased word by word.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, an empty array for null; capitals beyond A-Z stay."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    # lower() is much cheaper than translate(), and the same within ASCII.
    return F.transform(parts, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _with_runs(df: DataFrame, source: str, lengths: Iterable[int], join: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """df with columns OUT_N: join over every run of N neighbours of the source array, for each N of lengths.

    Runs double in length from column to column, each a column of its own so that nothing is computed twice.
    Where a run would leave the array, join gets null on the right.
    """
    made = {1: source}
    keep = list(df.columns)

    def step(n: int) -> None:
        nonlocal df
        if n not in made:
            half = 1 << ((n - 1).bit_length() - 1)
            step(half)
            step(n - half)
            df = df.withColumn(f"{out}_{n}", F.zip_with(F.col(made[half]), _shift(F.col(made[n - half]), half), join))
            made[n] = f"{out}_{n}"

    for n in lengths:
        step(n)
    return df.select(*keep, *(F.col(made[n]).alias(f"{out}_{n}") for n in lengths))


def _mix(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)  # skips the nulls beyond the end


def with_grams(df: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """df (with words w) and columns g_N: hashes of all runs of N words of w."""
    lengths = list(lengths)
    df = _with_runs(df.withColumn("hashes", F.transform("w", lambda w: F.xxhash64(w))), "hashes", lengths, _mix, "g")
    for n in lengths:
        df = df.withColumn(f"g_{n}", F.slice(f"g_{n}", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0))))
    return df.drop("hashes")


def with_kept(df: DataFrame) -> DataFrame:
    """df (with g_K) and column kept: the distinct smallest hashes of every W grams in a row; of fewer, of all."""
    return _with_runs(df, f"g_{K}", [W], _least, "m").withColumn("kept", F.array_distinct(f"m_{W}")).drop(f"m_{W}")


# Arrays are exploded by explode_outer() and a filter behind it: for explode() the optimizer puts a filter on the array's
# size before it, and so computes the whole array twice.


def _placed(n: int) -> Callable[[Column, Column], Column]:
    return lambda h, i: F.struct(h.alias("h"), F.lit(n).alias("len"), (i + 1).alias("at"))


def _print(n: int) -> Callable[[Column], Column]:
    return lambda h: F.struct(h.alias("h"), F.lit(n).alias("len"))


def spans(df: DataFrame, lengths: Iterable[int], when: Callable[[int], Column] | None = None) -> DataFrame:
    """A row (h, len, at, words) for each run of words of the given lengths; when limits a length to some rows."""
    lengths, keep = list(lengths), [c for c in df.columns if c != "w"]
    df = with_grams(df, lengths)
    parts = []
    for n in lengths:
        part = F.transform(f"g_{n}", _placed(n))
        parts.append(part if when is None else F.when(when(n), part).otherwise(F.filter(part, lambda _: F.lit(False))))
    df = df.select(*keep, "w", F.explode_outer(F.concat(*parts)).alias("s")).where("s is not null")
    return df.select(*keep, F.col("s.h").alias("h"), F.col("s.len").alias("len"), F.col("s.at").alias("at"), F.slice("w", F.col("s.at"), F.col("s.len")).alias("words"))


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """df kept in the shared folder, and whether it may be broadcast."""
    df = cut(df)
    return df, df.count() <= BROADCAST_ROWS


def _join(left: DataFrame, right: DataFrame, small: bool, on: list[str] | str, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if small else right, on, how)


def _null_safe(left: DataFrame, right: DataFrame, small: bool, how: str) -> DataFrame:
    """left joined with right on (key, row); right's other columns follow."""
    l, r = left.alias("l"), (F.broadcast(right) if small else right).alias("r")
    out = l.join(r, F.col("l.row").eqNullSafe(F.col("r.row")) & F.col("l.key").eqNullSafe(F.col("r.key")), how)
    return out if how in ("left_semi", "left_anti") else out.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in ("key", "row")))


def _found(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Of docs (key, row, text) and items (item, text): (key, row, n_words) of all rows, (key, row, n_hit) of the contaminated ones,
    (key, row, item_ids) of those that hold named items, and whether the last two may be broadcast."""
    items = items.select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own_length = lambda n: F.size("w") == n if n < WINDOW else F.size("w") >= WINDOW
    named = cut(spans(items, range(1, WINDOW + 1), own_length).select("item", "h", "len", F.col("words").alias("window")).distinct())
    windows, few_windows = _small(named.select("h", "len", "window").distinct())
    short = sorted(r["len"] for r in windows.where(F.col("len") < WINDOW).select("len").distinct().collect())
    # Prints: (hash, 0) for kept hashes, (hash, length) for short items.
    kept = with_kept(with_grams(items.where(F.size("w") >= WINDOW).select("w"), [K])).select(F.explode_outer("kept").alias("h"), F.lit(0).alias("len")).where("h is not null")
    prints, few_prints = _small(kept.unionByName(windows.where(F.col("len") < WINDOW).select("h", "len")).distinct())

    own = with_kept(with_grams(docs.select("key", "row", words(F.col("text")).alias("w")), sorted({K, *short})))
    kinds = [F.transform("kept", _print(0)), *(F.transform(F.array_distinct(f"g_{n}"), _print(n)) for n in short)]
    first = cut(own.select("key", "row", F.size("w").cast("long").alias("n_words"), F.concat(*kinds).alias("prints")))
    met = first.select("key", "row", F.explode("prints").alias("p")).select("key", "row", "p.h", "p.len")
    candidates, few = _small(_join(met, prints, few_prints, ["h", "len"], "left_semi").select("key", "row").distinct())

    # Extension: words are split behind the join, so that only those of candidates are.
    marked = _null_safe(docs, candidates, few, "left_semi").select("key", "row", words(F.col("text")).alias("w"))
    hits = cut(_join(spans(marked, [*short, WINDOW]), windows, few_windows, ["h", "len"]).where(F.col("words") == F.col("window")).select("key", "row", "at", "len", "h", "window").distinct())
    covered = hits.select("key", "row", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("at")).distinct()
    per_doc, few_found = _small(covered.groupBy("key", "row").agg(F.count("*").alias("n_hit")))
    of_window = named.where("item is not null")
    listed = _join(hits.select("key", "row", "h", "len", "window").distinct(), of_window, of_window.count() <= BROADCAST_ROWS, ["h", "len", "window"])
    per_item = listed.groupBy("key", "row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    return first.select("key", "row", "n_words"), per_doc, per_item, few_found


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: the key, n_words, n_hit, n_items and item_ids (sorted strings)."""
    counted, per_doc, per_item, few = _found(_keyed(docs, key, text), items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")))
    out = _null_safe(_null_safe(counted, per_doc, few, "left"), per_item, few, "left")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that share a window with an item, whatever their ids; each row is judged by its own text."""
    _, hit, _, few = _found(_keyed(docs, key, text), items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")))
    rows = F.xxhash64(F.coalesce(F.col(f"l.{text}"), F.lit("")))
    l, r = docs.alias("l"), (F.broadcast(hit) if few else hit).alias("r")
    return l.join(r, rows.eqNullSafe(F.col("r.row")) & F.col(f"l.{key}").eqNullSafe(F.col("r.key")), "left_anti")


def digests(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    found = contamination(docs, items, key, text, item_key, item_text)
    return found.select(key, "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
