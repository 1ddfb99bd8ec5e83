"""Exact quotes in texts and one-to-one matches of equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X

GRAM = 8
#: Quotes that are searched for in every text at once.
BLOCK_QUOTES = 1000


def _with_grams(df: DataFrame, words: str, out: str) -> DataFrame:
    """df with the distinct hashes of all runs of GRAM words; each doubling is a column, so nothing is computed twice."""
    df = df.withColumn(f"{out}1", F.transform(words, lambda w: F.xxhash64(w)))
    n = 1
    while n < GRAM:
        shifted = F.slice(f"{out}{n}", F.lit(n + 1), F.greatest(F.size(f"{out}{n}") - n, F.lit(0)))
        df = df.withColumn(f"{out}{2 * n}", F.zip_with(f"{out}{n}", shifted, lambda x, y: F.xxhash64(x, y))).drop(f"{out}{n}")
        n *= 2
    whole = F.slice(f"{out}{n}", F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return df.withColumn(out, F.array_distinct(whole)).drop(f"{out}{n}")


def resolve_quotes(docs: DataFrame, quotes: DataFrame, key: str = "doc_id", text: str = "text", quote_key: str = "item_id", quote: str = "quote") -> DataFrame:
    """(key, quote_key, n, start): exact occurrences of each quote, overlapping ones counted, start of the first from 0.

    Texts and quotes meet on a hash of the quote's first GRAM whole words, so only texts that hold these are searched.
    Quotes with fewer whole words meet texts on the longest of these; quotes with none are searched for in every text,
    in blocks of about BLOCK_QUOTES.
    """
    q = quotes.select(quote_key, F.col(quote).alias("__q")).where(F.length("__q") > 0)
    # The first and the last word of a quote may be cut; those between stand whole in a text that holds it.
    inner = F.split("__q", r"\s+")
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    q = q.withColumn("__w", inner)
    long = _with_grams(q.where(F.size("__w") >= GRAM).withColumn("__w", F.slice("__w", 1, GRAM)), "__w", "__gs").withColumn("__g", F.element_at("__gs", 1)).drop("__w", "__gs")
    longest = F.array_max(F.transform("__w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    few = q.where((F.size("__w") < GRAM) & (F.size("__w") > 0)).withColumn("__one", longest).drop("__w")
    none = q.where(F.size("__w") == 0).drop("__w")
    d = docs.select(key, F.col(text).alias("__t")).where(F.col("__t").isNotNull())
    own = _with_grams(d.select(key, F.split("__t", r"\s+").alias("__w")), "__w", "__gs")
    # explode() would have the optimizer compute the array twice, for a filter on its size.
    found = own.select(key, F.explode_outer("__gs").alias("__g")).where("__g is not null").join(long, "__g").select(key, quote_key, "__q").distinct()
    if not few.isEmpty():
        single = d.select(key, F.explode(F.array_distinct(F.split("__t", r"\s+"))).alias("__one"))
        found = found.unionByName(single.join(few, "__one").select(key, quote_key, "__q"))
    pairs = found.join(d, key)
    blocks = -(-none.count() // BLOCK_QUOTES)
    for block in range(blocks):
        own = none.where(F.pmod(F.xxhash64(quote_key, "__q"), F.lit(blocks)) == block)
        pairs = pairs.unionByName(d.join(F.broadcast(own), F.contains(F.col("__t"), F.col("__q"))).select(*pairs.columns))
    hits = pairs.where(F.contains("__t", F.col("__q")))
    return hits.select(key, quote_key, X.occurrences(F.col("__t"), F.col("__q")).alias("n"), (F.instr("__t", F.col("__q")) - 1).alias("start"))


def counterparts(rows: DataFrame, side: str, a: str, b: str, content: str, ref: str) -> DataFrame:
    """(content, left_ref, right_ref): contents that stand exactly once on side a and once on side b."""
    counted = rows.where(F.col(side).isin(a, b)).groupBy(content).agg(
        F.count_if(F.col(side) == a).alias("na"), F.count_if(F.col(side) == b).alias("nb"), F.min(F.when(F.col(side) == a, F.col(ref))).alias("left_ref"), F.min(F.when(F.col(side) == b, F.col(ref))).alias("right_ref")
    )
    return counted.where("na = 1 and nb = 1").select(content, "left_ref", "right_ref")


def repeated_once(rows: DataFrame, value: list[str], order: str) -> DataFrame:
    """(value, first, second): value tuples that stand exactly twice, with the earlier and the later place."""
    return rows.groupBy(*value).agg(F.count("*").alias("__n"), F.min(order).alias("first"), F.max(order).alias("second")).where("__n = 2").drop("__n")
