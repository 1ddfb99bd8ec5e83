"""Issue semantics, coverage of four dimensions, completeness, review seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("text_content", "structure", "visual_content", "reading_order")


def _any(code: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(code, F.lit(p))
    return out


def dimension(code: Column, severity: Column) -> Column:
    """The dimension an issue bears on by default; null where an observation bears on none."""
    visual = _any(code, "image", "visual", "metafile")
    observed = (code == "office_image_without_text") | (severity == "info")
    return (
        F.when(code == "reading_order_unverified", "reading_order")
        .when(observed, F.when(_any(code, "image"), "visual_content"))
        .when(visual, "visual_content")
        .when(_any(code, "shape", "layout", "list_marker", "structure", "object_type"), "structure")
        .otherwise("text_content")
    )


def impact(code: Column, severity: Column) -> Column:
    """What an issue means by default; rules hold in this order."""
    where = dimension(code, severity)
    return (
        F.when(code == "reading_order_unverified", "reading_order_unverified")
        .when((code == "office_image_without_text") | (severity == "info"), "observation")
        .when(_any(code, "budget", "limit", "truncated") | F.endswith(code, F.lit("range_pending")), "processing_limit")
        .when(_any(code, "unsupported"), "unsupported_feature")
        .when(F.endswith(code, F.lit("failed")) | F.endswith(code, F.lit("unavailable")), "operational_failure")
        .when(where == "visual_content", "visual_uninterpreted")
        .when((where == "structure") | F.endswith(code, F.lit("partial")) | F.endswith(code, F.lit("unresolved")), "structure_gap")
        .otherwise("content_gap")
    )


def coverage(docs: DataFrame, issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, n_units, ordered, declared) with the four dimensions; issues has (key, impact, dimension)."""
    seen = F.col("impact") == "observation"
    of = lambda d: F.col("dimension") == d
    flags = issues.groupBy(key).agg(
        *(F.bool_or(of(d) & ~seen).alias(f"hit_{d}") for d in DIMENSIONS), F.bool_or(of("visual_content") & seen).alias("seen_visual"), F.count("*").alias("n_issues")
    )
    met = docs.join(flags, key, "left")
    hit = lambda d: F.coalesce(F.col(f"hit_{d}"), F.lit(False))
    base = F.when(F.col("n_units") > 0, "complete").otherwise("partial")
    met = met.withColumn("text_content", F.when(hit("text_content"), "partial").otherwise(base))
    met = met.withColumn("structure", F.when(hit("structure"), "partial").otherwise(base))
    met = met.withColumn("visual_content", F.when(hit("visual_content"), "partial").when(F.coalesce("seen_visual", F.lit(False)), "unverified").otherwise("not_applicable"))
    met = met.withColumn("reading_order", F.when(hit("reading_order"), "unverified").when(F.col("ordered"), "complete").otherwise("unverified"))
    alone = (F.col("declared") == "partial") & (F.coalesce("n_issues", F.lit(0)) == 0) & ~F.array_contains(F.array("text_content", "structure", "visual_content", "reading_order"), "partial")
    met = met.withColumn("text_content", F.when(alone, "partial").otherwise(F.col("text_content")))
    return met.drop(*(f"hit_{d}" for d in DIMENSIONS), "seen_visual", "n_issues")


def merge_coverage(left: Column, right: Column) -> Column:
    """One dimension of two profiles: partial wins, then unverified; not_applicable yields."""
    return F.when((left == "partial") | (right == "partial"), "partial").when((left == "unverified") | (right == "unverified"), "unverified").when(left == "not_applicable", right).when(right == "not_applicable", left).otherwise("complete")


def completeness(*dimensions: Column) -> Column:
    return F.when(F.array_contains(F.array(*dimensions), "partial"), "partial").otherwise("complete")


def review_seal(items: DataFrame, decisions: DataFrame, on: list[str], criteria: list[str]) -> DataFrame:
    """items with sealed: a decision for exactly this content exists and meets all criteria."""
    ok = F.lit(True)
    for c in criteria:
        ok = ok & F.col(c)
    good = decisions.where(ok).select(*on).distinct().withColumn("__ok", F.lit(True))
    return items.join(good, on, "left").withColumn("sealed", F.coalesce("__ok", F.lit(False))).drop("__ok")


def decision_errors(decisions: DataFrame, inventory: DataFrame, key: str, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """(key, error): decisions missing, unknown, repeated or outside the vocabulary."""
    n = decisions.groupBy(key).agg(F.count("*").alias("__n"), F.every(F.col(value).isin(*allowed)).alias("__ok"))
    met = inventory.select(F.col(key).alias("__i")).distinct().join(n, F.col("__i") == F.col(key), "full")
    error = F.when(F.col(key).isNull(), "missing").when(F.col("__i").isNull(), "unknown").when(F.col("__n") > 1, "repeated").when(~F.col("__ok"), "vocabulary")
    return met.select(F.coalesce(F.col("__i"), F.col(key)).alias(key), error.alias("error")).where("error is not null")
