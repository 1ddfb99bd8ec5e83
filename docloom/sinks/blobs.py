"""Content-addressed storage: bodies once, links by owner, restoring with proof, and versioned results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(rows: DataFrame, owner: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(digest, body) once each, and (owner, digest)."""
    addressed = rows.select(owner, F.sha2(F.col(body), 256).alias("digest"), F.col(body).alias("body"))
    return addressed.select("digest", "body").dropDuplicates(["digest"]), addressed.select(owner, "digest").distinct()


def prune(stored: DataFrame, links: DataFrame) -> DataFrame:
    """The blobs that something links to."""
    return stored.join(links.select("digest").distinct(), "digest", "left_semi")


def restore(links: DataFrame, stored: DataFrame, at: str = "digest") -> DataFrame:
    """links (at, digest) with body and proven: whether the body found there has the digest."""
    return links.join(stored, at, "left").withColumn("proven", F.coalesce(F.sha2("body", 256) == F.col("digest"), F.lit(False)))


def next_revision(results: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """results with revision: one more than the old result of the key, or 1."""
    before = old.select(key, F.col("revision").alias("__r"))
    return results.join(before, key, "left").withColumn("revision", F.coalesce(F.col("__r"), F.lit(0)) + 1).drop("__r")


def write_text(df: DataFrame, path: str, group: str, content: str) -> None:
    """One text record for each row, in folders by group."""
    df.select(group, F.col(content).alias("value")).write.partitionBy(group).text(path)
