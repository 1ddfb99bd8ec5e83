"""Files of any known format as ordered units: routing by name and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.units import classify
from docloom.sources import hwp, packages

def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, media_type, adapter, status, byte_size, sha256, content); a binary document named as a package is read as one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select("path", classify(name).alias("k"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
    binary = F.substring("content", 1, 8) == F.lit(hwp.MAGIC)
    adapter = F.when((F.col("k.adapter") == "hwpx") & binary, "hwp5").otherwise(F.col("k.adapter"))
    return out.select("path", "k.extension", "k.media_type", adapter.alias("adapter"), "k.status", "byte_size", "sha256", "content")


def extract(files: DataFrame) -> DataFrame:
    """(path, ordinal, unit_type, content, ...) of the files whose adapter reads packages or binary documents."""
    return packages.units(files.where(F.col("adapter").isin(*packages.READERS)))
