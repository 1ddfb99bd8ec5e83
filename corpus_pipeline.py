"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, tokens.

Each stage reads what its predecessor wrote, decides over all of it, and lets
its decisions take effect.  All stages but the last return the columns of the
documents table; the last adds the token ids (array<int>) and their number.

Defined results: a text without letters, a null text, or one rejected by
distance leaves at the first stage; of each component of near copies the
document with the smallest id stays; a document that shares a window with a
benchmark item leaves; personal data are masked and n_chars follows; an empty
table passes through as an empty table.  A document without an id is judged by
its text like any other, after those with ids; of repeated rows one stays; texts
may be of any length; further columns pass through, whatever their names, but
for those the last stage adds.

What a stage keeps in the shared folder goes when its result is written, and that result goes when the next one is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, jaccard, langid, pii
from docloom.llm.common import read, scratch, shared_folder
from docloom.session import remove, ship


#: Near copies of the pipeline: shingles of so many words, and the least similarity. op5_ngram_jaccard has its own contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit(docs, F.col("doc_id").isNotNull())
    return langid.drop_rejected(docs, model)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            remove(spark, [last])
        last = f"{folder}/{name}"
    return docs


#: SQL has no way to train centroids or to encode by ranks.
ORACLE_SQL = None
