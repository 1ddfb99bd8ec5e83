"""The registered queries over whole tables of the smallest size: columns, rows, SQL, brute force and held-out accuracy."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
from docloom.llm import bpe, pii, queries
from tests.llm.test_texts import base_spans, counted

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_extraction": "page_id url text n_chars",
    "op2_quality_classifier": "doc_id held_out score predicted",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_warc_revisits": "record_id curl status source_id",
    "op5_ngram_jaccard": "doc_id n_shingles component_id",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}
RESULTS = {}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name):
    if name not in RESULTS:
        RESULTS[name] = entry.queries()[name](spark, FOLDER).collect()
    return RESULTS[name]


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    wanted = COLUMNS[name].split()
    assert df.columns[: len(wanted)] == wanted
    table = "pages" if name.startswith(("op1_", "op4_")) else "documents"
    n = duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    assert len(rows(spark, name)) == n * (3 if name.startswith("op4_") else 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    cols = sorted(queries.QUERIES[name](spark, FOLDER).columns)
    ours = sorted(repr([r[c] for c in cols]) for r in rows(spark, name))
    theirs = sorted(repr(list(r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]}) q").fetchall())
    assert ours == theirs


def test_digests_equal_brute_force(spark, docs):
    enc = bpe.encoding(bpe.load_ranks(queries.RANKS), public_tokenizers.PATTERN)
    for r in rows(spark, "op7_bpe"):
        ids = enc.encode_ordinary(docs[r["doc_id"]]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]]["text"] or "").encode()).hexdigest()
    for r in rows(spark, "op8_pii"):
        spans = base_spans(docs[r["doc_id"]]["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert [r["n_" + k] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    for r in rows(spark, "op10_quality_rules"):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(docs[r["doc_id"]]["text"] or "")


def test_held_out_folds_and_accuracy(spark, docs):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = []
    for r in rows(spark, "op2_quality_classifier"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        if r["held_out"] and r["doc_id"] in quality:
            good.append(r["predicted"] == quality[r["doc_id"]])
    assert sum(good) >= 0.9 * len(good)
    right = []
    for r in rows(spark, "op3_language_id"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert sum(right) >= 0.97 * len(right)


def test_pipeline_is_registered(spark):
    found = entry.queries()["pipeline"](spark, FOLDER)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids))
