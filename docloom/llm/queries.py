"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, html_extract, jaccard, langid, pii, quality_model, quality_rules, sharding, warc
from docloom.llm.common import held_out, id_crc, read

#: The rank file of the BPE query.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digests(read(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels, id_crc() % 5 != 0)
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, id_crc() % 3 != 1)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def capture_records(pages: DataFrame) -> DataFrame:
    """WARC-like records of the pages table, which has none of its own.

    Each page gives a response, but every eleventh gives only a revisit; two more revisits of each page's URL
    follow, up to 100,000 minutes later; every seventh second revisit has another ETag.
    """
    body = F.coalesce("html", F.lit(""))
    tag = F.substring(F.sha2(body, 256), 1, 16)
    minute = lambda n: F.timestamp_seconds((n * 60).cast("long"))
    one = F.struct(
        (F.col("page_id") * 3).alias("record_id"), F.when(F.col("page_id") % 11 == 0, "revisit").otherwise("response").alias("type"), minute(F.col("page_id")).alias("ts"), tag.alias("etag")
    )
    two = F.struct((F.col("page_id") * 3 + 1).alias("record_id"), F.lit("revisit").alias("type"), minute(F.col("page_id") + (F.col("page_id") * 7919) % 100000).alias("ts"), tag.alias("etag"))
    other = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("x"), tag)).otherwise(tag)
    three = F.struct((F.col("page_id") * 3 + 2).alias("record_id"), F.lit("revisit").alias("type"), minute(F.col("page_id") + (F.col("page_id") * 104729) % 100000).alias("ts"), other.alias("etag"))
    rows = pages.select("url", "html", F.explode(F.array(one, two, three)).alias("r")).select("url", "r.*", F.when(F.col("r.type") == "response", F.col("html")).alias("body"))
    shown = F.to_utc_timestamp("ts", F.current_timezone()).cast("string")  # in UTC, whatever the session's zone
    headers = F.create_map(F.lit("date"), shown, F.lit("server"), F.concat(F.lit("s"), (F.col("record_id") % 5).cast("string")))
    none = F.lit(None).cast("string")
    return rows.select("record_id", "type", "url", "ts", "etag", none.alias("last_modified"), none.alias("digest"), headers.alias("headers"), "body")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = capture_records(read(spark, sf_dir, "pages"))
    found = warc.attach_payload(warc.resolve_revisits(records.drop("body")), records, ["body"])
    return found.select(
        "record_id",
        "curl",
        "status",
        "source_id",
        F.col("headers")["date"].alias("header_date"),
        F.col("headers")["server"].alias("header_server"),
        F.length("body").cast("long").alias("body_chars"),
        F.sha2("body", 256).alias("body_sha256"),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(read(spark, sf_dir, "documents"), 24)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.fit(quality_rules.trusted(docs, labels)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_quality_classifier, op3_language_id, op4_warc_revisits, op5_ngram_jaccard, op6_sharding, op7_bpe, op8_pii, op9_decontamination, op10_quality_rules)
}

_CURL = r"""
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(v, '^([^/?]*)', 1)), ':(80|443)$', '') ||
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '^[^/?]*', ''),
    '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g'), '^$', '')
"""

OP4_SQL = rf"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, url, substr(sha256(coalesce(html, '')), 1, 16) AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://(www\.)?', '') AS v FROM pages),
canon AS (SELECT page_id, html, tag, {_CURL} AS curl FROM base),
rec AS (
  SELECT page_id * 3 AS record_id, CASE WHEN page_id % 11 = 0 THEN 'revisit' ELSE 'response' END AS type, page_id AS m, tag AS etag, curl, html FROM canon
  UNION ALL SELECT page_id * 3 + 1, 'revisit', page_id + (page_id * 7919) % 100000, tag, curl, html FROM canon
  UNION ALL SELECT page_id * 3 + 2, 'revisit', page_id + (page_id * 104729) % 100000, CASE WHEN page_id % 7 = 0 THEN 'x' || tag ELSE tag END, curl, html FROM canon),
near AS (
  SELECT r.record_id, max({{'m': s.m, 'id': s.record_id}}) AS best FROM rec r JOIN rec s
  ON r.curl = s.curl AND s.type = 'response' AND r.type = 'revisit' AND (s.m < r.m OR (s.m = r.m AND s.record_id < r.record_id)) GROUP BY r.record_id),
judged AS (
  SELECT r.*, s.record_id AS sid, s.html AS shtml,
    CASE WHEN r.type = 'response' THEN 'full' WHEN s.record_id IS NULL THEN 'unresolved' WHEN s.etag <> r.etag THEN 'mismatch' ELSE 'resolved' END AS status
  FROM rec r LEFT JOIN near n ON r.record_id = n.record_id LEFT JOIN rec s ON s.record_id = n.best.id)
SELECT record_id, curl, status, CASE WHEN status = 'resolved' THEN sid END AS source_id,
  strftime(make_timestamp(m * 60000000), '%Y-%m-%d %H:%M:%S') AS header_date,
  's' || CAST((CASE WHEN status = 'resolved' THEN sid ELSE record_id END) % 5 AS VARCHAR) AS header_server,
  CASE status WHEN 'full' THEN length(html) WHEN 'resolved' THEN length(shtml) END AS body_chars,
  CASE status WHEN 'full' THEN sha256(html) WHEN 'resolved' THEN sha256(shtml) END AS body_sha256
FROM judged
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.s, e.b FROM reach r JOIN both_ways e ON r.t = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT s, min(t) AS c FROM reach GROUP BY s) r ON r.s = d.doc_id
"""

OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM il)),
ks AS (SELECT DISTINCT k FROM il),
dg AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hits AS (SELECT DISTINCT doc_id, item_id, i, k FROM dg JOIN win USING (k, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op4_warc_revisits": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op9_decontamination": OP9_SQL}
