r"""WARC records: reading and not-modified revisit resolution.

A revisit record says "as before": it has headers and validators but no body.
resolve_revisits() joins it as of its date to the latest earlier full response
of the same canonical URL, checks the validators and merges headers:

* status "resolved": an earlier response exists and no validator disagrees
  (payload digest, ETag, Last-Modified; one that either side lacks says nothing);
* status "mismatch": the latest earlier response has another validator;
* status "unresolved": there is no earlier response;
* status "full": the record is a response itself.

A 304 answer may only update the headers of UPDATABLE; all others come from the
response.

The as-of join never gathers the records of a URL: records are cut into blocks
of BLOCK_SECONDS of time, the latest response of each (URL, block) is found by
a partial aggregate, and a window runs over blocks, then over the records of one
block.  Only keys and validators take part; bodies are joined at the end by
record id (attach_payload).

Defined results: a null URL, date or id never matches (status "unresolved" for
a revisit); "earlier" is before in date, or in record id where dates tie;
repeated rows are kept and get equal results; a record of another type is
passed by; empty tables give empty tables; columns of the records are carried
by attach_payload(), and its own output columns replace those of equal name.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import map_arrow

BLOCK_SECONDS = 3600

# Header fields that a 304 answer sends to update a stored response.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and "www." dropped, host in lower case, default port, fragment, tracking parameters and last slashes dropped."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i)https?://(www\.)?", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"&{2,}", "&")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\?&", "?"), r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"/+(\?|$)", "$1")
    return F.concat(host, rest)


_KEYS = ("record_id", "type", "url", "ts", "etag", "last_modified", "digest", "headers")


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per response and revisit record: record_id, type, curl (canonical URL), ts, status, source_id, headers.

    records has record_id (orderable), type, url, ts (timestamp), etag, last_modified, digest (strings) and
    headers (map of lower-case names to values).
    """
    r = records.select(*_KEYS).where(F.col("type").isin("response", "revisit"))
    r = r.withColumn("curl", canonical_url(F.col("url"))).drop("url")
    r = r.withColumn("block", F.floor(F.unix_timestamp("ts") / block_seconds))
    placed = F.col("curl").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    full = F.when((F.col("type") == "response") & placed, F.struct("ts", "record_id", "etag", "last_modified", "digest"))
    # The latest response before each block of a URL, from one row a block.
    last = r.where(placed).groupBy("curl", "block").agg(F.max(full).alias("last"))
    earlier = Window.partitionBy("curl").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("curl", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # Within a block; equal rows see the same earlier rows, since the frame ends before their key.
    inside = Window.partitionBy("curl", "block").orderBy(F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("__full").isNotNull(), F.col("__full")), ignorenulls=True).over(inside)
    near = r.withColumn("__full", full).withColumn("__near", own).drop("__full")
    joined = near.join(carried, ["curl", "block"], "left")
    source = F.coalesce("__near", "carried")
    differs = lambda name: F.coalesce(F.col(name) != F.col(f"__source.{name}"), F.lit(False))
    joined = joined.withColumn("__source", F.when((F.col("type") == "revisit") & placed, source))
    status = (
        F.when(F.col("type") == "response", "full")
        .when(F.col("__source").isNull(), "unresolved")
        .when(differs("digest") | differs("etag") | differs("last_modified"), "mismatch")
        .otherwise("resolved")
    )
    return joined.select("record_id", "type", "curl", "ts", status.alias("status"), F.when(status == "resolved", F.col("__source.record_id")).alias("source_id"), "headers")


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those of UPDATABLE that the revisit sends in place of its own."""
    new = F.map_filter(F.coalesce(revisit, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*UPDATABLE))
    old = F.map_filter(F.coalesce(response, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(old, new)


def attach_payload(resolved: DataFrame, records: DataFrame, payload: list[str]) -> DataFrame:
    """resolved with the payload columns and merged headers of each record's source (its own, for a response)."""
    # A column of zeros that the optimizer can't fold keeps the salt below a join key, dealt out as bodies are already.
    bodies = records.where(F.col("type") == "response").withColumn("__zero", F.col("record_id").isNull().cast("long")).dropDuplicates(["record_id", "__zero"])
    bodies = bodies.select(F.col("record_id").alias("__id"), "__zero", F.col("headers").alias("__headers"), *(F.col(c) for c in payload))
    wanted = F.coalesce("source_id", F.when(F.col("type") == "response", F.col("record_id")))
    # Records that want no body are spread by a salt, which a body never has, or they would all meet in one task.
    salt = F.when(wanted.isNull(), 1 + F.pmod(F.xxhash64("record_id", "curl", "ts"), F.lit(1 << 20))).otherwise(F.lit(0))
    rest = resolved.drop(*payload).withColumn("__wanted", wanted).withColumn("__salt", salt)
    out = rest.join(bodies, (rest["__wanted"] == bodies["__id"]) & (rest["__salt"] == bodies["__zero"]), "left")
    merged = F.when(F.col("status") == "resolved", merge_headers(F.col("__headers"), F.col("headers"))).otherwise(F.col("headers"))
    return out.withColumn("headers", merged).drop("__id", "__headers", "__wanted", "__salt", "__zero")


def _open(path: str) -> pa.NativeFile:
    """The file as a stream, at its place in a shared file system; nothing of it is read ahead of what is asked for."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem().open_input_stream("/" + (rest or path).lstrip("/"), compression=None)
    system, place = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(place, compression=None)


def _parse(stream: BinaryIO) -> Iterator[dict]:
    """The records of one stream; one record is held at a time."""
    plain = io.BufferedReader(stream)
    opened = gzip.GzipFile(fileobj=plain) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
    with io.BufferedReader(opened) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "0")
            block = f.read(int(length) if length.isdigit() else 0)
            start, _, body = block.partition(b"\r\n\r\n")
            http, status = {}, None
            if start.startswith(b"HTTP/"):
                first, *lines = start.decode("utf-8", "replace").split("\r\n")
                status = first.split(" ")[1] if " " in first else None
                http = {n.strip().lower(): v.strip() for n, s, v in (x.partition(":") for x in lines) if s}
            else:
                body = block
            yield {
                "record_id": head.get("warc-record-id"),
                "type": head.get("warc-type"),
                "url": head.get("warc-target-uri"),
                "date": head.get("warc-date"),
                "http_status": status,
                "etag": http.get("etag"),
                "last_modified": http.get("last-modified"),
                "digest": head.get("warc-payload-digest"),
                "headers": list(http.items()),
                "body": None if head.get("warc-type") == "revisit" else body,
            }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (plain or gzip, one member a record or in all).

    Spark lists the files and never loads them; a task opens its files as streams, so that their size has no bound and
    a task holds a few records at a time.  An empty file has no records.
    """
    kind = pa.schema([(n, pa.string()) for n in ("record_id", "type", "url", "date", "http_status", "etag", "last_modified", "digest")] + [("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _parse(_open(file)):
                    rows.append(row)
                    held += len(row["body"] or b"")
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    schema = "record_id string, type string, url string, date string, http_status string, etag string, last_modified string, digest string, headers map<string,string>, body binary"
    raw = spark.read.format("binaryFile").load(path).select("path")
    return map_arrow(raw, run, schema).withColumn("ts", F.to_timestamp("date"))
