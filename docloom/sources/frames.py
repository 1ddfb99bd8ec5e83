"""Outputs of other programs: JSON lines, recognizer tables, metafile strings, and bounded subprocess adapters."""

from __future__ import annotations

import json
import struct
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"
MAX_OUTPUT, MAX_ERRORS, TIMEOUT = 64 << 20, 1 << 20, 120


def json_frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The complete JSON objects of line-delimited files; a broken tail is left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("f"), "value")
    return rows.where(F.json_object_keys("value").isNotNull() & F.col("f").isNotNull()).select("f.*")


def words(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Recognized words of TSV files: text as it stands, boxes as numbers; blank words and empty boxes are left out."""
    rows = spark.read.csv(path, sep="\t", header=header, schema=TSV, quote="", escape="")
    box = [F.col(c).try_cast("int").alias(c) for c in ("left", "top", "width", "height")]
    kept = rows.select(*(F.col(c).try_cast("int").alias(c) for c in ("page_num", "line_num", "word_num")), *box, F.col("conf").try_cast("double").alias("conf"), "text")
    return kept.where((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0))


class MetafileError(ValueError):
    pass


def emf_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(ordinal, type, body) of the records after the header; anything out of line is an error."""
    if len(data) < 108 or data[40:44] != b" EMF":
        raise MetafileError("not_a_metafile")
    header, total, count = struct.unpack_from("<I", data, 4)[0], *struct.unpack_from("<II", data, 48)
    if total != len(data) or not 88 <= header <= len(data) or count < 2:
        raise MetafileError("header")
    at = header
    for n in range(1, count):
        kind, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if size < 8 or size % 4 or at + size > len(data):
            raise MetafileError("record")
        yield n, kind, data[at : at + size]
        at += size
    if at != len(data) or kind != 14:
        raise MetafileError("end")


def emf_strings(data: bytes) -> list[tuple[int, str]]:
    """(ordinal, text) of stored Unicode strings, of a metafile that is whole; glyph numbers are no text and left out."""
    out = []
    for n, kind, body in emf_records(data):
        if kind == 84 and len(body) >= 76:
            chars, start, options = struct.unpack_from("<III", body, 44)
            if chars and options == 0:
                if start < 76 or start + 2 * chars > len(body):
                    raise MetafileError("string")
                out.append((n, body[start : start + 2 * chars].decode("utf-16-le")))
    return out


def strings(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, record, text) of the stored strings of metafiles; one that is not whole gives an issue row with record 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = emf_strings(data.as_py() or b"")
                except ValueError as e:
                    found = [(0, str(e))]
                made = [pa.array([k.as_py()] * len(found), batch.schema.field(0).type), pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=[key, "record", "text"])

    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, record int, text string")


def run_adapter(command: list[str], request: dict, timeout: float = TIMEOUT) -> dict:
    """One request on the input of a program, one line of JSON from its output; bounded in time and bytes, bare environment."""
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        try:
            done = subprocess.run(command, input=json.dumps(request).encode(), stdout=out, stderr=err, timeout=timeout, env={"PATH": "/usr/bin:/bin", "LC_ALL": "C.UTF-8"}, check=False)
        except subprocess.TimeoutExpired:
            return {"issue": "adapter_timeout_failed"}
        except OSError:
            return {"issue": "adapter_unavailable"}
        size = out.seek(0, 2)
        if done.returncode or size > MAX_OUTPUT or err.seek(0, 2) > MAX_ERRORS:
            return {"issue": "adapter_failed" if done.returncode else "adapter_output_limit"}
        out.seek(0)
        lines = [x for x in out.read().decode("utf-8", "replace").split("\n") if x.strip()]
    try:
        value = json.loads(lines[0]) if len(lines) == 1 else None
    except ValueError:
        value = None
    return value if isinstance(value, dict) else {"issue": "adapter_result_failed"}


def adapt(rows: DataFrame, key: str, payload: str, command: list[str], timeout: float = TIMEOUT) -> DataFrame:
    """(key, result) with the JSON answer of a program to each payload; what goes wrong is an issue in the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                answer = json.dumps(run_adapter(command, {"key": k.as_py(), "payload": text}, timeout), sort_keys=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.schema.field(0).type), pa.array([answer])], names=[key, "result"])

    return rows.select(key, payload).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, result string")
