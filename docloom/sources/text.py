"""Plain text and Markdown files as ordered units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_NOTE = re.compile(r"^\[\^([^\]]+)\]:\s*(.*)$")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, content): UTF-8 files, bad bytes replaced, cut at blank lines."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    parts = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n\s*\n")).alias("at", "content"))
    return parts.where(F.length(F.trim("content")) > 0).select("path", (F.col("at") + 1).alias("paragraph"), "content")


def markdown_units(text: str) -> list[dict]:
    """Headings with their path, paragraphs, table rows as cells, and notes, with the lines they span."""
    units: list[dict] = []
    stack: list[str] = []
    held: list[str] = []
    start = 0
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def flush(end: int) -> None:
        content = "\n".join(held).strip()
        held.clear()
        if content:
            units.append({"unit_type": "paragraph", "content": content, "level": None, "row": None, "col": None, "heading_path": list(stack), "line_start": start, "line_end": end})

    table = -1
    for i, line in enumerate(lines, 1):
        found = _HEADING.match(line)
        if found:
            flush(i - 1)
            level = len(found[1])
            del stack[level - 1 :]
            stack.append(found[2])
            units.append({"unit_type": "heading", "content": found[2], "level": level, "row": None, "col": None, "heading_path": list(stack), "line_start": i, "line_end": i})
        elif table >= 0 and "|" in line and line.strip() or "|" in line and i < len(lines) and _RULE.match(lines[i]) and "-" in lines[i]:
            if table < 0:
                flush(i - 1)
                table = 0
            if not _RULE.match(line):
                for c, cell in enumerate(re.split(r"(?<!\\)\|", line.strip().strip("|"))):
                    units.append({"unit_type": "table_cell", "content": cell.strip().replace("\\|", "|"), "level": None, "row": table, "col": c, "heading_path": list(stack), "line_start": i, "line_end": i})
                table += 1
        elif not line.strip():
            flush(i - 1)
            table = -1
        elif note := _NOTE.match(line):
            flush(i - 1)
            units.append({"unit_type": "footnote", "content": note[2], "level": None, "row": None, "col": None, "heading_path": [note[1]], "line_start": i, "line_end": i})
        else:
            table = -1
            if not held:
                start = i
            held.append(line)
    flush(len(lines))
    return [u | {"ordinal": k} for k, u in enumerate(units)]


_UNIT = pa.struct([("ordinal", pa.int32()), ("unit_type", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("heading_path", pa.list_(pa.string())), ("line_start", pa.int32()), ("line_end", pa.int32())])
_SQL = "ordinal int, unit_type string, content string, level int, row int, col int, heading_path array<string>, line_start int, line_end int"


def markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """The units of each Markdown text of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = pa.array(markdown_units(t or ""), _UNIT)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), *rows.flatten()], names=[key, *(f.name for f in _UNIT)])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {_SQL}")
