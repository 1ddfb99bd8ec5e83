"""Queries of the readers: documents are written from the driver's tables, read back, and compared by SQL with these tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import json as J
from docloom.functions import literals
from docloom.operators import intervals
from docloom.queries import _SPANS, ROWS, order_rows, query, spans
from docloom.session import shared_folder, table
from docloom.sinks import packages as P
from docloom.sources import frames, html, packages
from docloom.sources import text as markdown


def _orders(spark, d) -> DataFrame:
    """(l_orderkey, lines): the lines of each order in their order."""
    line = F.struct("row", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return order_rows(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _units(files: DataFrame, adapter: str, key: str = "l_orderkey") -> DataFrame:
    rows = packages.units(files.withColumn("adapter", F.lit(adapter)), key)
    whole = [F.col(c).cast("long").alias(c) for c in ("ordinal", "table", "row", "col", "row_span", "col_span", "level")]
    return rows.select(F.col(key).cast("long").alias(key), "unit_type", "content", "kind", "formula", "label", *whole)


# --- sheets ---


def _sheet(key: str, lines: list[dict]) -> bytes:
    cells = [(1, 1, "shared", "Line", None), (1, 3, "inline", f"Order <{key}>", None)]
    for x in lines:
        r = x["row"] + 2
        cells += [(r, 1, "number", str(x["l_linenumber"]), None), (r, 2, "number", f"{x['l_partkey']}.5", None), (r, 3, "shared", x["l_returnflag"], None), (r, 4, "boolean", str(int(x["row"] % 2 == 0)), None)]
        cells += [(r, 5, "number", str(2 * x["l_linenumber"]), f"A{r}*2"), (r, 6, "blank", None, None)]
    return P.sheet_document(f"S{key}", cells, [(1, 1, 1, 2)])


@query(
    f"""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), c AS (
SELECT l_orderkey, 'sheet' AS unit_type, 'S' || l_orderkey AS content, NULL AS kind, NULL AS formula, NULL AS row, NULL AS col, NULL AS col_span FROM o
UNION ALL SELECT l_orderkey, 'sheet_cell', 'Line', 'string', NULL, 1, 1, 2 FROM o UNION ALL SELECT l_orderkey, 'sheet_cell', 'Order <' || l_orderkey || '>', 'string', NULL, 1, 3, 1 FROM o
UNION ALL SELECT l_orderkey, 'sheet_cell', CAST(l_linenumber AS VARCHAR), 'integer', NULL, row + 2, 1, 1 FROM {ROWS}
UNION ALL SELECT l_orderkey, 'sheet_cell', l_partkey || '.5', 'number', NULL, row + 2, 2, 1 FROM {ROWS}
UNION ALL SELECT l_orderkey, 'sheet_cell', l_returnflag, 'string', NULL, row + 2, 3, 1 FROM {ROWS}
UNION ALL SELECT l_orderkey, 'sheet_cell', CASE WHEN row % 2 = 0 THEN 'true' ELSE 'false' END, 'boolean', NULL, row + 2, 4, 1 FROM {ROWS}
UNION ALL SELECT l_orderkey, 'sheet_cell', CAST(2 * l_linenumber AS VARCHAR), 'formula', 'A' || (row + 2) || '*2', row + 2, 5, 1 FROM {ROWS}
UNION ALL SELECT l_orderkey, 'sheet_cell', '', 'blank', NULL, row + 2, 6, 1 FROM {ROWS}) SELECT * FROM c"""
)
def sheet_cells(spark, d):
    files = P.write(_orders(spark, d), "l_orderkey", "lines", _sheet)
    return _units(files, "xlsx").select("l_orderkey", "unit_type", "content", "kind", "formula", "row", "col", "col_span")


# --- word documents ---

#: Lines of the first level, as in the numbering of nested lists.
_FIRST = "(row = 0 OR l_returnflag = 'R')"
_COUNTED = f"""(SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(CASE WHEN {_FIRST} THEN 1 ELSE 0 END) OVER w AS one, CASE WHEN NOT {_FIRST} THEN row - last_value(CASE WHEN {_FIRST} THEN row END IGNORE NULLS) OVER w END AS two
FROM {ROWS} WINDOW w AS (PARTITION BY l_orderkey ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_ROMAN = "['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][{0} // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][{0} // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][{0} % 10 + 1]".format("CAST(one AS BIGINT)")


def _items(lines: list[dict]) -> list[tuple]:
    return [("item", f"part {x['l_partkey']}", 0 if x["row"] == 0 or x["l_returnflag"] == "R" else 1) for x in lines]


def _word(key: str, lines: list[dict]) -> bytes:
    rows = [[("all", 1, "restart" if x["row"] == 0 else "continue"), (f"p{x['l_partkey']}", 1, None)] for x in lines] + [[("end", 2, None)]]
    return P.word_document([("heading", f"Order {key}", 2), ("paragraph", "a & b"), *_items(lines), ("table", rows)], [(1, "upperRoman", "%1."), (1, "lowerLetter", "%1-%2)")], [f"note {key}"])


@query(
    f"""WITH x AS {_COUNTED}, o AS (SELECT l_orderkey, max(n) AS n FROM x GROUP BY 1)
SELECT l_orderkey, 0 AS ordinal, 'heading' AS unit_type, 'Order ' || l_orderkey AS content, NULL AS label, 2 AS level, NULL AS row, NULL AS col, NULL AS row_span, NULL AS col_span FROM o
UNION ALL SELECT l_orderkey, 1, 'paragraph', 'a & b', NULL, NULL, NULL, NULL, NULL, NULL FROM o
UNION ALL SELECT l_orderkey, 2 + row, 'list_item', 'part ' || l_partkey, ({_ROMAN}) || CASE WHEN two IS NULL THEN '.' ELSE '-' || chr(CAST(96 + two AS INTEGER)) || ')' END, NULL, NULL, NULL, NULL, NULL FROM x
UNION ALL SELECT l_orderkey, 2 + n, 'table_cell', 'all', NULL, NULL, 0, 0, n, 1 FROM o
UNION ALL SELECT l_orderkey, 3 + n + row, 'table_cell', 'p' || l_partkey, NULL, NULL, row, 1, 1, 1 FROM x
UNION ALL SELECT l_orderkey, 3 + 2 * n, 'table_cell', 'end', NULL, NULL, n, 0, 1, 2 FROM o
UNION ALL SELECT l_orderkey, 4 + 2 * n, 'footnote', 'note ' || l_orderkey, NULL, NULL, NULL, NULL, NULL, NULL FROM o"""
)
def word_units(spark, d):
    files = P.write(_orders(spark, d), "l_orderkey", "lines", _word)
    return _units(files, "docx").select("l_orderkey", "ordinal", "unit_type", "content", "label", "level", "row", "col", "row_span", "col_span")


# --- slides ---


def _deck(key: str, lines: list[dict]) -> bytes:
    listed = [(f"part {x['l_partkey']}", "alphaLcParenBoth" if x["row"] % 2 else "arabicPeriod", x["row"] % 2, 3 if x["row"] == 0 else None) for x in lines]
    return P.slide_document([([(f"Order {key}", None, 0, None), *listed], [[("wide", 2)], [("l", 1), ("r", 1)]], f"said {key}")])


@query(
    f"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {ROWS}), o AS (SELECT l_orderkey, max(n) AS n FROM x GROUP BY 1)
SELECT l_orderkey, i AS ordinal, 'table_cell' AS unit_type, ['wide', 'l', 'r'][i + 1] AS content, NULL AS label, least(i, 1) AS row, greatest(i - 1, 0) AS col, CASE WHEN i = 0 THEN 2 ELSE 1 END AS col_span FROM (SELECT l_orderkey, unnest([0, 1, 2]) AS i FROM o)
UNION ALL SELECT l_orderkey, 3, 'slide_text', 'Order ' || l_orderkey, NULL, NULL, NULL, NULL FROM o
UNION ALL SELECT l_orderkey, 4 + row, 'slide_text', 'part ' || l_partkey, CASE WHEN row % 2 = 1 THEN '(a)' ELSE (3 + row // 2) || '.' END, NULL, NULL, NULL FROM x
UNION ALL SELECT l_orderkey, 4 + n, 'speaker_notes', 'said ' || l_orderkey, NULL, NULL, NULL, NULL FROM o"""
)
def slide_units(spark, d):
    """Odd lines are one level deeper, so that each starts anew."""
    files = P.write(_orders(spark, d), "l_orderkey", "lines", _deck)
    return _units(files, "pptx").select("l_orderkey", "ordinal", "unit_type", "content", "label", "row", "col", "col_span")


# --- Hancom documents ---


def _hancom(key: str, lines: list[dict]) -> bytes:
    cells = [(0, 0, 1, 2, f"head {key}"), *((x["row"] + 1, c, 1, 1, str(x[name])) for x in lines for c, name in enumerate(("l_partkey", "l_linestatus")))]
    return P.hancom_document([("paragraph", f"Order {key}"), *_items(lines), ("table", cells), ("note", "note")], [(1, "ROMAN_CAPITAL", "^1."), (1, "LATIN_SMALL", "^1-^2)")])


@query(
    f"""WITH x AS {_COUNTED}, o AS (SELECT l_orderkey, max(n) AS n FROM x GROUP BY 1)
SELECT l_orderkey, 0 AS ordinal, 'paragraph' AS unit_type, 'Order ' || l_orderkey AS content, NULL AS label, NULL AS row, NULL AS col, NULL AS col_span FROM o
UNION ALL SELECT l_orderkey, 1 + row, 'list_item', 'part ' || l_partkey, ({_ROMAN}) || CASE WHEN two IS NULL THEN '.' ELSE '-' || chr(CAST(96 + two AS INTEGER)) || ')' END, NULL, NULL, NULL FROM x
UNION ALL SELECT l_orderkey, 1 + n, 'table_cell', 'head ' || l_orderkey, NULL, 0, 0, 2 FROM o
UNION ALL SELECT l_orderkey, 2 + n + 2 * row, 'table_cell', CAST(l_partkey AS VARCHAR), NULL, row + 1, 0, 1 FROM x
UNION ALL SELECT l_orderkey, 3 + n + 2 * row, 'table_cell', l_linestatus, NULL, row + 1, 1, 1 FROM x
UNION ALL SELECT l_orderkey, 2 + 3 * n, 'footnote', 'note', NULL, NULL, NULL, NULL FROM o"""
)
def hancom_units(spark, d):
    files = P.write(_orders(spark, d), "l_orderkey", "lines", _hancom)
    return _units(files, "hwpx").select("l_orderkey", "ordinal", "unit_type", "content", "label", "row", "col", "col_span")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ordinal, trim(content, ' ') AS content FROM (SELECT conv_id, turn, role, text, role || ' ' || regexp_replace(text, '\\s+', ' ', 'g') AS content FROM conversations WHERE text IS NOT NULL)")
def hancom_binary_units(spark, d):
    """Conversations as binary documents, every other one packed."""
    said = table(spark, d, "conversations").where("text is not null")
    turn = F.struct("turn", "role", "text", F.concat("role", F.lit(" "), F.regexp_replace("text", r"\s+", " ")).alias("shown"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    files = P.write(rows, "conv_id", "turns", lambda k, turns: P.hancom_binary([t["shown"] for t in turns], int(k) % 2 == 0))
    return _units(files, "hwp5", "conv_id").select("conv_id", "ordinal", "content")


# --- Markdown, HTML tables, metafiles, frames ---


@query(
    """WITH t AS (SELECT doc_id, i, regexp_replace(regexp_replace(trim(p, ' '), '[|#\\[\\]]', '', 'g'), '\\s+', ' ', 'g') AS p FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents)),
u AS (SELECT doc_id, i, trim(p, ' ') AS p FROM t)
SELECT doc_id, 'heading' AS unit_type, 'Text ' || doc_id AS content, 2 AS level, 'Text ' || doc_id AS heading, 1 AS line FROM documents
UNION ALL SELECT doc_id, 'paragraph', rtrim('= ' || p, ' '), NULL, 'Text ' || doc_id, 2 * i + 1 FROM u"""
)
def markdown_units(spark, d):
    """Each text as Markdown: a heading, then its sentences as paragraphs."""
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"[|#\[\]]", ""), r"\s+", " "))
    parts = F.transform(F.split("text", r"\. "), lambda p: F.concat(F.lit("= "), clean(p)))
    body = F.concat(F.lit("## Text "), F.col("doc_id").cast("string"), F.lit(" ##\n\n"), F.array_join(parts, "\n\n"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", body.alias("text"))
    found = markdown.markdown(rows, "doc_id", "text")
    return found.select("doc_id", "unit_type", "content", F.col("level").cast("long").alias("level"), F.element_at("heading_path", -1).alias("heading"), F.col("line_start").cast("long").alias("line"))


@query(f"SELECT l_orderkey, 0 AS row, 0 AS col, 1 AS row_span, 2 AS col_span, 'Order ' || l_orderkey AS content, true AS is_header FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 1, 0, n, 1, 'all & more', false FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) UNION ALL SELECT l_orderkey, row + 1, 1, 1, 1, CAST(l_partkey AS VARCHAR), false FROM {ROWS}")
def html_table_cells(spark, d):
    """Orders as HTML tables with a wide head and a first cell over all rows."""
    rows = F.transform("lines", lambda x: F.concat(F.lit("<td>"), x["l_partkey"].cast("string"), F.lit("</td></tr>")))
    head = F.concat(F.lit("<table><tr><th colspan=2>Order "), F.col("l_orderkey").cast("string"), F.lit("</th></tr><tr><td rowspan=0>all &amp; <b>more</b></td>"))
    pages = _orders(spark, d).select("l_orderkey", F.concat(head, F.array_join(rows, "<tr>"), F.lit("</table>")).alias("html"))
    whole = [F.col(c).cast("long").alias(c) for c in ("row", "col", "row_span", "col_span")]
    return html.cells(pages, "l_orderkey", "html").select("l_orderkey", *whole, F.col("text").alias("content"), "is_header")


@query(f"SELECT l_orderkey, row + 1 AS record, l_returnflag || ' ' || l_partkey AS content FROM {ROWS}")
def metafile_strings(spark, d):
    files = P.write(_orders(spark, d), "l_orderkey", "lines", lambda _, lines: P.metafile([f"{x['l_returnflag']} {x['l_partkey']}" for x in lines]))
    return frames.strings(files, "l_orderkey", "content").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("record").cast("long").alias("record"), F.col("text").alias("content"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3")
def frame_rows(spark, d):
    """Events as JSON lines, every tenth cut off in the middle, as a program that died leaves it."""
    whole = F.to_json(F.struct("event_id", "user_id", "event_type"))
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(folder)
    return frames.json_frames(spark, folder, "event_id long, user_id long, event_type string")


@query("SELECT p_partkey AS left_, p_size AS width, CAST(p_partkey % 97 AS DOUBLE) AS conf, p_brand AS content FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0")
def recognized_words(spark, d):
    """Parts as a recognizer's table; every seventh word is blank and every fifth box is empty."""
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    cells = [F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), (n % 40).cast("string"), F.lit("1"), n.cast("string"), F.lit("0"), F.when(n % 5 == 0, "0").otherwise(F.col("p_size").cast("string")), F.lit("9"), (n % 97).cast("string"), F.when(n % 7 == 0, " ").otherwise(F.col("p_brand"))]
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    p.select(F.concat_ws("\t", *cells).alias("value")).write.text(folder)
    found = frames.words(spark, folder, header=False)
    return found.select(F.col("left").cast("long").alias("left_"), F.col("width").alias("width"), "conf", F.col("text").alias("content"))


@query("""SELECT n_nationkey, '{"key": ' || n_nationkey || ', "payload": "' || n_name || '"}' AS result FROM nation""")
def adapter_answers(spark, d):
    """A program that answers with its request."""
    return frames.adapt(table(spark, d, "nation"), "n_nationkey", "n_name", ["/bin/cat"])


# --- JSON and schemas ---

_TREE = """'{"a/b": [' || p_size || ', {"x": null}], "n~": ' || p_partkey || ', "e": {}, "s": "' || p_brand || '"}'"""


@query(f"""SELECT p_partkey, unnest(['/a~1b/0', '/a~1b/1/x', '/n~0', '/e', '/s']) AS pointer, unnest([CAST(p_size AS VARCHAR), 'null', CAST(p_partkey AS VARCHAR), '{{}}', '"' || p_brand || '"']) AS value FROM part""")
def json_leaves(spark, d):
    """The pointers of all leaves and what stands there."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_TREE).alias("t"))
    return J.leaf_rows(rows, "p_partkey", "t")


_SCHEMAS = [
    ('{"type": "object", "properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"type": "string"}}}', None),
    ('{"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"$ref": "#/$defs/x"}}}', "reference_circular"),
    ('{"properties": {"a": {"$ref": "#/none"}}}', "reference_missing"),
    ('{"properties": {"a": {"$ref": "http://x"}}}', "reference_not_local"),
    ('{"properties": {"a": {"pattern": "x"}}}', "keyword:pattern"),
    ('{"a": 1, "a": 2}', "not_strict"),
]


@query("SELECT p_partkey, [" + ", ".join("NULL" if e is None else f"'{e}'" for _, e in _SCHEMAS) + "][p_partkey % 6 + 1] AS error FROM part")
def schema_errors(spark, d):
    given = F.element_at(F.array(*(F.lit(s) for s, _ in _SCHEMAS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", given.alias("schema"))
    return rows.select("p_partkey", J.schema_error_column(F.col("schema")).alias("error"))


@query("SELECT p_partkey, unnest(range(5)) AS place, unnest(['/' || lower(replace(p_brand, '#', '~')).replace('~', '~0'), '/list', '/list/*', '/list/*/in', '/z~1']) AS pointer FROM part")
def schema_targets(spark, d):
    """Declared properties in depth-first order."""
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit("~")))
    given = F.concat(F.lit('{"properties": {"'), name, F.lit('": {}, "list": {"items": {"properties": {"in": {}}}}, "z/": {}}}'))
    rows = table(spark, d, "part").select("p_partkey", given.alias("s"))
    return J.target_rows(rows, "p_partkey", "s")


_RAW = "CASE p_partkey % 8 WHEN 0 THEN '007' WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.50' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN p_brand WHEN 6 THEN '1e5' ELSE '.5' END"
_DECIMAL = r"regexp_full_match(raw, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')"
_NUMBER, _INTEGER = r"regexp_full_match(raw, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?')", "regexp_full_match(raw, '-?(0|[1-9][0-9]*)')"


@query(
    f"""SELECT p_partkey, kind, kind || CASE WHEN p_partkey % 3 = 0 AND kind <> 'null' THEN ',null' ELSE '' END AS declared, {_INTEGER} AS as_integer, raw IN ('true', 'false') AS as_boolean FROM (
SELECT p_partkey, raw, CASE WHEN raw = 'null' THEN 'null' WHEN raw IN ('true', 'false') THEN 'boolean' WHEN {_INTEGER} THEN 'integer' WHEN {_NUMBER} THEN 'number' WHEN {_DECIMAL} THEN 'string' ELSE 'string' END AS kind
FROM (SELECT p_partkey, {_RAW} AS raw FROM part))"""
)
def typed_reads(spark, d):
    """The kind of each raw value, the types its schema declares, and whether it reads as two kinds."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_RAW).alias("raw"))
    kind = literals.typed_kind(F.col("raw"))
    rows = rows.withColumn("kind", F.when(kind == "decimal", "string").otherwise(kind))
    status = F.when(F.col("p_partkey") % 3 == 0, "blank").otherwise("present")
    return rows.select("p_partkey", "kind", F.array_join(literals.schema_kinds(F.col("kind"), status), ",").alias("declared"), literals.readable(F.col("raw"), "integer").alias("as_integer"), literals.readable(F.col("raw"), "boolean").alias("as_boolean"))


# --- bindings within their occurrences ---

_RUNS = f"""runs AS (SELECT k, min(s) AS lo, max(e) AS hi FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
  FROM (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {_SPANS})) GROUP BY k, g)"""


@query(f"WITH {_RUNS} SELECT p_partkey AS k, b.lo, b.lo + p_size AS hi FROM (SELECT p_partkey, p_size, unnest([1000, 2000, 2500]) + p_size * 7 AS lo FROM part) b WHERE EXISTS (SELECT 1 FROM runs r WHERE r.k = b.p_partkey AND r.lo <= b.lo AND b.lo + p_size <= r.hi)")
def contained_bindings(spark, d):
    """Bindings that lie within the occurrences of their key."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", F.explode(F.array(*map(F.lit, (1000, 2000, 2500)))).alias("at"))
    bound = p.select("k", (F.col("at") + F.col("p_size") * 7).cast("long").alias("start"), (F.col("at") + F.col("p_size") * 8).cast("long").alias("end"))
    return intervals.contained(bound, spans(spark, d), "k").toDF("k", "lo", "hi")
