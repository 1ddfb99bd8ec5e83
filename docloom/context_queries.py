"""Queries of operators/context over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import context as C
from docloom.queries import CELLS, ROWS, docs, order_cells, order_rows, query
from docloom.session import table

_BLOCKS = """(SELECT user_id, event_id, ts, event_id % 5 <> 0 AS sure, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END AS lv,
  CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'section_heading' WHEN event_id % 7 = 0 THEN 'header' WHEN event_id % 45 = 0 THEN 'unresolved' ELSE 'paragraph' END AS role FROM events)"""
_AFTER = "({x}.ts > {y}.ts OR ({x}.ts = {y}.ts AND {x}.event_id > {y}.event_id))"


@query(
    f"""WITH e AS {_BLOCKS}, h AS (SELECT * FROM e WHERE sure AND lv IS NOT NULL), u AS (SELECT *, coalesce(lv, 0) AS k FROM e WHERE NOT sure AND role IN ('section_heading', 'unresolved')),
o AS (SELECT DISTINCT a.event_id FROM e a JOIN u ON u.user_id = a.user_id AND NOT {_AFTER.format(x='u', y='a')}
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = a.user_id AND h.lv <= u.k AND {_AFTER.format(x='h', y='u')} AND NOT {_AFTER.format(x='h', y='a')})),
p AS (SELECT a.event_id, max_by(b.event_id, struct_pack(t := b.ts, i := b.event_id)) AS parent FROM e a JOIN h b ON b.user_id = a.user_id AND {_AFTER.format(x='a', y='b')}
  AND (NOT a.sure OR a.lv IS NULL OR b.lv < a.lv) GROUP BY 1)
SELECT e.event_id, CASE WHEN o.event_id IS NULL AND role <> 'header' THEN parent END AS parent, CASE WHEN o.event_id IS NULL THEN 'resolved' ELSE 'unresolved' END AS parent_status FROM e LEFT JOIN o USING (event_id) LEFT JOIN p USING (event_id)"""
)
def outline_sections(spark, d):
    """Events as blocks of a user's document; every fifth is in doubt."""
    lv = F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 END")
    role = F.expr("CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'section_heading' WHEN event_id % 7 = 0 THEN 'header' WHEN event_id % 45 = 0 THEN 'unresolved' ELSE 'paragraph' END")
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), lv.alias("lv"), role.alias("role"), (F.col("event_id") % 5 != 0).alias("sure"))
    return C.outline(rows, ["user_id"], "at", "role", "lv", "sure", "event_id", 3).select("event_id", "parent", "parent_status")


@query(
    f"""WITH h AS (SELECT l_orderkey AS t, row AS hr, CAST(l_partkey % 3 AS BIGINT) AS c0, CAST(l_suppkey % 3 + 1 AS BIGINT) AS span FROM {ROWS}),
x AS (SELECT t, hr, span, unnest(range(c0, c0 + span)) AS c FROM h WHERE span >= 2),
g AS (SELECT x.t, x.hr, x.span, x.c, k.definition, coalesce(x.hr <= k.cited, false) AND NOT coalesce(k.blocked, false) AS good
  FROM x LEFT JOIN (SELECT l_orderkey AS t, row AS c, CASE WHEN row = 5 THEN 4 ELSE row END AS definition, l_linenumber AS cited, l_returnflag = 'R' AS blocked FROM {ROWS}) k ON k.t = x.t AND k.c = x.c)
SELECT t AS table_id, hr AS header, min(c) AS first, max(c) AS last FROM g GROUP BY t, hr, span HAVING bool_and(good) AND count(definition) = span AND count(DISTINCT definition) = span"""
)
def header_groups(spark, d):
    """Lines of an order as headers over its lines as columns; a column cites the headers up to its number."""
    rows = order_rows(spark, d).withColumnRenamed("l_orderkey", "table_id")
    headers = rows.select("table_id", F.col("row").cast("long").alias("header"), (F.col("l_partkey") % 3).cast("long").alias("col"), (F.col("l_suppkey") % 3 + 1).cast("long").alias("span"))
    column = F.col("row").cast("long").alias("col")
    columns = rows.select("table_id", column, F.when(F.col("row") == 5, 4).otherwise(F.col("row")).alias("definition"), F.sequence(F.lit(0).cast("long"), F.col("l_linenumber").cast("long")).alias("sources"))
    found = C.header_groups(headers, columns, rows.where("l_returnflag = 'R'").select("table_id", column))
    return found.select("table_id", "header", F.array_min("columns").alias("first"), F.array_max("columns").alias("last"))


@query(
    """WITH v AS (SELECT o_orderkey AS item, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS r, o_orderpriority || o_custkey AS raw FROM orders),
c AS (SELECT o_custkey AS r, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT item, status, CASE WHEN r IS NOT NULL THEN left(raw, 10) END AS value_text, CASE WHEN r IS NOT NULL THEN length(raw) > 10 END AS truncated, CASE WHEN r IS NOT NULL THEN coalesce(c.n, 0) END AS n_places,
  r IS NULL OR (length(raw) <= 10 AND r IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS complete FROM v LEFT JOIN c USING (r)"""
)
def scalar_origins(spark, d):
    o = table(spark, d, "orders")
    ref = F.col("o_custkey").alias("source_ref")
    values = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("source_ref"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("raw"))
    cells = o.where("o_orderkey % 3 = 0").select(ref, F.col("o_orderstatus").alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"))
    nodes = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("source_ref"))
    found = C.scalar_origins(values, cells, nodes, 10)
    return found.select("item", "status", "value_text", "truncated", F.when(F.col("locations").isNotNull(), F.size("locations")).cast("long").alias("n_places"), "complete")


@query()
def literal_choices(spark, d):
    """Numerals of every whole text; compared with plain Python, as DuckDB's patterns look neither ahead nor behind."""
    return C.literal_choices(docs(spark, d), "doc_id", "text")


@query(
    f"""WITH v AS (SELECT c.table_id, c.row, c.col, CASE WHEN c.col IN (4, 5) THEN l_linestatus ELSE c.value END AS value, l_returnflag AS text FROM {CELLS} c JOIN {ROWS} r ON r.l_orderkey = c.table_id AND r.row = c.row WHERE NOT (c.col = 2 AND c.row % 3 = 1)),
s AS (SELECT table_id, row, string_agg(col, ',' ORDER BY col) AS shape FROM v GROUP BY 1, 2),
g AS (SELECT table_id, shape, col, count(*) AS n, count(DISTINCT value) = 1 AS one, bool_and(value = text) AS is_text, string_agg(value, '|' ORDER BY row) AS vec FROM v JOIN s USING (table_id, row) GROUP BY 1, 2, 3 HAVING count(*) > 1),
p AS (SELECT *, CASE WHEN is_text THEN 'text' WHEN one THEN 'shared' ELSE 'column' END AS placement FROM g)
SELECT table_id, CAST(len(string_split(shape, ',')) AS BIGINT) AS width, col, placement, CASE WHEN placement = 'column' THEN min(col) OVER (PARTITION BY table_id, shape, placement, vec) END AS same_as, n FROM p"""
)
def column_templates(spark, d):
    """Lines as records of six paths, some without the third; the last two paths are equal, the fourth is the text."""
    text = order_rows(spark, d).select(F.col("l_orderkey").alias("table_id"), "row", F.col("l_returnflag").alias("text"), "l_linestatus")
    value = F.when(F.col("col").isin(4, 5), F.col("l_linestatus")).otherwise(F.col("value"))
    values = order_cells(spark, d).join(text, ["table_id", "row"]).withColumn("value", value).where("NOT (col = 2 AND row % 3 = 1)")
    found = C.column_templates(values, "table_id", "row", "col", "value", "text")
    width = F.count("*").over(C.Window.partitionBy("table_id", "shape"))
    return found.select("table_id", width.alias("width"), F.col("col").cast("long").alias("col"), "placement", F.col("like").cast("long").alias("same_as"), "n")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/a=' || p_brand || ' /b/c=1 /b/d=9 /e={}' WHEN 1 THEN '/a=' || p_brand || ' /b=x /e={}' WHEN 2 THEN '/a=' || p_brand || ' /b/c=1 /b/d=2 /e=5' ELSE '/a/z=7 /b/c=1 /b/d=2 /e={}' END AS leaves FROM part"""
)
def merged_patches(spark, d):
    """A template of a brand and an object, and four kinds of patches: a leaf, an object replaced, an empty object, a leaf that becomes one."""
    leaves = lambda **m: F.create_map(*(x for k, v in m.items() for x in (F.lit("/" + k.replace("_", "/")), v if not isinstance(v, str) else F.lit(v))))
    k = F.col("p_partkey") % 4
    template = leaves(a=F.col("p_brand"), b_c="1", b_d="2", e="{}")
    patch = F.when(k == 0, leaves(b_d="9")).when(k == 1, leaves(b="x")).when(k == 2, leaves(b="{}", e="5")).otherwise(leaves(a_z="7"))
    entries = F.array_sort(F.transform(F.map_entries(C.merged(template, patch)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, d, "part").select("p_partkey", F.array_join(entries, " ").alias("leaves"))


@query("SELECT b.p_partkey AS parent, a.p_partkey AS child, 't' || a.p_partkey % 5 AS table_ref FROM part a JOIN part b ON b.p_partkey = a.p_size AND b.p_size % 5 = a.p_partkey % 5 AND a.p_partkey <> b.p_partkey")
def routed_tables(spark, d):
    named = lambda c: F.concat(F.lit("t"), (F.col(c) % 5).cast("string"))
    return C.routed_tables(table(spark, d, "part").select(F.col("p_partkey").alias("region"), F.col("p_size").cast("long").alias("parent_region"), named("p_size").alias("table_ref"), named("p_partkey").alias("table_context")))


@query(
    "SELECT DISTINCT l_orderkey AS record, l_partkey AS occurrence, l_returnflag AS col FROM lineitem WHERE (l_orderkey, l_partkey, l_returnflag) NOT IN (SELECT (l_orderkey, l_partkey, l_returnflag) FROM lineitem WHERE l_linenumber % 3 <> 0)"
)
def lost_content(spark, d):
    """Lines as accepted occurrences; the candidate lacks every third."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("occurrence"), F.col("l_returnflag").alias("col"), "l_linenumber")
    return C.lost_content(rows, rows.where("l_linenumber % 3 <> 0"), ["record", "occurrence", "col"])


@query(
    """SELECT p_partkey, CASE WHEN p_size % 9 <> 0 AND p_partkey % 2 = 0 THEN p_partkey * 10 END AS table_index, CASE WHEN p_size % 9 <> 0 AND p_partkey % 2 = 0 THEN 'verified-section-xml-table-order' END AS basis,
  CASE WHEN p_size % 9 <> 0 AND p_partkey % 2 = 1 THEN 'xml-table-order-unverified' END AS reason FROM part"""
)
def table_selectors(spark, d):
    p = table(spark, d, "part")
    section = F.when(F.col("p_size") % 9 != 0, F.concat(F.lit("section"), (F.col("p_size") % 9).cast("string")))
    tables = p.select("p_partkey", section.alias("section"), F.col("p_partkey").alias("element"))
    addresses = tables.where("p_partkey % 2 = 0").select("section", "element", (F.col("element") * 10).alias("table_index"))
    return C.table_selectors(tables, addresses).select("p_partkey", "table_index", "basis", "reason")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'body' END AS role, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS page, CASE WHEN l_linenumber % 2 = 0 THEN CAST(round_even(l_partkey / 2, 0) AS BIGINT) END AS left_, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS row_, l_returnflag AS text
FROM lineitem"""
)
def relation_views(spark, d):
    p = F.col("l_partkey")
    odd = F.col("l_linenumber") % 2 == 1
    box = F.struct((p / 2).alias("left"), (p / 4).alias("top"), (p / 2 + 1).alias("right"), (p / 4 + 1).alias("bottom"))
    view = C.relation_view(F.col("l_returnflag"), F.lit("body"), F.col("l_suppkey"), box, F.lit("t"), F.when(odd, p), F.when(odd, F.lit(0)))
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", view.alias("v"))
    return v.select("l_orderkey", "l_linenumber", "v.role", "v.page", F.col("v.bbox.left").alias("left_"), F.col("v.row").alias("row_"), "v.text")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_partkey % 700 END AS para_shape, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS style, CASE WHEN p_size % 7 <> 0 AND p_partkey % 700 < 500 THEN 'align' || p_partkey % 700 END AS align,
  CASE WHEN p_size % 7 <> 0 THEN n_name END AS style_name, p_size % 7 = 0 OR p_partkey % 700 >= 500 AS properties_unavailable FROM part LEFT JOIN nation ON n_nationkey = p_size"""
)
def paragraph_properties(spark, d):
    """Parts as paragraph headers of 12 bytes, or of 4 where they are cut off."""
    k = F.col("p_partkey") % 700
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    whole = F.concat(F.lit("00" * 8), two(k % 256), two(F.floor(k / 256)), two(F.col("p_size")), F.lit("00"))
    rows = table(spark, d, "part").select("p_partkey", F.unhex(F.when(F.col("p_size") % 7 != 0, whole).otherwise("00" * 4)).alias("data"))
    shapes = spark.range(500).select(F.col("id").cast("int").alias("para_shape"), F.concat(F.lit("align"), F.col("id").cast("string")).alias("align"))
    styles = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("style"), F.col("n_name").alias("style_name"))
    found = C.paragraph_properties(rows, "data", shapes, styles)
    return found.select("p_partkey", F.col("para_shape").cast("long").alias("para_shape"), F.col("style").cast("long").alias("style"), "align", "style_name", "properties_unavailable")


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag AS text, l_suppkey AS page, CAST(l_partkey AS DOUBLE) AS left_, 'page left' AS place_fields, 'kind' AS input_fields, 4 AS n_fields FROM lineitem"""
)
def model_nodes(spark, d):
    """Lines as nodes with traces in their places and inputs, and a field of their own that is not shown."""
    box = F.struct(F.col("l_partkey").cast("double").alias("left"), F.lit(1).alias("sourceBox"))
    place = F.struct(F.col("l_suppkey").alias("page"), box.alias("bbox"), F.lit("x").alias("characters"), F.lit("x").alias("provenance"))
    nodes = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"), F.lit("body").alias("semanticRole"), place.alias("sourceStructure"), F.struct(F.lit("k").alias("kind"), F.lit("x").alias("sourceSegments")).alias("semanticInput"), F.lit("x").alias("alignmentTrace")
    )
    seen = C.model_nodes(nodes, ["l_orderkey", "l_linenumber"])
    names = lambda path: seen.select(f"{path}.*").columns
    places = [c for c in names("sourceStructure") if c != "bbox"] + names("sourceStructure.bbox")
    return seen.select("l_orderkey", "l_linenumber", "text", F.col("sourceStructure.page").alias("page"), F.col("sourceStructure.bbox.left").alias("left_"), F.lit(" ".join(places)).alias("place_fields"), F.lit(" ".join(names("semanticInput"))).alias("input_fields"), F.lit(len(seen.columns) - 2).alias("n_fields"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS description, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS n_texts, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_ranges, o_orderstatus AS status FROM orders"""
)
def statements(spark, d):
    k = F.col("o_orderkey")
    span = F.struct(F.lit(0).alias("start"), k.alias("end"))
    made = C.statement(k, F.col("o_orderstatus"), F.lit("unit"), F.when(k % 2 == 0, F.col("o_orderpriority")), F.array(k), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))), F.when(k % 5 == 0, F.array(span)))
    s = table(spark, d, "orders").select("o_orderkey", made.alias("s"))
    return s.select("o_orderkey", "s.description", F.size("s.sourceText").alias("n_texts"), F.size("s.sourceRanges").alias("n_ranges"), F.col("s.meaningStatus").alias("status"))
