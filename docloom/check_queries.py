"""Queries of the rules in operators/checks, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import literals
from docloom.operators import checks as C
from docloom.queries import ROWS, order_rows, query
from docloom.session import table


@query(
    """SELECT label, source, start, stop, count(*) AS n FROM (SELECT n_name AS label, 'node' || r AS source, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 0 ELSE 2 END AS start, CASE WHEN k % 3 = 0 THEN length(n_name) WHEN k % 3 = 1 THEN length(n_name) ELSE 5 END AS stop
FROM (SELECT c_custkey AS k, c_custkey % 2 AS r, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)) GROUP BY ALL"""
)
def field_identities(spark, d):
    """Reads of customers' nations: the whole text, the same as a span, or a part of it."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, length = F.col("c_custkey"), F.length("n_name")
    start, end = F.when(k % 3 == 1, 0).when(k % 3 == 2, 2), F.when(k % 3 == 1, length).when(k % 3 == 2, 5)
    defs = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    source = F.concat(F.lit("node"), (k % 2).cast("string"))
    made = C.field_identity(F.array(F.lit("d")), F.col("n_name"), defs, F.lit("string"), F.lit("present"), source, F.lit("/text"), start, end, length)
    counted = rows.select(made.alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    return counted.select("i.label", "i.source", F.col("i.start").cast("long").alias("start"), F.col("i.end").cast("long").alias("stop"), "n")


_LINKS = f"(SELECT l_orderkey AS t, row AS c, l_returnflag || row AS k FROM {ROWS})"


@query(
    f"""WITH l AS {_LINKS}, s AS (SELECT t, max(c) AS m FROM l GROUP BY 1), p AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders)
SELECT p.a AS left_ref, p.b AS right_ref, y.k AS old, x.k AS new FROM p JOIN s u ON u.t = p.a JOIN s v ON v.t = p.b AND v.m = u.m JOIN l x ON x.t = p.a JOIN l y ON y.t = p.b AND y.c = x.c WHERE x.k <> y.k"""
)
def column_renames(spark, d):
    links = order_rows(spark, d).select(F.col("l_orderkey").alias("table_ref"), F.col("row").alias("column"), F.concat("l_returnflag", F.col("row").cast("string")).alias("key"))
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("left_ref"), (F.col("o_orderkey") + 1).alias("right_ref"))
    return C.column_renames(links, pairs)


@query(
    f"""WITH m AS (SELECT l_orderkey * 1000000 AS object_ref, l_orderkey * 1000000 + row AS ref, l_linestatus = 'O' AS owned, l_quantity > 40 AS para, row % 4 = 1 AS num, l_quantity < 5 AS val, row % 4 = 2 AS box, l_linenumber <> 3 AS empty FROM {ROWS})
SELECT ref, CASE WHEN num THEN 'stored note number' WHEN ref = object_ref THEN 'note control' ELSE 'note container' END AS kind, 1 AS n_objects FROM m JOIN orders ON object_ref = o_orderkey * 1000000 AND o_orderstatus = 'O'
WHERE owned AND NOT para AND empty AND (num OR (NOT val AND (ref = object_ref OR box)))"""
)
def note_dispositions(spark, d):
    """Orders as notes, their lines as the notes' parts."""
    k = F.col("l_orderkey") * 1000000
    members = order_rows(spark, d).select(
        k.alias("object_ref"), (k + F.col("row")).alias("ref"), (F.col("l_linestatus") == "O").alias("owned"), F.when(F.col("l_linenumber") == 3, "x").otherwise("").alias("text"), (F.col("l_quantity") > 40).alias("is_paragraph"),
        (F.col("row") % 4 == 1).alias("is_number"), (F.col("l_quantity") < 5).alias("has_value"), (F.col("row") % 4 == 2).alias("structural_only"),
    )
    notes = table(spark, d, "orders").select((F.col("o_orderkey") * 1000000).alias("object_ref"), F.when(F.col("o_orderstatus") == "O", "linked").otherwise("partial").alias("status"))
    return C.note_dispositions(notes, members).select("ref", "kind", F.size("objects").cast("long").alias("n_objects"))


_NAMES = "[' Source-Path ', 'anchor_x', 'text', 'AUTHORITY', 'my_anchors', 'paths', 'revision-id', 'value']"
_SET = "['source_path', 'anchor_x', NULL, 'authority', 'my_anchors', NULL, 'revision_id', NULL]"


@query(f"SELECT p_partkey, {_NAMES}[p_partkey % 8 + 1] AS name, {_SET}[p_partkey % 8 + 1] AS field FROM part")
def control_fields(spark, d):
    names = F.array(*map(F.lit, (" Source-Path ", "anchor_x", "text", "AUTHORITY", "my_anchors", "paths", "revision-id", "value")))
    rows = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", C.control_field(F.col("name")).alias("field"))


@query(
    f"""SELECT l_orderkey, row, CASE WHEN l_partkey % 11 = 0 THEN 'native_value_binding_not_offered' WHEN l_suppkey % 7 = 0 THEN 'native_value_binding_outside_sources' WHEN l_linenumber = 5 THEN 'binding_has_unresolved_observation_conflict'
WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'logical_value_binding_outside_occurrence' WHEN (l_linestatus = 'F') <> (l_partkey % 3 = 0) THEN 'blank_status_disagrees_with_observation' WHEN l_linestatus <> 'F' AND l_partkey % 3 = 1 THEN 'decimal_format_unresolved' END AS error FROM {ROWS}"""
)
def value_choice_errors(spark, d):
    """Raw values are blank, a word or a number by the part's key."""
    k = F.col("l_partkey")
    raw = F.when(k % 3 == 0, "").when(k % 3 == 1, "word").otherwise(F.concat(k.cast("string"), F.lit(".50")))
    rows = order_rows(spark, d).withColumn("raw", raw)
    status = F.when(F.col("l_linestatus") == "F", "blank").otherwise("present")
    error = C.value_choice_error(k % 11 != 0, F.col("l_suppkey") % 7 == 0, F.col("l_linenumber") == 5, F.col("l_returnflag") == "R", F.col("l_quantity") <= 25, status, F.lit("decimal"), F.col("raw"), literals.decimal_literal(F.col("raw")))
    return rows.select("l_orderkey", F.col("row").cast("long").alias("row"), error.alias("error"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS region_id FROM orders WHERE o_orderkey <> 7 AND (o_orderpriority = '5-LOW' OR o_orderstatus = 'P')")
def stale_contexts(spark, d):
    """Answers are saved for every order; requests of low priority are gone, and those of open orders have changed."""
    o = table(spark, d, "orders").withColumn("region_id", F.col("o_orderkey").cast("string"))
    saved = o.select("region_id", F.sha2("region_id", 256).alias("hash"))
    requests = o.where("o_orderpriority <> '5-LOW'").select("region_id", F.when(F.col("o_orderstatus") == "P", "new").otherwise(F.sha2("region_id", 256)).alias("hash"))
    return C.stale_contexts(requests, saved, "7")


_GRANTS = ['{"maxModelCalls": 5}', '{"maxModelCalls": 101}', '{"maxModelCalls": 0, "completionSeconds": 0}', '{"completionSeconds": 3600, "maxModelCalls": 0}', '{"other": 1}', '{"maxModelCalls": "5"}', '{"maxModelCalls": 1.5}', "{}", "[1]", '{"maxModelCalls": -1, "completionSeconds": 9}', '{"maxModelCalls": true}']


@query("SELECT p_partkey, CASE WHEN p_partkey % 12 IN (0, 3, 11) THEN NULL ELSE 'invalid-budget-grant' END AS error FROM part")
def budget_errors(spark, d):
    given = F.try_element_at(F.array(*map(F.lit, _GRANTS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.budget_error(given).alias("error"))


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR (p_size % 4 = 1 AND p_partkey % 3 <> 2)")
def accepted_projections(spark, d):
    """Saved by adapter versions 0 to 3; version 0 is current, 1 is retained but for the last format, whose adapter is gone."""
    p = table(spark, d, "part")
    saved = p.select("p_partkey", F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("format_id"), F.lit("a").alias("adapter_id"), (F.col("p_size") % 4).cast("string").alias("adapter_version"), F.lit("h").alias("config_hash"))
    kinds = saved.drop("p_partkey").distinct()
    return C.accepted_projections(saved, kinds.where("adapter_version = '0'"), kinds.where("adapter_version = '1' and format_id <> 'f2'")).select("p_partkey")


@query("SELECT p_partkey, 'A' || p_size AS shown, p_size AS origin_row, p_partkey % 7 AS origin_column, p_size % 3 + 1 AS rows_, p_size % 2 + 1 AS columns_ FROM part")
def public_ranges(spark, d):
    size = F.col("p_size")
    origin = F.struct(size.alias("row"), (F.col("p_partkey") % 7).alias("col"))
    given = F.struct(F.concat(F.lit("A"), size.cast("string")).alias("range"), origin.alias("origin"), (size % 3 + 1).alias("row_span"), (size % 2 + 1).alias("col_span"))
    m = table(spark, d, "part").select("p_partkey", C.merged_range(given).alias("m"))
    return m.select("p_partkey", F.col("m.range").alias("shown"), F.col("m.origin.row").cast("long").alias("origin_row"), F.col("m.origin.column").cast("long").alias("origin_column"), F.col("m.rowSpan").cast("long").alias("rows_"), F.col("m.columnSpan").cast("long").alias("columns_"))


@query(
    """SELECT p_partkey, 'image' AS kind, 'b' || p_partkey AS source_ref, CASE WHEN p_size % 2 = 0 THEN p_brand END AS fallback, CASE p_partkey % 3 WHEN 0 THEN '9' WHEN 1 THEN '5' END AS brightness, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END + CASE WHEN p_partkey % 3 < 2 THEN 1 ELSE 0 END AS n_keys FROM part"""
)
def image_markers(spark, d):
    key = F.col("p_partkey")
    entries = F.array(
        F.struct(F.lit("binary_item_ref").alias("k"), F.concat(F.lit("b"), key.cast("string")).alias("v")),
        F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("fallback_text").alias("k"), F.col("p_brand").alias("v"))),
        F.when(key % 3 < 2, F.struct(F.lit("brightness").alias("k"), F.lit("5").alias("v"))),
        F.when(key % 3 == 0, F.struct(F.lit("bright").alias("k"), F.lit("9").alias("v"))),
        F.struct(F.lit("private").alias("k"), F.lit("no").alias("v")),
    )
    m = table(spark, d, "part").select(key, C.image_marker(F.map_from_entries(F.filter(entries, lambda x: x.isNotNull()))).alias("m"))
    return m.select("p_partkey", F.col("m")["kind"].alias("kind"), F.col("m")["sourceRef"].alias("source_ref"), F.col("m")["fallbackText"].alias("fallback"), F.col("m")["rendering/brightness"].alias("brightness"), F.size("m").cast("long").alias("n_keys"))


@query("SELECT o_orderkey AS job_id, o_orderstatus AS execution, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 0 END END AS revision, CASE WHEN o_orderstatus <> 'P' THEN 'complete' ELSE 'result-not-ready' END AS outcome FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def job_results(spark, d):
    """Orders as jobs: open ones have no result yet, and those with a seventh line are deleted."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "job_id")
    results = o.where("o_orderstatus <> 'P'").select("job_id", F.when(F.col("o_custkey") % 2 == 0, 3).cast("long").alias("revision"), F.lit("complete").alias("status"))
    deleted = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("job_id")).distinct()
    return C.job_results(o.select("job_id", F.col("o_orderstatus").alias("status")), results, deleted)


@query(
    f"""WITH s AS (SELECT l_orderkey AS task_id, 'w' || row AS window_id, 'old' AS record, row FROM {ROWS}), m AS (SELECT task_id, window_id, CASE WHEN row % 2 = 1 THEN 'answered' ELSE record END AS record FROM s),
n AS (SELECT task_id, sum(length(window_id) + length(record)) AS n FROM m GROUP BY 1) SELECT s.task_id, s.window_id, CASE WHEN n.n > 40 THEN s.record ELSE m.record END AS record FROM s JOIN m USING (task_id, window_id) JOIN n USING (task_id)"""
)
def recorded_windows(spark, d):
    saved = order_rows(spark, d).select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("w"), F.col("row").cast("string")).alias("window_id"), F.lit("old").alias("record"), "row")
    answered = saved.where("row % 2 = 1").select("task_id", "window_id", F.lit("answered").alias("record"))
    return C.record_windows(saved.drop("row"), answered, 40)
