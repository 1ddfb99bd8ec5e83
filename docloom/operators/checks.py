"""Rules that decide whether something offered may be used: identities, choices, budgets, control fields, saved contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that only the core may set, and prefixes and suffixes of such.
CONTROL_FIELDS = "anchor anchors authority authority_level document_id file_path file_uri file_url filename original_path original_uri original_url path relative_path revision_id source_anchor source_anchors source_path source_unit_id source_uri source_url trust_lineage unit_id uri url".split()
CONTROL_STARTS, CONTROL_ENDS = ("anchor_", "authority_"), ("_anchor", "_anchors", "_authority")
#: The largest grant of each kind of budget.
BUDGETS = {"maxModelCalls": 100, "completionSeconds": 3600}


def field_identity(destination: Column, label: Column, definitions: Column, kind: Column, status: Column, source: Column, path: Column, start: Column, end: Column, length: Column) -> Column:
    """What makes two fields the same: equal values alone never do. A read of the whole text is one of its span."""
    whole = (path == "/text") & start.isNull() & end.isNull()
    return F.struct(
        destination.alias("destination"),
        label.alias("label"),
        F.array_sort(F.array_distinct(definitions)).alias("definitions"),
        kind.alias("kind"),
        status.alias("status"),
        source.alias("source"),
        path.alias("path"),
        F.when(whole, F.lit(0)).otherwise(start).alias("start"),
        F.when(whole, length).otherwise(end).alias("end"),
    )


def column_renames(links: DataFrame, pairs: DataFrame, table: str = "table_ref", column: str = "column", key: str = "key", left: str = "left_ref", right: str = "right_ref") -> DataFrame:
    """(left, right, old, new): keys of a right table that take the name of the left one's key in the same column.

    Only where both tables have keys for the same columns.
    """
    columns = links.groupBy(table).agg(F.array_sort(F.collect_set(column)).alias("cols"))
    same = pairs.join(columns.toDF(left, "a"), left).join(columns.toDF(right, "b"), right).where(F.col("a") == F.col("b")).select(left, right)
    named = links.select(table, column, key)
    met = same.join(named.toDF(left, column, "new"), left).join(named.toDF(right, column, "old"), [right, column])
    return met.where(F.col("old") != F.col("new")).select(left, right, "old", "new")


def note_dispositions(notes: DataFrame, members: DataFrame) -> DataFrame:
    """(ref, kind, objects): owned, empty parts of linked notes that are accounted for by structure alone.

    notes has (object_ref, status); members (object_ref, ref, owned, text, is_paragraph, is_number, has_value, structural_only)
    names the object itself too.
    """
    linked = members.join(notes.where("status = 'linked'").select("object_ref"), "object_ref", "left_semi").where("owned and not is_paragraph and text = ''")
    kind = F.when(F.col("is_number"), "stored note number").when(~F.col("has_value") & (F.col("ref") == F.col("object_ref")), "note control").when(~F.col("has_value") & F.col("structural_only"), "note container")
    return linked.withColumn("kind", kind).where("kind is not null").groupBy("ref").agg(F.min(F.struct("object_ref", "kind"))["kind"].alias("kind"), F.array_sort(F.collect_list("object_ref")).alias("objects"))


def control_field(name: Column) -> Column:
    """The field of the core that a key of an adapter's output would set, or null."""
    plain = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    bad = plain.isin(*CONTROL_FIELDS)
    for x in CONTROL_STARTS:
        bad = bad | plain.startswith(x)
    for x in CONTROL_ENDS:
        bad = bad | plain.endswith(x)
    return F.when(bad, plain)


def value_choice_error(offered: Column, outside_sources: Column, conflict: Column, quoted: Column, within: Column, status: Column, kind: Column, raw: Column, decimal: Column) -> Column:
    """Why a binding may not be chosen for a field, the first reason that holds; null if it may."""
    blank = status == "blank"
    return (
        F.when(~offered, "native_value_binding_not_offered")
        .when(outside_sources, "native_value_binding_outside_sources")
        .when(conflict, "binding_has_unresolved_observation_conflict")
        .when(quoted & ~within, "logical_value_binding_outside_occurrence")
        .when(blank != (raw == ""), "blank_status_disagrees_with_observation")
        .when((kind == "decimal") & ~blank & (raw != "") & ~decimal, "decimal_format_unresolved")
    )


def stale_contexts(requests: DataFrame, saved: DataFrame, changed: str) -> DataFrame:
    """Saved answers of other regions whose request is no longer the one they answered; requests and saved have (region_id, hash)."""
    others = saved.where(F.col("region_id") != changed).select("region_id", F.col("hash").alias("saved"))
    return others.join(requests.select("region_id", F.col("hash").alias("now")), "region_id", "left").where(~F.col("saved").eqNullSafe(F.col("now"))).select("region_id")


def budget_error(budget: Column) -> Column:
    """Why a budget (a JSON object of whole numbers) is refused, or null; a null budget grants nothing and is no error."""
    keys = F.json_object_keys(budget)
    held = F.lit(False)
    known = F.size(F.array_except(keys, F.array(*map(F.lit, BUDGETS)))) == 0
    sound = F.lit(True)
    for name, most in BUDGETS.items():
        raw = F.get_json_object(budget, f"$.{name}")
        # A number is one only where the text has no quotes around it and no fraction.
        whole = F.rlike(budget, F.lit(rf'"{name}"\s*:\s*-?[0-9]+\s*[,}}]'))
        value = raw.try_cast("long")
        there = F.array_contains(keys, name)
        sound = sound & (~there | F.coalesce(whole & value.between(0, most), F.lit(False)))
        held = held | (there & F.coalesce(value > 0, F.lit(False)))
    return F.when(budget.isNull(), None).when(keys.isNull() | ~F.coalesce(known & sound & held, F.lit(False)), "invalid-budget-grant")


def accepted_projections(saved: DataFrame, current: DataFrame, retained: DataFrame) -> DataFrame:
    """Saved projections that are still good: those of the format's present adapter, and of earlier ones it vouches for.

    All three have (format_id, adapter_id, adapter_version, config_hash).
    """
    identity = ["format_id", "adapter_id", "adapter_version", "config_hash"]
    good = current.select(*identity).unionByName(retained.join(current.select("format_id").distinct(), "format_id", "left_semi").select(*identity)).distinct()
    return saved.join(good, identity, "left_semi")


def merged_range(r: Column) -> Column:
    """The public form of a merged range (range, origin(row, col), row_span, col_span)."""
    return F.struct(r["range"].alias("range"), F.struct(r["origin"]["row"].alias("row"), r["origin"]["col"].alias("column")).alias("origin"), r["row_span"].alias("rowSpan"), r["col_span"].alias("columnSpan"))


def image_marker(marker: Column) -> Column:
    """The public form of an image marker, a map of strings; what the source lacks is left out."""
    names = {"binary_item_ref": "sourceRef", "image_parts": "sourceParts", "fallback_text": "fallbackText", "check_marker_text": "checkText", "brightness": "rendering/brightness", "bright": "rendering/brightness", "contrast": "rendering/contrast", "effect": "rendering/effect", "alpha": "rendering/alpha"}
    fixed = [F.struct(F.lit("kind").alias("key"), F.lit("image").alias("value")), F.struct(F.lit("basis").alias("key"), F.lit("source_image_reference").alias("value"))]
    # Of two names of one thing the later one counts.
    found = [F.when(F.map_contains_key(marker, source), F.struct(F.lit(public).alias("key"), marker[source].alias("value"))) for source, public in names.items() if source != "brightness"]
    first = F.when(F.map_contains_key(marker, "brightness") & ~F.map_contains_key(marker, "bright"), F.struct(F.lit("rendering/brightness").alias("key"), marker["brightness"].alias("value")))
    return F.map_from_entries(F.filter(F.array(*fixed, *found, first), lambda x: x.isNotNull()))


def job_results(jobs: DataFrame, results: DataFrame, deleted: DataFrame) -> DataFrame:
    """(job_id, execution, revision, outcome) of jobs that are not deleted: their saved result, or that it is not ready."""
    live = jobs.join(deleted.select("job_id"), "job_id", "left_anti")
    met = live.join(results.select("job_id", F.coalesce("revision", F.lit(0)).alias("revision"), F.col("status").alias("result")), "job_id", "left")
    return met.select("job_id", F.col("status").alias("execution"), "revision", F.coalesce("result", F.lit("result-not-ready")).alias("outcome"))


def record_windows(saved: DataFrame, answered: DataFrame, budget: int) -> DataFrame:
    """(task_id, window_id, record): windows of tasks with the answered ones put in; a task beyond its budget of characters keeps what was saved.

    Both have (task_id, window_id, record).
    """
    keys = ["task_id", "window_id"]
    merged = saved.join(answered.select(*keys), keys, "left_anti").unionByName(answered)
    over = merged.groupBy("task_id").agg(F.sum(F.length("window_id") + F.length("record")).alias("n")).where(F.col("n") > budget).select("task_id")
    return merged.join(over, "task_id", "left_anti").unionByName(saved.join(over, "task_id", "left_semi"))
