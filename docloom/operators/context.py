"""What surrounds a value: outlines with doubt, header groups, origins, numerals, and the shared parts of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import relations

# The numerals that are offered as choices, and the bounds of that offer.
NUMERAL = r"(?<![\w.,])[+-]?(?:[0-9]+(?:[.,][0-9]+)*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?!\w|[.,][0-9])"
MAX_LITERALS, MAX_SOURCE_CHARS, AROUND = 256, 100_000, 24
#: The same for Java, which looks behind by UTF-16 units: up to two, as a letter or digit may take both.
_JAVA = r"(?U)(?<![\w.,]{1,2})" + NUMERAL
#: Roles that open a section, and those that stand outside sections.
HEADINGS, OUTSIDE = ("title", "section_heading"), ("header", "footer")


def outline(df: DataFrame, partition: list[str], order: str, role: str, level: str, certain: str, ref: str, deepest: int = 9) -> DataFrame:
    """df with parent and parent_status: sections by certain headings, unresolved where a doubtful heading may intervene.

    A doubtful heading or unresolved block of level k (0 if it has none) leaves doubt until a certain heading of level k
    or above, itself included.  So doubt is one comparison for each level: the latest doubtful row of that level
    against the latest certain heading that ends it.
    """
    heading = F.col(role).isin(*HEADINGS)
    rows = df.withColumn("__level", F.when(heading & F.col(certain), F.col(level)))
    rows = rows.withColumn("__doubt", F.when(~F.col(certain) & (heading | (F.col(role) == "unresolved")), F.coalesce(F.col(level), F.lit(0))))
    upto = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.lit(False)
    for k in range(deepest + 1):
        doubtful = F.max(F.when(F.col("__doubt") == k, F.col(order))).over(upto)
        ended = F.max(F.when(F.col("__level") <= k, F.col(order))).over(upto)
        open_ = open_ | (doubtful.isNotNull() & (ended.isNull() | (doubtful > ended)))
    placed = relations.outline_certain(rows.withColumn("__open", open_), partition, order, "__level", ref, deepest)
    parent = F.when(~F.col("__open") & ~F.col(role).isin(*OUTSIDE), F.col("parent"))
    status = F.when(F.col("__open"), "unresolved").otherwise("resolved")
    return placed.withColumn("parent", parent).withColumn("parent_status", status).drop("__level", "__doubt", "__open")


def place_nested(elements: DataFrame, nested: DataFrame, ref: str, order: str) -> DataFrame:
    """elements with nested tables put under the table around them; one that does not come first is no parent.

    elements has parent and parent_status, nested (child, outer), one row a child.
    """
    outer = nested.join(elements.select(F.col(ref).alias("outer"), F.col(order).alias("__outer_at")), "outer")
    met = elements.join(outer, F.col(ref) == F.col("child"), "left")
    before = F.col("__outer_at") < F.col(order)
    parent = F.when(F.col("outer").isNull(), F.col("parent")).when(before, F.col("outer"))
    status = F.when(F.col("outer").isNull(), F.col("parent_status")).when(before, "resolved").otherwise("unresolved")
    return met.withColumns({"parent": parent, "parent_status": status}).select(*elements.columns)


def header_groups(headers: DataFrame, columns: DataFrame, blocked: DataFrame) -> DataFrame:
    """(table_id, header, columns): headers over two columns or more, each with a definition of its own that cites the header.

    headers has (table_id, header, col, span), columns (table_id, col, definition, sources), blocked (table_id, col).
    """
    over = headers.where("span >= 2").select("table_id", "header", "span", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("span") - 1)).alias("col"))
    met = over.join(columns, ["table_id", "col"], "left").join(blocked.distinct().withColumn("__blocked", F.lit(True)), ["table_id", "col"], "left")
    good = F.coalesce(F.array_contains("sources", F.col("header")), F.lit(False)) & F.col("__blocked").isNull()
    found = met.groupBy("table_id", "header", "span").agg(F.array_sort(F.collect_set("col")).alias("columns"), F.count_distinct("definition").alias("__n"), F.count("definition").alias("__all"), F.min(good).alias("__good"))
    return found.where("__good AND __n = span AND __all = span").select("table_id", "header", "columns")


def scalar_origins(values: DataFrame, cells: DataFrame, nodes: DataFrame, text_chars: int = 500) -> DataFrame:
    """(item, status, source_ref, value_text, truncated, locations, complete): where the value of each item was read.

    values has (item, status, source_ref, raw), cells (source_ref, table_id, row, col), nodes (source_ref).  An item
    without a source has no text and no places; one is complete if its node is known and its text whole.
    """
    places = cells.groupBy("source_ref").agg(F.array_sort(F.collect_set(F.struct("table_id", "row", "col"))).alias("locations"))
    known = nodes.select("source_ref").distinct().withColumn("__known", F.lit(True))
    met = values.join(places, "source_ref", "left").join(known, "source_ref", "left")
    there, whole = F.col("source_ref").isNotNull(), F.length("raw") <= text_chars
    return met.select(
        "item",
        "status",
        "source_ref",
        F.when(there, F.left("raw", F.lit(text_chars))).alias("value_text"),
        F.when(there, ~whole).alias("truncated"),
        F.when(there, F.coalesce("locations", F.array().cast(places.schema["locations"].dataType))).alias("locations"),
        F.when(there, F.col("__known").isNotNull() & whole).otherwise(True).alias("complete"),
    )


def literal_choices(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, literal, start, stop, occurrence, before, after): the numerals of a text with what stands around them.

    occurrence counts all earlier places of the same characters, those inside other numerals too.  Beyond the bounds
    no choice is offered at all, rather than the first ones; such a text has one row with its status.
    """
    t = F.col(text)
    long_ = F.length(t) > MAX_SOURCE_CHARS
    found = df.select(key, t.alias("__t"), F.when(~long_, F.regexp_extract_all(t, F.lit(_JAVA), F.lit(0))).alias("__m"))
    status = F.when(F.col("__m").isNull() & F.col("__t").isNotNull(), "source_limit").when(F.size("__m") > MAX_LITERALS, "candidate_limit").otherwise("available")
    offered = found.withColumn("status", status).withColumn("__gaps", F.when(F.col("status") == "available", F.split("__t", _JAVA)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda m, i: total(F.slice("__gaps", F.lit(1), i + 1)) + total(F.slice("__m", F.lit(1), i))
    listed = F.when(F.col("status") == "available", F.transform("__m", lambda m, i: F.struct(m.alias("literal"), start(m, i).alias("start"))))
    rows = offered.select(key, "status", "__t", F.explode_outer(listed).alias("c")).select(key, "status", "__t", "c.literal", "c.start")
    stop = F.col("start") + F.length("literal")
    before = F.regexp_count(F.left("__t", stop - 1), F.concat(F.lit(r"(?=\Q"), F.col("literal"), F.lit(r"\E)")))
    ahead = F.substring("__t", F.greatest(F.col("start") - AROUND, F.lit(0)) + 1, F.least(F.col("start"), F.lit(AROUND)))
    behind = F.substring("__t", stop + 1, F.lit(AROUND))
    there = F.col("literal").isNotNull()
    return rows.select(key, "status", "literal", "start", stop.alias("stop"), before.alias("occurrence"), F.when(there, ahead).alias("before"), F.when(there, behind).alias("after"))


def column_templates(values: DataFrame, group: str, ref: str, path: str, value: str, text: str) -> DataFrame:
    """(group, shape, path, placement, like, n): how the records of a shape can share what they repeat, without loss.

    values has a row for each record and path.  placement is text where every value is the record's text, shared where
    all are equal, else column; like is the first path whose column has the same values.  Shapes of one record are left
    out.  Columns are compared by two sums of hashes of (record, value), so no column is gathered.
    """
    paths = values.groupBy(group, ref).agg(F.array_sort(F.collect_set(path)).alias("__paths")).select(group, ref, F.sha2(F.to_json("__paths"), 256).alias("shape"))
    rows = values.join(paths, [group, ref])
    pair = lambda salt: F.sum(F.xxhash64(F.lit(salt), F.col(ref), F.col(value)).cast("decimal(38,0)"))
    one = F.min(F.struct(value)).eqNullSafe(F.max(F.struct(value)))
    found = rows.groupBy(group, "shape", path).agg(
        F.count("*").alias("n"), one.alias("__one"), F.min(F.col(value).eqNullSafe(F.col(text)) & F.col(text).isNotNull()).alias("__text"), pair(1).alias("__a"), pair(2).alias("__b")
    )
    placement = F.when(F.col("__text"), "text").when(F.col("__one"), "shared").otherwise("column")
    found = found.where("n > 1").withColumn("placement", placement)
    like = F.min(path).over(Window.partitionBy(group, "shape", "placement", "__a", "__b"))
    return found.select(group, "shape", path, "placement", F.when(F.col("placement") == "column", like).alias("like"), "n")


def merged(template: Column, patch: Column) -> Column:
    """A map of paths to leaves with those of a patch put in: a leaf replaces what stood at, above or below its path.

    An empty object, the leaf {}, changes nothing where the template has an object.
    """
    under = lambda low, high: low.startswith(F.concat(high, F.lit("/")))
    object_there = lambda k: F.exists(F.map_keys(template), lambda t: under(t, k))
    put = F.map_filter(patch, lambda k, v: ~((v == "{}") & object_there(k)))
    covered = lambda k: F.exists(F.map_keys(put), lambda p: (p == k) | under(k, p) | under(p, k))
    return F.map_concat(F.map_filter(template, lambda k, v: ~covered(k)), put)


def routed_tables(regions: DataFrame) -> DataFrame:
    """(parent, child, table_ref): regions whose values were routed from a table of the region they came from.

    regions has (region, parent_region, table_ref, table_context).
    """
    child = regions.select(F.col("region").alias("child"), F.col("parent_region").alias("parent"), F.col("table_context").alias("table_ref")).where("child <> parent")
    return child.join(regions.select(F.col("region").alias("parent"), "table_ref"), ["parent", "table_ref"]).select("parent", "child", "table_ref")


def lost_content(previous: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """The distinct (key) of accepted occurrences and columns that a candidate no longer has."""
    return previous.select(*key).distinct().join(candidate.select(*key).distinct(), key, "left_anti")


def table_selectors(tables: DataFrame, addresses: DataFrame) -> DataFrame:
    """tables with table_index, basis and reason: the place of a table in its section, where that was verified.

    tables has (section, element), addresses (section, element, table_index).
    """
    met = tables.join(addresses, ["section", "element"], "left")
    placed, named = F.col("table_index").isNotNull(), F.col("section").isNotNull()
    return met.withColumn("basis", F.when(placed, "verified-section-xml-table-order")).withColumn("reason", F.when(named & ~placed, "xml-table-order-unverified"))


def relation_view(text: Column, role: Column, page: Column, box: Column, table: Column, row: Column, col: Column) -> Column:
    """What a decision over regions needs of a node: a cell by its table, row and column, another node by page and rounded box."""
    cell = row.isNotNull()
    rounded = F.struct(*(F.bround(box[c]).cast("long").alias(c) for c in ("left", "top", "right", "bottom")))
    return F.struct(text.alias("text"), F.when(~cell, role).alias("role"), F.when(~cell, page).alias("page"), F.when(~cell & box.isNotNull(), rounded).alias("bbox"), table.alias("table_ref"), row.alias("row"), col.alias("col"))


def paragraph_properties(df: DataFrame, data: str, shapes: DataFrame, styles: DataFrame) -> DataFrame:
    """df with para_shape, style, what shapes say of the former, style_name, and properties_unavailable.

    Bytes 8 and 9 of a paragraph's header number its shape, byte 10 its style.  shapes has (para_shape, ...), styles
    (style, style_name).  Both are joined as tables of a document are: by number.
    """
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")
    whole = F.length(data) >= 12
    rows = df.withColumn("para_shape", F.when(whole, byte(8) + byte(9) * 256)).withColumn("style", F.when(whole, byte(10)))
    met = rows.join(shapes.withColumn("__shape", F.lit(True)), "para_shape", "left").join(styles, "style", "left")
    return met.withColumn("properties_unavailable", F.col("__shape").isNull()).drop("__shape")


# What a decision may see of a node, and what of its place it may not.
NODE_FIELDS = "text semantic semanticRole semanticInput sourceStructure observationBasis parentRef normalization sourceSegments recognizedText".split()
PLACE_TRACES = "characters provenance rectangle tableBBox doclingRef backendCellIndex cellOrdinal recognitionBatch pdfium".split()


def model_nodes(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its keys and the fields a decision may see; places and inputs, structs, come without traces of recognition."""
    hidden = {"semanticInput": ["sourceSegments"], "sourceStructure": [*PLACE_TRACES, "bbox.sourceBox"]}

    def shown(name: str) -> Column:
        parts = df.select(f"{name}.*").schema if name in hidden else None
        if parts is None:
            return F.col(name)
        boxed = "bbox" in parts.names and hasattr(parts["bbox"].dataType, "names")
        there = [f for f in hidden[name] if f in parts.names or (boxed and f.startswith("bbox."))]
        return F.col(name).dropFields(*there).alias(name) if there else F.col(name)

    return df.select(*keys, *(shown(c) for c in NODE_FIELDS if c in df.columns))


def statement(ident: Column, status: Column, kind: Column, description: Column, refs: Column, texts: Column, ranges: Column) -> Column:
    """An unresolved statement as a task shows it: no description is an empty one, no texts or ranges are empty lists."""
    listed = lambda c: F.flatten(F.array_compact(F.array(c)))
    return F.struct(ident.alias("id"), status.alias("meaningStatus"), kind.alias("kind"), F.coalesce(description, F.lit("")).alias("description"), refs.alias("sourceRefs"), listed(texts).alias("sourceText"), listed(ranges).alias("sourceRanges"))
