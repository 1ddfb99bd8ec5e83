"""Units to public projections: roles, levels, typed values, pages, text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The role of each unit type.
ROLES = {
    "caption": "caption", "chart_data": "data_value", "comment": "comment", "diagram_text": "diagram_text", "document_text": "paragraph", "embedded_object": "embedded_object",
    "endnote": "note", "field": "field", "footer": "footer", "footnote": "note", "header": "header", "heading": "heading", "list_item": "list_item", "page": "page",
    "paragraph": "paragraph", "section_paragraph": "paragraph", "sheet": "sheet", "sheet_cell": "sheet_cell", "slide_text": "paragraph", "speaker_notes": "note", "table": "table", "table_cell": "table_cell",
}


def role(unit_type: Column, tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return (
        F.when((unit_type == "table") & tag.isin("td", "th"), "table_cell")
        .when((unit_type == "table") & (tag == "tr"), "table_row")
        .otherwise(F.coalesce(table[unit_type], F.lit("content")))
    )


def level(marker: Column, own: Column, listed: Column) -> Column:
    """struct(level, index_base): a computed marker's level, else the unit's, else the list's (from 0)."""
    make = lambda c, base: F.when(c.isNotNull(), F.struct(c.cast("int").alias("level"), F.lit(base).alias("index_base")))
    return F.coalesce(make(marker, 1), make(own, 1), make(listed, 0))


def page_summary(units: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """(key, n_units, n_headings, n_paragraphs, n_issues, returned, next_offset): counts over all units of a page of them."""
    out = units.groupBy(key).agg(
        F.count("*").alias("n_units"),
        F.count_if(F.col("role") == "heading").alias("n_headings"),
        F.count_if(F.col("role") == "paragraph").alias("n_paragraphs"),
        F.sum(F.coalesce(F.col("n_issues"), F.lit(0))).alias("n_issues"),
    )
    rest = F.greatest(F.col("n_units") - offset, F.lit(0))
    return out.withColumn("returned", F.least(rest, F.lit(limit))).withColumn("next_offset", F.when(rest > limit, F.lit(offset + limit).cast("long")))


def markdown(units: DataFrame) -> Column:
    """A unit as Markdown: headings by level, list items with a dash, others as they are."""
    return (
        F.when(F.col("role") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(F.col("level"), F.lit(1)), F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), F.col("content")))
        .when(F.col("role") == "list_item", F.concat(F.lit("- "), F.col("content")))
        .otherwise(F.col("content"))
    )


def manifest(units: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, manifest): SHA-256 over the digests of a document's units in order; content is digested before it is gathered."""
    one = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields)), 256)
    return units.select(key, F.struct(F.col(order).alias("o"), one.alias("h")).alias("u")).groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda u: u["h"]), ""), 256).alias("manifest"))


def classify(name: Column) -> Column:
    """struct(extension, media_type, adapter, status) of a file name."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v[i])])[ext]
    status = F.when(name.isin(*IGNORED), "ignored").when(ext.isin(*FORMATS), "supported").otherwise("unsupported")
    return F.struct(ext.alias("extension"), pick(0).alias("media_type"), pick(1).alias("adapter"), status.alias("status"))


# Media type and adapter of each extension, and names that are passed by.
FORMATS = {
    "md": ("text/markdown", "markdown"),
    "markdown": ("text/markdown", "markdown"),
    "txt": ("text/plain", "text"),
    "html": ("text/html", "html"),
    "htm": ("text/html", "html"),
    "pdf": ("application/pdf", "pdf"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"),
    "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    "hwpx": ("application/vnd.hancom.hwpx", "hwpx"),
    "hwp": ("application/x-hwp", "hwp5"),
}
IGNORED = (".DS_Store",)
