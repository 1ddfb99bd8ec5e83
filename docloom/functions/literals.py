"""Exact literal grammars and typed reads; numbers stay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars of literals.
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^-?(0|[1-9][0-9]*)$"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
TYPES = ("string", "decimal", "integer", "number", "boolean", "null")


def decimal_literal(c: Column) -> Column:
    return F.rlike(F.trim(c), F.lit(DECIMAL))


def integer_literal(c: Column) -> Column:
    return F.rlike(c, F.lit(INTEGER))


def number_literal(c: Column) -> Column:
    return F.rlike(c, F.lit(NUMBER))


def exact_number(c: Column) -> Column:
    """A JSON number that a double holds without loss."""
    d = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    same = c.try_cast("decimal(38,18)") == d.cast("string").try_cast("decimal(38,18)")
    return number_literal(c) & d.isNotNull() & (d != float("inf")) & (d != float("-inf")) & F.coalesce(same, F.lit(False))


def readable(raw: Column, kind: str) -> Column:
    """Whether raw can be read as a value of the kind."""
    return {
        "string": raw.isNotNull(),
        "decimal": decimal_literal(raw),
        "integer": integer_literal(raw),
        "number": number_literal(raw),
        "boolean": raw.isin("true", "false"),
        "null": raw == "null",
    }[kind]


def typed_kind(raw: Column) -> Column:
    """The narrowest kind that raw can be read as."""
    out = F.lit("string")
    for kind in ("decimal", "number", "integer", "boolean", "null"):
        out = F.when(readable(raw, kind), kind).otherwise(out)
    return F.when(raw.isNotNull(), out)


def schema_kinds(kind: Column, status: Column) -> Column:
    """JSON Schema types of a value: its type, and "null" for one that is not present. Decimals are strings."""
    json = F.when(kind.isin("decimal", "native"), "string").otherwise(kind)
    return F.when(status == "present", F.array(json)).otherwise(F.array_distinct(F.array(json, F.lit("null"))))
