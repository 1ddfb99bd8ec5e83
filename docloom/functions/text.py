"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexemes, and label/value pairs: a label up to ":" or "=", a value up to ";" or the line's end. Fixed values.
LEXEME = r"[^\s;,:=]+"
FIELD = r"(?:^|[;\n])\s*([^;\n:=]+?)\s*[:=]([^;\n]*)"


def normalize_text(c: Column) -> Column:
    """Line ends become LF, each line loses its trailing white space, the whole is stripped (Unicode white space)."""
    lf = F.regexp_replace(c, r"\r\n?|[\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]", "\n")
    ends = F.regexp_replace(lf, r"(?U)[^\S\n]+(?=\n)", "")
    return strip(ends)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def chunks(c: Column, size: int) -> Column:
    """The parts of size code points of a text; none for an empty or null one."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def lexemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LEXEME), F.lit(0))


def lexeme_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LEXEME))


def label_values(c: Column) -> Column:
    """array<struct<label, value>> of the label/value pairs; values are stripped."""
    labels = F.regexp_extract_all(c, F.lit(FIELD), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(FIELD), F.lit(2))
    return F.zip_with(labels, values, lambda a, b: F.struct(a.alias("label"), strip(b).alias("value")))


def escape_markdown(c: Column) -> Column:
    r"""Characters that would structure Markdown get a backslash: \ ` * _ [ ] < > everywhere, # + - and "1." at a line's start."""
    inline = F.regexp_replace(c, r"([\\`*_\[\]<>])", r"\\$1")
    return F.regexp_replace(inline, r"(?m)^([ \t]*)([#+-]|\d+[.)])(?=\s)", r"$1\\$2")


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_prefixes(c: Column) -> Column:
    """All prefixes of a JSON pointer that end before a slash, and itself; without the empty one."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def pointer_under(path: Column, prefix: Column) -> Column:
    """Whether path is prefix or lies below it."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def pointer_rewrite(path: Column, old: Column, new: Column) -> Column:
    """path with prefix old replaced by new; others unchanged."""
    return F.when(pointer_under(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def occurrences(text: Column, quote: Column) -> Column:
    """How often quote occurs in text, overlapping hits counted; 0 for an empty quote."""
    n = F.length(text) - F.length(quote) + 1
    found = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.length(quote)) == quote)
    return F.when((F.length(quote) > 0) & F.contains(text, quote), F.size(found)).otherwise(0)
