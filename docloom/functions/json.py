"""Strict JSON: canonical text, pointers, leaves and bounded schemas, as plain functions and as Arrow columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_VISITS = 100, 10_000
# Schema keywords that would fetch, recurse or run patterns.
REFUSED = frozenset(("$id", "$dynamicRef", "$recursiveRef", "pattern", "patternProperties"))


def _object(pairs: list[tuple[str, Any]]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("duplicate_key")
    return made


def _constant(name: str):
    raise ValueError("non_finite_number")


def decode(text: str) -> Any:
    """A JSON value; repeated keys and non-finite numbers are errors."""
    return json.loads(text, object_pairs_hook=_object, parse_constant=_constant)


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def lookup(value: Any, path: str) -> Any:
    """The value at a JSON pointer; a KeyError where there is none."""
    if path and not path.startswith("/"):
        raise KeyError(path)
    for raw in path.split("/")[1:]:
        step = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and step in value:
            value = value[step]
        elif isinstance(value, list) and step.isdecimal() and (step == "0" or step[0] != "0") and int(step) < len(value):
            value = value[int(step)]
        else:
            raise KeyError(path)
    return value


def leaves(value: Any) -> set[str]:
    """Pointers of all scalars and empty containers."""
    out, todo = set(), [(value, "")]
    while todo:
        v, path = todo.pop()
        steps = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        inner = [(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}") for k, x in steps]
        todo += inner
        if not inner:
            out.add(path)
    return out


def schema_error(schema: Any) -> str | None:
    """Why a schema is refused: its size, a keyword, or a reference that is not local, missing or circular."""
    seen = 0
    todo: list[tuple[Any, int, tuple[str, ...]]] = [(schema, 0, ())]
    while todo:
        value, depth, above = todo.pop()
        seen += 1
        if seen > MAX_VISITS or depth > MAX_DEPTH:
            return "schema_budget"
        if isinstance(value, list):
            todo += [(x, depth + 1, above) for x in value]
        elif isinstance(value, dict):
            if refused := sorted(REFUSED & value.keys()):
                return f"keyword:{refused[0]}"
            for key, x in value.items():
                if key != "$ref":
                    todo.append((x, depth + 1, above))
                elif not isinstance(x, str) or not x.startswith("#/"):
                    return "reference_not_local"
                elif x in above:
                    return "reference_circular"
                else:
                    try:
                        todo.append((lookup(schema, x[1:]), depth + 1, (*above, x)))
                    except KeyError:
                        return "reference_missing"
    return None


def targets(schema: Any) -> list[str]:
    """Pointers of a schema's declared properties, depth first, each before those below it."""
    out: list[str] = []
    todo = [(schema, "")]
    while todo:
        node, path = todo.pop()
        if path:
            out.append(path)
        below = []
        if isinstance(node, dict):
            below = [(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}") for k, x in (node.get("properties") or {}).items()]
            if isinstance(node.get("items"), dict):
                below.append((node["items"], path + "/*"))
        todo += reversed(below)
    return out


def column(func: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """func over a text column in Arrow batches; what it refuses with a ValueError is null."""

    def safe(text: str | None) -> str | None:
        try:
            return None if text is None else func(text)
        except (ValueError, RecursionError):
            return None

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([safe(t) for t in batch.to_pylist()], pa.string())

    return run


def canonical_column(c: Column) -> Column:
    """Canonical text of a JSON column; null for text that is not strict JSON."""
    return column(lambda t: canonical(decode(t)))(c)


def schema_error_column(c: Column) -> Column:
    """Why a schema's text is refused; "not_strict" for text that is not strict JSON, null for a schema that may be used."""

    def judge(text: str) -> str | None:
        try:
            return schema_error(decode(text))
        except (ValueError, RecursionError):
            return "not_strict"

    return column(judge)(c)


def _rows(df: DataFrame, key: str, text: str, schema: str, func: Callable[[Any], list[tuple]]) -> DataFrame:
    """(key, ...) rows of func over strict JSON texts; other texts give none."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    found = func(decode(t)) if t is not None else []
                except (ValueError, RecursionError):
                    found = []
                if found:
                    cols = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(0).type), *cols], names=[key, *names])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")


def leaf_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pointer, value): the leaves of each JSON text with their canonical values."""
    return _rows(df, key, text, "pointer string, value string", lambda v: [(p, canonical(lookup(v, p))) for p in sorted(leaves(v))])


def target_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, pointer): the declared properties of each schema in order."""
    return _rows(df, key, text, "place long, pointer string", lambda v: list(enumerate(targets(v))))
