"""Context operators against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import context as C

PATTERN = re.compile(C.NUMERAL)


def choices(text):
    """The offer for one text, numeral by numeral."""
    found = list(PATTERN.finditer(text))
    if len(text) > C.MAX_SOURCE_CHARS:
        return [("source_limit",) + (None,) * 6]
    if len(found) > C.MAX_LITERALS:
        return [("candidate_limit",) + (None,) * 6]
    out = []
    for m in found:
        s, e = m.span()
        earlier = sum(text.startswith(m[0], i) for i in range(s))
        out.append(("available", m[0], s, e, earlier, text[max(0, s - C.AROUND) : s], text[e : e + C.AROUND]))
    return out or [("available",) + (None,) * 6]


def offered(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    out = {}
    for r in C.literal_choices(df, "k", "t").collect():
        out.setdefault(r["k"], []).append(tuple(r)[1:])
    return {k: sorted(v, key=lambda x: (x[2] is not None, x[2])) for k, v in out.items()}


def test_numerals_equal_plain_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0019.,-+e x가é𝟙𠀀\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["001.2300 and 1.23, 1.23.", "5 " * C.MAX_LITERALS, "5 " * (C.MAX_LITERALS + 1), "7" + "a " * C.MAX_SOURCE_CHARS, "\\E 12 \\Q 12", "😀 3 😀 3"]
    got = offered(spark, texts)
    assert got == {i: choices(t) for i, t in enumerate(texts)}


def test_numerals_of_no_text(spark):
    df = spark.createDataFrame([(1, None)], "k long, t string")
    assert [tuple(r)[2:] for r in C.literal_choices(df, "k", "t").collect()] == [(None,) * 6]
    assert C.literal_choices(df.where("k < 0"), "k", "t").collect() == []


def test_numerals_of_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    out = {}
    for r in C.literal_choices(rows, "doc_id", "text").collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v, key=lambda x: (x[2] is not None, x[2])) for k, v in out.items()} == {k: choices(t) for k, t in texts.items()}


def flat(value, at=""):
    if isinstance(value, dict) and value:
        return {k: v for name, child in value.items() for k, v in flat(child, f"{at}/{name}").items()}
    return {at: "{}" if value == {} else str(value)}


def joined(template, patch):
    out = dict(template)
    for k, v in patch.items():
        out[k] = joined(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def test_patches_equal_a_recursive_merge(spark):
    rng = random.Random(2)

    def made(depth):
        names = rng.sample("abc", rng.randint(0, 3))
        return {n: made(depth - 1) if depth and rng.random() < 0.6 else rng.randint(0, 4) for n in names}

    pairs = [(made(3) | {"z": 0}, made(3)) for _ in range(300)]
    # An empty patch is a map without leaves, as an object at the root has no path.
    rows = [(i, flat(t), flat(p) if p else {}) for i, (t, p) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, t map<string,string>, p map<string,string>")
    got = {r["i"]: r["m"] for r in df.select("i", C.merged(F.col("t"), F.col("p")).alias("m")).collect()}
    assert got == {i: flat(joined(t, p)) for i, (t, p) in enumerate(pairs)}


@pytest.mark.parametrize("seed", range(2))
def test_outline_with_doubt_equals_a_stack(spark, seed):
    rng = random.Random(seed)
    roles = ["title", "section_heading", "section_heading", "paragraph", "unresolved", "header", "table"]
    rows, want = [], {}
    for d in range(6):
        stack, doubt = [], None
        for i in range(40):
            role = rng.choice(roles)
            sure = rng.random() < 0.8 and role != "unresolved"
            level = rng.randint(1, 4) if role in C.HEADINGS and (sure or rng.random() < 0.7) else None
            rows.append((d, i, role, level, sure, 100 * d + i))
            if not sure and (role in C.HEADINGS or role == "unresolved"):
                doubt = (level or 0) if doubt is None else min(doubt, level or 0)
            if sure and role in C.HEADINGS:
                stack = [s for s in stack if s[0] < level]
                if doubt is not None and level <= doubt:
                    doubt = None
            want[100 * d + i] = (stack[-1][1] if stack and doubt is None and role not in C.OUTSIDE else None, "resolved" if doubt is None else "unresolved")
            if sure and role in C.HEADINGS:
                stack.append((level, 100 * d + i))
    df = spark.createDataFrame(rows, "d int, i int, role string, level int, sure boolean, ref int")
    got = C.outline(df, ["d"], "i", "role", "level", "sure", "ref", 4)
    assert {r["ref"]: (r["parent"], r["parent_status"]) for r in got.collect()} == want
    nested = spark.createDataFrame([(5, 2), (7, 9)], "child int, outer int")
    placed = {r["ref"]: (r["parent"], r["parent_status"]) for r in C.place_nested(got, nested, "ref", "i").collect()}
    assert placed == want | {5: (2, "resolved"), 7: (None, "unresolved")}


def test_templates_lose_nothing(spark):
    rows = [("g", r, p, v) for r, (a, b, c) in enumerate([("1", "x", "1"), ("2", "x", "2"), ("2", "x", "2")]) for p, v in (("a", a), ("b", b), ("c", c), ("t", f"text {r}"), ("n", None))]
    rows += [("g", 9, "a", "1"), ("h", 0, "a", "1"), ("h", 1, "a", "1"), ("h", 1, "b", None)]
    df = spark.createDataFrame(rows, "g string, ref int, path string, value string").withColumn("text", F.concat(F.lit("text "), F.col("ref").cast("string")))
    got = {(r["g"], r["path"]): (r["placement"], r["like"], r["n"]) for r in C.column_templates(df, "g", "ref", "path", "value", "text").collect()}
    assert got == {("g", "a"): ("column", "a", 3), ("g", "b"): ("shared", None, 3), ("g", "c"): ("column", "a", 3), ("g", "t"): ("text", None, 3), ("g", "n"): ("shared", None, 3)}
