"""JSON, pixels, metafiles and other programs' outputs."""

import json
import struct
import sys

import numpy as np
import pytest

from docloom.functions import json as J
from docloom.operators import pixels
from docloom.sources import frames


def test_strict_json(spark):
    for bad in ('{"a":1,"a":2}', "NaN", "[1", "{'a':1}"):
        with pytest.raises(ValueError):
            J.decode(bad)
    df = spark.createDataFrame([(0, '{"b": 1, "a": [1.50, "é"]}'), (1, '{"a":1,"a":2}'), (2, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(J.canonical_column(df["t"])).collect()] == ['{"a":[1.5,"é"],"b":1}', None, None]


def test_pointers_and_schemas():
    value = {"a/b": [1, {"~": None}], "e": {}}
    assert J.leaves(value) == {"/a~1b/0", "/a~1b/1/~0", "/e"}
    assert J.lookup(value, "/a~1b/1/~0") is None and J.lookup(value, "") == value
    for path in ("/a", "/a~1b/2", "/a~1b/00", "x"):
        with pytest.raises(KeyError):
            J.lookup(value, path)
    assert J.schema_error({"properties": {"x": {"$ref": "#/$defs/y"}}, "$defs": {"y": {"type": "string"}}}) is None
    assert J.schema_error({"$defs": {"y": {"$ref": "#/$defs/y"}}, "$ref": "#/$defs/y"}) == "reference_circular"
    assert J.schema_error({"pattern": "x"}) == "keyword:pattern" and J.schema_error({"$ref": "http://x"}) == "reference_not_local" and J.schema_error({"$ref": "#/z"}) == "reference_missing"
    deep = {}
    for _ in range(200):
        deep = {"items": deep}
    assert J.schema_error(deep) == "schema_budget"
    assert J.targets({"properties": {"b": {"properties": {"c": {}}}, "a": {"items": {"properties": {"d": {}}}}}}) == ["/b", "/b/c", "/a", "/a/*", "/a/*/d"]


@pytest.mark.parametrize("seed", range(8))
def test_components_equal_flood_fill(seed):
    rng = np.random.default_rng(seed)
    rgb = np.where(rng.random((19, 17, 1)) < 0.3 + seed * 0.05, rng.integers(0, 255, (19, 17, 3)), 255).astype(np.uint8)
    ink = rgb.min(axis=2) != 255
    left = {(int(r), int(c)) for r, c in zip(*np.nonzero(ink), strict=True)}
    sizes = []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        sizes.append(n)
    seen = pixels.observe(rgb)
    assert sorted(p["pixels"] for p in seen["components"]) == sorted(sizes)
    assert seen["accounted"] and seen["ink"] == int(ink.sum())


def test_blank_page():
    assert pixels.observe(np.full((4, 4, 3), 255, dtype=np.uint8))["components"] == []


def emf(records):
    body = b"".join(records) + struct.pack("<IIIII", 14, 20, 0, 0, 20)
    head = struct.pack("<II", 1, 108) + b"\0" * 32 + b" EMF" + b"\0" * 4 + struct.pack("<II", 108 + len(body), len(records) + 2)
    return head.ljust(108, b"\0") + body


def test_metafile_strings():
    text = "héé!".encode("utf-16-le")
    record = struct.pack("<II", 84, 76 + len(text)) + b"\0" * 36 + struct.pack("<III", 4, 76, 0) + b"\0" * 20 + text
    glyphs = struct.pack("<II", 84, 76 + len(text)) + b"\0" * 36 + struct.pack("<III", 4, 76, 16) + b"\0" * 20 + text
    data = emf([struct.pack("<III", 9, 12, 0), record, glyphs])
    assert frames.emf_strings(data) == [(2, "héé!")]
    for bad in (data[:-4], data + b"\0" * 4, b"x" * 200):
        with pytest.raises(frames.MetafileError):
            frames.emf_strings(bad)


def test_frames_and_words(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"page": 1}\n{"page": 2, "x": " "}\n{"pag')
    assert sorted(r["page"] for r in frames.json_frames(spark, str(tmp_path / "a.jsonl"), "page int").collect()) == [1, 2]
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "b.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\t007"\n5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t90\t \n5\t1\t1\t1\t1\t3\t0\t0\t0\t9\t90\tx\n')
    assert [(r["text"], r["width"]) for r in frames.words(spark, str(tmp_path / "b.tsv")).collect()] == [('007"', 9)]


def test_adapters(spark):
    echo = [sys.executable, "-c", "import sys,json; r=json.load(sys.stdin); print(json.dumps({'got': r['payload']}))"]
    df = spark.createDataFrame([(1, "x")], "k int, p string")
    assert json.loads(frames.adapt(df, "k", "p", echo).first()["result"]) == {"got": "x"}
    assert frames.run_adapter([sys.executable, "-c", "import time; time.sleep(9)"], {}, 0.5)["issue"] == "adapter_timeout_failed"
    assert frames.run_adapter([sys.executable, "-c", "print(1); print(2)"], {})["issue"] == "adapter_result_failed"
    assert frames.run_adapter(["/no/such/program"], {})["issue"] == "adapter_unavailable"
