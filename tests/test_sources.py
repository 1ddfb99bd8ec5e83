"""Readers on small documents built here."""

import io
import random
import struct
import zipfile
import zlib

from docloom.sources import files, html, hwp, packages, text

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = (
        "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:br/><w:t>two</w:t></w:r></w:p>"
        f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=' + repr('restart') + '/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}</w:tr><w:tr>{cell('d', '<w:gridSpan w:val=' + repr('2') + '/>')}</w:tr></w:tbl>"
    )
    return package(
        {
            "word/document.xml": f"<w:document xmlns:w='{W}'><w:body>{body}</w:body></w:document>",
            "word/_rels/document.xml.rels": f"<Relationships xmlns='{P}'><Relationship Id='r1' Target='footnotes.xml'/></Relationships>",
            "word/footnotes.xml": f"<w:footnotes xmlns:w='{W}'><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>",
        }
    )


def xlsx():
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rows = "<c r='A1' t='s'><v>0</v></c><c r='A2'><v>5</v></c><c r='B2' t='b'><v>1</v></c><c r='C2'><f>A2*2</f><v>10</v></c><c r='D2'/><c r='E2' t='inlineStr'><is><t>in</t></is></c>"
    return package(
        {
            "xl/workbook.xml": f"<workbook xmlns='{ns}' xmlns:r='{R}'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f"<Relationships xmlns='{P}'><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>",
            "xl/sharedStrings.xml": f"<sst xmlns='{ns}'><si><r><t>he</t></r><r><t>ad</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{ns}'><sheetData><row>{rows}</row></sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>",
        }
    )


def record(tag, level, body):
    if len(body) < 0xFFF:
        return struct.pack("<I", tag | level << 10 | len(body) << 20) + body
    return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(body)) + body


def compound(streams):
    """A compound file whose streams all lie in the large chain."""
    size, free, end = 512, 0xFFFFFFFF, 0xFFFFFFFE
    sectors, fat, entries = [], [], []

    def add(data):
        first = len(sectors)
        n = max(1, -(-len(data) // size))
        for i in range(n):
            sectors.append(data[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(first + i + 1 if i < n - 1 else end)
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, add(data), len(data)))
    raw = lambda name, kind, right, child, start, total: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", len(name) * 2 + 2, kind, 1) + struct.pack("<III", free, right, child) + b"\0" * 36 + struct.pack("<IQ", start, total)
    flat = [n for n, *_ in entries if "/" not in n]
    inner = [e for e in entries if "/" in e[0]]
    directory = [raw("Root Entry", 5, free, 1, end, 0)]
    for i, (n, k, s, t) in enumerate(e for e in entries if e[0] in flat):
        directory.append(raw(n, k, 2 + i, free, s, t))
    directory.append(raw("BodyText", 1, free, len(directory) + 1, 0, 0))
    for i, (n, k, s, t) in enumerate(inner):
        directory.append(raw(n.split("/")[1], k, len(directory) + 1 if i < len(inner) - 1 else free, free, s, t))
    first_dir = add(b"".join(directory))
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff"))
    head = hwp.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", 1, first_dir, 0, 4096, end, 0, end, 0, fat_at)
    return head.ljust(size, b"\xff") + b"".join(sectors)


def test_docx():
    got = packages.read_units(docx(), "docx")
    assert [(u["unit_type"], u["content"]) for u in got] == [("heading", "Title"), ("paragraph", "one\ntwo"), ("table_cell", "a"), ("table_cell", "b"), ("table_cell", "c"), ("table_cell", "d"), ("footnote", "note")]
    assert got[0]["level"] == 2 and got[2]["row_span"] == 2 and got[5]["col_span"] == 2


def test_xlsx():
    got = packages.read_units(xlsx(), "xlsx")
    assert [(u["content"], u.get("kind")) for u in got] == [("S", None), ("head", "string"), ("5", "integer"), ("true", "boolean"), ("10", "formula"), ("", "blank"), ("in", "string")]
    assert got[1]["col_span"] == 2 and got[4]["formula"] == "A2*2" and got[4]["raw"] == "10"


def test_hostile_packages_become_issues():
    bad = package({"word/document.xml": "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>"})
    assert [u["content"] for u in packages.read_units(bad, "docx")] == ["part_doctype"]
    assert [u["unit_type"] for u in packages.read_units(b"no zip", "xlsx")] == ["issue"]
    assert [u["content"] for u in packages.read_units(package({"a": "b"}), "docx")] == ["part_missing"]
    assert packages.read_units(b"x", "hwp5")[0]["unit_type"] == "issue"


def test_hwp():
    para = "안녕 text".encode("utf-16-le") + struct.pack("<8H", 11, 1, 2, 3, 4, 5, 6, 11) + "end".encode("utf-16-le")
    assert hwp.paragraph_text(para) == ("안녕 textend", 1)
    body = record(66, 0, b"abc") + record(67, 1, para) + record(67, 1, "x".encode("utf-16-le") * 3000)
    assert [(t, lv, len(b)) for _, t, lv, b in hwp.records(body)] == [(66, 0, 3), (67, 1, len(para)), (67, 1, 6000)]
    engine = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = engine.compress(body) + engine.flush()
    data = compound({"FileHeader": b"\0" * 36 + struct.pack("<I", 1), "BodyText/Section0": packed})
    assert set(hwp.streams(data)) == {"FileHeader", "BodyText/Section0"}
    assert [u["content"] for u in packages.read_units(data, "hwp5")] == ["안녕 textend", "x" * 3000]


def test_html_blocks_and_cells():
    got = html.block_units("<h1>A</h1><p>one <b>two</b><br>three</p><script>x</script><ul><li>i</li></ul><h2>B</h2><td>c</td>")
    assert [(u["unit_type"], u["content"], u["heading_path"]) for u in got] == [("heading", "A", ["A"]), ("paragraph", "one  two\n three", ["A"]), ("paragraph", "i", ["A"]), ("heading", "B", ["A", "B"]), ("table", "c", ["A", "B"])]
    assert html.block_units("<div>only text</div>")[0]["unit_type"] == "document_text"
    cells = html.table_cells("<table><tr><th rowspan=2>a<th colspan=2>b</tr><tr><td>c<td></tr><tr><td rowspan=0>d<td colspan=x>e</tr></table>")
    assert [(c["row"], c["col"], c["text"], c["issue"]) for c in cells] == [(0, 0, "a", None), (0, 1, "b", None), (1, 1, "c", None), (1, 2, "", None), (2, 0, "d", None), (2, 1, "e", "span_invalid")]


def test_html_blocks_are_the_outermost_intervals():
    """Against the definition, token by token and quadratic."""
    rng = random.Random(11)
    names = ["p", "div", "li", "b", "br", "h1", "h3", "script", "td"]
    for _ in range(400):
        source = "".join(rng.choice([f"<{n}>", f"</{n}>", f"t{i} ", f"<{n}/>"]) for i in range(rng.randrange(25)) for n in [rng.choice(names)])
        rows, quiet, audible = html.tokens(source), 0, []
        for step, name in rows:
            if name == "script" and step and (step > 0 or quiet):
                quiet += step
            elif not quiet:
                audible.append((step, name))
        step_of = [0 if s > 0 and n == "br" else s for s, n in audible]
        spans = {}
        for i, (s, n) in enumerate(audible):
            if s > 0 and n in html.BLOCKS:
                ends = [j for j in range(i + 1, len(audible)) if sum(step_of[i + 1 : j + 1]) < 0]
                spans[i] = ends[0] if ends else None
        outer = [(i, e) for i, e in spans.items() if not any(o < i and (f is None or i < f) for o, f in spans.items())]
        want = []
        for i, e in outer:
            parts = [n if not s else "\n" for s, n in audible[i + 1 : e] if not s or s > 0 and n == "br"]
            if e is not None and " ".join(parts).strip():
                want.append((audible[i][1], " ".join(parts).split()))
        got = [(u["tag"], u["content"].split()) for u in html.block_units(source) if u["tag"]]
        assert got == want, source
        paths = []
        for tag, text in want:
            if tag in html.HEADINGS:
                paths = paths[: html.HEADINGS[tag] - 1] + [text]
        if got:
            assert [x.split() for x in html.block_units(source)[-1]["heading_path"]] == paths
    assert html.block_units("<h3>deep</h3><h2>up</h2><p>x</p>")[2]["heading_path"] == ["deep", "up"]
    assert html.block_units("<p>open <div>x") == [] and html.block_units(None) == []
    assert len(html.block_units("<p>x</p>" * 30000)) == 30000


def test_markdown(spark):
    source = "# A #\n\ntext\nmore\n## B\n| x | y |\n|---|:-:|\n| 1 | 2\\|3 |\n\n[^q]: note\n"
    df = spark.createDataFrame([(1, source), (2, None)], "doc_id long, t string")
    got = text.markdown(df, "doc_id", "t").orderBy("ordinal").collect()
    assert [(r["unit_type"], r["content"]) for r in got] == [("heading", "A"), ("paragraph", "text\nmore"), ("heading", "B"), ("table_cell", "x"), ("table_cell", "y"), ("table_cell", "1"), ("table_cell", "2|3"), ("footnote", "note")]
    assert got[2]["heading_path"] == ["A", "B"] and (got[1]["line_start"], got[1]["line_end"]) == (3, 4)


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.txt").write_text("p1\n\np2")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.hwpx").write_bytes(compound({"FileHeader": b"\0" * 40, "BodyText/Section0": record(67, 0, "hi".encode("utf-16-le"))}))
    loaded = files.load(spark, str(tmp_path))
    assert {r["path"][-6:]: (r["status"], r["adapter"]) for r in loaded.collect()} == {"a.docx": ("supported", "docx"), "b.xlsx": ("supported", "xlsx"), "/c.txt": ("supported", "text"), "/d.exe": ("unsupported", None), "e.hwpx": ("supported", "hwp5")}
    counts = {r["path"][-6:]: r["count"] for r in files.extract(loaded).groupBy("path").count().collect()}
    assert counts == {"a.docx": 7, "b.xlsx": 7, "e.hwpx": 1}
    assert [r["content"] for r in text.read_text(spark, str(tmp_path / "c.txt")).orderBy("paragraph").collect()] == ["p1", "p2"]
