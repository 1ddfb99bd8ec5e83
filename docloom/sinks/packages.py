"""Small package writers: tables of blocks as word, sheet, slide and Hancom documents and metafiles, as bytes.

They write what the readers of this library read back, and nothing of looks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name spaces of the formats.
_OFFICE = "http://schemas.openxmlformats.org"
_W, _A, _PML, _S = (f"{_OFFICE}/{x}/2006/main" for x in ("wordprocessingml", "drawingml", "presentationml", "spreadsheetml"))
_R, _RELS = f"{_OFFICE}/officeDocument/2006/relationships", f"{_OFFICE}/package/2006/relationships"
_HP, _HH, _HS = (f"http://www.hancom.co.kr/hwpml/2011/{x}" for x in ("paragraph", "head", "section"))
_MAGIC, _FREE, _END, _FAT = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


#: Parts below this size are stored, as deflating them takes longer than it spares.
STORED = 512
#: Bytes of documents that go out at once.
BATCH_BYTES = 1 << 20
_DAY = 33  # 1980-01-01


def archive(parts: dict[str, str]) -> bytes:
    """A ZIP package of text parts with ASCII names; equal parts give equal bytes."""
    out, directory, at = [], [], 0
    for name, text in parts.items():
        body = text.encode()
        named, crc, size, method = name.encode("ascii"), zlib.crc32(body), len(body), 0
        if size >= STORED:
            engine = zlib.compressobj(1, zlib.DEFLATED, -15)
            body, method = engine.compress(body) + engine.flush(), 8
        if max(size, at) >= _FREE:
            raise ValueError("document_too_large")
        about = struct.pack("<5H3L2H", 20, 0, method, 0, _DAY, crc, len(body), size, len(named), 0)
        out += [b"PK\3\4", about, named, body]
        directory.append(b"PK\1\2\x14\0" + about + struct.pack("<3H2L", 0, 0, 0, 0, at) + named)
        at += 30 + len(named) + len(body)
    listed = b"".join(directory)
    if max(at, len(parts) << 16) >= _FREE:
        raise ValueError("document_too_large")
    return b"".join([*out, listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), len(listed), at, 0)])


def _links(targets: dict[str, str]) -> str:
    return f"<Relationships xmlns='{_RELS}'>" + "".join(f"<Relationship Id='{k}' Target={quoteattr(v)}/>" for k, v in targets.items()) + "</Relationships>"


def _letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheet_document(title: str, cells: list[tuple[int, int, str, str | None, str | None]], merges: list[tuple[int, int, int, int]] = ()) -> bytes:
    """One sheet of (row, col, kind, value, formula); kind is shared, inline, number, boolean or blank; merges are (row, col, rows, cols)."""
    shared: dict[str, int] = {}
    rows: dict[int, list[str]] = {}
    for r, c, kind, value, formula in sorted(cells, key=lambda x: x[:2]):
        ref = f"r='{_letters(c)}{r}'"
        f = f"<f>{escape(formula)}</f>" if formula else ""
        if kind == "shared":
            body = f"<c {ref} t='s'>{f}<v>{shared.setdefault(value or '', len(shared))}</v></c>"
        elif kind == "inline":
            body = f"<c {ref} t='inlineStr'><is><t>{escape(value or '')}</t></is></c>"
        elif kind == "blank":
            body = f"<c {ref}/>"
        else:
            body = f"<c {ref}{' t=' + repr('b') if kind == 'boolean' else ''}>{f}<v>{escape(value or '')}</v></c>"
        rows.setdefault(r, []).append(body)
    data = "".join(f"<row r='{r}'>{''.join(x)}</row>" for r, x in rows.items())
    merged = "".join(f"<mergeCell ref='{_letters(c)}{r}:{_letters(c + m - 1)}{r + n - 1}'/>" for r, c, n, m in merges)
    return archive(
        {
            "xl/workbook.xml": f"<workbook xmlns='{_S}' xmlns:r='{_R}'><sheets><sheet name={quoteattr(title)} r:id='r1'/></sheets></workbook>",
            "xl/_rels/workbook.xml.rels": _links({"r1": "worksheets/sheet1.xml"}),
            "xl/sharedStrings.xml": f"<sst xmlns='{_S}'>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{_S}'><sheetData>{data}</sheetData>" + (f"<mergeCells>{merged}</mergeCells>" if merged else "") + "</worksheet>",
        }
    )


def word_document(blocks: list[tuple], levels: list[tuple[int, str, str]] = (), notes: list[str] = ()) -> bytes:
    """Blocks ("heading", text, level), ("paragraph", text), ("item", text, level from 0) and ("table", rows of (text, span, merge)).

    merge is "restart", "continue" or None; levels are (start, format, pattern) of the one list of all items.
    """
    run = lambda text: f"<w:r><w:t>{escape(text)}</w:t></w:r>"

    def cell(text: str, span: int, merge: str | None) -> str:
        marks = (f"<w:gridSpan w:val='{span}'/>" if span > 1 else "") + ({"restart": "<w:vMerge w:val='restart'/>", "continue": "<w:vMerge/>"}.get(merge or "", ""))
        return f"<w:tc><w:tcPr>{marks}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"

    body = []
    for kind, *x in blocks:
        if kind == "table":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(cell(*c) for c in row) + "</w:tr>" for row in x[0]) + "</w:tbl>")
        else:
            shape = {"heading": lambda: f"<w:pStyle w:val='Heading{x[1]}'/>", "item": lambda: f"<w:numPr><w:ilvl w:val='{x[1]}'/><w:numId w:val='1'/></w:numPr>"}.get(kind, lambda: "")()
            body.append(f"<w:p><w:pPr>{shape}</w:pPr>{run(x[0])}</w:p>")
    shapes = "".join(f"<w:lvl w:ilvl='{i}'><w:start w:val='{s}'/><w:numFmt w:val='{f}'/><w:lvlText w:val={quoteattr(p)}/></w:lvl>" for i, (s, f, p) in enumerate(levels))
    return archive(
        {
            "word/document.xml": f"<w:document xmlns:w='{_W}'><w:body>{''.join(body)}</w:body></w:document>",
            "word/_rels/document.xml.rels": _links({"r1": "footnotes.xml"} if notes else {}),
            "word/numbering.xml": f"<w:numbering xmlns:w='{_W}'><w:abstractNum w:abstractNumId='0'>{shapes}</w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='0'/></w:num></w:numbering>",
            "word/footnotes.xml": f"<w:footnotes xmlns:w='{_W}'>" + "".join(f"<w:footnote><w:p>{run(x)}</w:p></w:footnote>" for x in notes) + "</w:footnotes>",
        }
    )


def slide_document(slides: list[tuple[list[tuple[str, str | None, int, int | None]], list[list[tuple[str, int]]], str]]) -> bytes:
    """Slides of paragraphs (text, scheme or None, level from 0, start or None), table rows of (text, span) and a note."""
    run = lambda text: f"<a:r><a:t>{escape(text)}</a:t></a:r>"
    parts, links = {}, {}
    for n, (paragraphs, rows, note) in enumerate(slides, 1):
        mark = lambda scheme, start: f"<a:buAutoNum type='{scheme}'" + (f" startAt='{start}'" if start is not None else "") + "/>" if scheme else "<a:buNone/>"
        body = "".join(f"<a:p><a:pPr lvl='{level}'>{mark(scheme, start)}</a:pPr>{run(text)}</a:p>" for text, scheme, level, start in paragraphs)
        grid = "".join("<a:tr>" + "".join(f"<a:tc gridSpan='{s}'><a:txBody><a:p>{run(t)}</a:p></a:txBody></a:tc>" + "<a:tc hMerge='1'/>" * (s - 1) for t, s in row) + "</a:tr>" for row in rows)
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld xmlns:p='{_PML}' xmlns:a='{_A}'><p:cSld><p:spTree><p:sp><p:txBody>{body}</p:txBody></p:sp><p:graphicFrame><a:tbl>{grid}</a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _links({"n1": f"../notesSlides/notesSlide{n}.xml"})
        parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes xmlns:p='{_PML}' xmlns:a='{_A}'><a:p>{run(note)}</a:p></p:notes>"
        links[f"r{n}"] = f"slides/slide{n}.xml"
    listed = "".join(f"<p:sldId r:id='{k}'/>" for k in links)
    return archive({"ppt/presentation.xml": f"<p:presentation xmlns:p='{_PML}' xmlns:r='{_R}'><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _links(links), **parts})


def hancom_document(blocks: list[tuple], levels: list[tuple[int, str, str]] = ()) -> bytes:
    """Blocks ("paragraph", text), ("item", text, level from 0), ("note", text) and ("table", cells of (row, col, rows, cols, text))."""
    run = lambda text: f"<hp:run><hp:t>{escape(text)}</hp:t></hp:run>"
    body = []
    for kind, *x in blocks:
        if kind == "table":
            rows: dict[int, str] = {}
            for r, c, n, m, text in x[0]:
                rows[r] = rows.get(r, "") + f"<hp:tc><hp:subList><hp:p>{run(text)}</hp:p></hp:subList><hp:cellAddr rowAddr='{r}' colAddr='{c}'/><hp:cellSpan rowSpan='{n}' colSpan='{m}'/></hp:tc>"
            body.append("<hp:p><hp:run><hp:tbl>" + "".join(f"<hp:tr>{rows[r]}</hp:tr>" for r in sorted(rows)) + "</hp:tbl></hp:run></hp:p>")
        elif kind == "note":
            body.append(f"<hp:p><hp:run><hp:ctrl><hp:footNote><hp:subList><hp:p>{run(x[0])}</hp:p></hp:subList></hp:footNote></hp:ctrl></hp:run></hp:p>")
        else:
            body.append(f"<hp:p paraPrIDRef='{x[1] + 1 if kind == 'item' else 0}'>{run(x[0])}</hp:p>")
    heads = "".join(f"<hh:paraHead level='{i + 1}' start='{s}' numFormat='{f}'>{escape(p)}</hh:paraHead>" for i, (s, f, p) in enumerate(levels))
    shapes = "".join(f"<hh:paraPr id='{i + 1}'><hh:heading type='NUMBER' idRef='1' level='{i}'/></hh:paraPr>" for i in range(len(levels)))
    return archive(
        {
            "Contents/header.xml": f"<hh:head xmlns:hh='{_HH}'><hh:numbering id='1'>{heads}</hh:numbering><hh:paraPr id='0'/>{shapes}</hh:head>",
            "Contents/section0.xml": f"<hs:sec xmlns:hs='{_HS}' xmlns:hp='{_HP}'>{''.join(body)}</hs:sec>",
        }
    )


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams at its top or in folders one deep; short ones are padded into the large chain."""
    size = 512
    sectors: list[bytes] = []
    fat: list[int] = []

    def add(data: bytes) -> int:
        first, n = len(sectors), max(1, -(-len(data) // size))
        sectors.extend(data[i * size : (i + 1) * size].ljust(size, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), _END])
        return first

    def entry(name: str, kind: int, right: int, child: int, start: int, total: int) -> bytes:
        head = name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", len(name) * 2 + 2, kind, 1)
        return head + struct.pack("<III", _FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, total)

    # Entries of a folder form a chain to the right; folders follow the streams at the top.
    tree: dict[str, list[tuple[str, int, int]]] = {"": []}
    for name, data in streams.items():
        folder, _, base = name.rpartition("/")
        padded = data.ljust(4096, b"\0")
        tree.setdefault(folder, []).append((base, add(padded), len(padded)))
    folders = [f for f in tree if f]
    directory, at = [entry("Root Entry", 5, _FREE, 1, _END, 0)], 1 + len(tree[""]) + len(folders)
    for i, (base, start, total) in enumerate(tree[""], 2):
        directory.append(entry(base, 2, i if i < 1 + len(tree[""]) + len(folders) else _FREE, _FREE, start, total))
    for i, folder in enumerate(folders):
        directory.append(entry(folder, 1, len(directory) + 1 if i < len(folders) - 1 else _FREE, at, 0, 0))
        at += len(tree[folder])
    for folder in folders:
        for i, (base, start, total) in enumerate(tree[folder]):
            directory.append(entry(base, 2, len(directory) + 1 if i < len(tree[folder]) - 1 else _FREE, _FREE, start, total))
    first_dir = add(b"".join(directory))
    # As many sectors of the allocation table as name themselves too.
    n = 1
    while n * (size // 4) < len(fat) + n:
        n += 1
    first_fat = len(sectors)
    fat += [_FAT] * n
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n * size, b"\xff")
    if n > 109:
        raise ValueError("document_too_large")
    head = _MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", n, first_dir, 0, 4096, _END, 0, _END, 0)
    return (head + struct.pack(f"<{n}I", *range(first_fat, first_fat + n))).ljust(size, b"\xff") + b"".join(sectors) + table


def hancom_binary(paragraphs: list[str], packed: bool = True) -> bytes:
    """A binary Hancom document of one section."""
    body = b""
    for text in paragraphs:
        raw = text.encode("utf-16-le")
        head = 67 | 1 << 10 | min(len(raw), 0xFFF) << 20
        body += struct.pack("<I", 66) + struct.pack("<I", head) + (struct.pack("<I", len(raw)) if len(raw) >= 0xFFF else b"") + raw
    fill = -len(body) % 4
    if fill:  # a last record fills up to whole words, as what follows in the file is zeros
        body += struct.pack("<I", 66 | fill << 20) + b"\0" * fill
    if packed:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(body) + engine.flush()
    return compound({"FileHeader": b"\0" * 36 + struct.pack("<I", int(packed)), "BodyText/Section0": body})


def metafile(texts: list[str]) -> bytes:
    """An enhanced metafile of text records."""
    records = []
    for text in texts:
        raw = text.encode("utf-16-le")
        shown = raw + b"\0" * (-len(raw) % 4)
        records.append(struct.pack("<II", 84, 76 + len(shown)) + b"\0" * 36 + struct.pack("<III", len(raw) // 2, 76, 0) + b"\0" * 20 + shown)
    records.append(struct.pack("<IIIII", 14, 20, 0, 0, 20))
    body = b"".join(records)
    head = struct.pack("<II", 1, 108) + b"\0" * 32 + b" EMF" + struct.pack("<IIIHH", 0x10000, 108 + len(body), 1 + len(records), 1, 0)
    return head.ljust(108, b"\0") + body


def _rows(column: pa.Array) -> Iterator[list[dict] | None]:
    """The lists of structs of a column; whole columns of fields are converted, as single structs take long."""
    if column.null_count or column.values.null_count:
        yield from column.to_pylist()
        return
    values = column.flatten()
    names = [f.name for f in values.type]
    rows = [dict(zip(names, r, strict=True)) for r in zip(*(x.to_pylist() for x in values.flatten()), strict=True)]
    at = 0
    for n in pc.list_value_length(column).to_pylist():
        yield rows[at : at + n]
        at += n


def write(df: DataFrame, key: str, blocks: str, make: Callable[[str, list], bytes]) -> DataFrame:
    """(key, content): make(key, rows) of each row's array of structs; small documents go out together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, made, size = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for k, rows in zip(part.column(0).to_pylist(), _rows(part.column(1)), strict=True):
                    keys.append(k)
                    made.append(make(k, rows))
                    size += len(made[-1])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(made, pa.binary())], names=[key, "content"])
                        keys, made, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(made, pa.binary())], names=[key, "content"])

    return df.select(F.col(key).cast("string").alias(key), blocks).mapInArrow(run, f"{key} string, content binary")
