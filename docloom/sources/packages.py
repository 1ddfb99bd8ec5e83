"""Office packages (ZIP with XML parts): word, slide and sheet documents and Hancom packages, as ordered units.

Hancom binary documents go the same way.

Archives are bounded before a part is read, and parts with a document type declaration are refused, so a
hostile file becomes an issue row and never fails a task.
"""

from __future__ import annotations

import functools
import io
import itertools
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.sources import hwp
from docloom.sources import numbering as N

MAX_MEMBERS, MAX_BYTES, MAX_PART = 10_000, 512 << 20, 128 << 20
#: Sizes of what goes out at once, and of parts that are kept parsed, as small ones are the same in many documents.
BATCH_ROWS, BATCH_CHARS, SMALL_PART, SMALL_PARTS = 5000, 4 << 20, 1024, 128
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class PackageError(ValueError):
    pass


class Package:
    """A ZIP archive in memory; common members are read directly, and all that is unusual goes to the standard library."""

    _END, _ENTRY, _HEAD = struct.Struct("<4s4H2LH"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s5H3L2H")

    def __init__(self, data: bytes):
        self.data = data
        self.members = self._directory()
        if self.members is None:
            self.whole = zipfile.ZipFile(io.BytesIO(data))
            self.sizes = [i.file_size for i in self.whole.infolist()]
            self.members = {i.filename: (i.file_size, None) for i in self.whole.infolist()}
        else:
            self.whole = None
            self.sizes = [size for size, _ in self.members.values()]

    def _directory(self) -> dict[str, tuple[int, tuple | None]] | None:
        """Name to size and place of the members, if the archive ends in a plain directory of plain members."""
        data = self.data
        if len(data) < 22:
            return None
        mark, disk, first, here, total, size, at, comment = self._END.unpack_from(data, len(data) - 22)
        if mark != b"PK\5\6" or disk or first or here != total or comment or at + size != len(data) - 22 or total > MAX_MEMBERS:
            return None
        members: dict[str, tuple[int, tuple | None]] = {}
        for _ in range(total):
            if at + 46 > len(data) - 22:
                return None
            entry = self._ENTRY.unpack_from(data, at)
            flags, method, crc, packed, whole, named, extra, said, disk = entry[5], entry[6], *entry[9:16]
            name = data[at + 46 : at + 46 + named]
            if entry[0] != b"PK\1\2" or entry[3] > 63 or flags & ~0x806 or method not in (0, 8) or extra or said or disk or not name.isascii() or b"\0" in name:
                return None
            members[name.decode("ascii")] = whole, (entry[18], packed, crc, method, name)
            at += 46 + named
        return members if at == len(data) - 22 and len(members) == total else None

    def read(self, name: str) -> bytes:
        whole, place = self.members[name]
        if place is not None:
            at, packed, crc, method, raw = place
            begin = at + 30 + len(raw)
            if begin + packed <= len(self.data):
                head = self._HEAD.unpack_from(self.data, at)
                # A member that says otherwise in its own header, or holds another size or sum, is unusual, too.
                if head[0] == b"PK\3\4" and head[9] == len(raw) and not head[10] and not head[2] & ~0x806 and self.data[at + 30 : begin] == raw:
                    body = self.data[begin : begin + packed]
                    if method:
                        engine = zlib.decompressobj(-15)
                        try:
                            body = engine.decompress(body, whole + 1)
                        except zlib.error:
                            body = None
                    if body is not None and len(body) == whole and (not method or engine.eof) and zlib.crc32(body) == crc:
                        return body
        if self.whole is None:
            self.whole = zipfile.ZipFile(io.BytesIO(self.data))
        return self.whole.read(name)


def open_package(data: bytes) -> Package:
    try:
        archive = Package(data)
    except zipfile.BadZipFile:
        raise PackageError("archive_unreadable") from None
    if len(archive.sizes) > MAX_MEMBERS or sum(archive.sizes) > MAX_BYTES:
        raise PackageError("archive_limit")
    return archive


def _parsed(raw: bytes) -> ET.Element:
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise PackageError("part_doctype")
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        raise PackageError("part_unreadable") from None
    for e in root.iter():
        e.tag = _name(e.tag)
    return root


@functools.lru_cache(4096)
def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


_kept = functools.lru_cache(SMALL_PARTS)(_parsed)


def _raw(archive: Package, name: str) -> bytes:
    if name not in archive.members:
        raise PackageError("part_missing")
    if archive.members[name][0] > MAX_PART:
        raise PackageError("part_limit")
    return archive.read(name)


def part(archive: Package, name: str) -> ET.Element:
    """The tree of a part, with local names as tags; small trees are shared, so none is to be changed."""
    raw = _raw(archive, name)
    return _kept(raw) if len(raw) <= SMALL_PART else _parsed(raw)


def attr(e: ET.Element, name: str) -> str | None:
    for k, v in e.attrib.items():
        if _name(k) == name:
            return v
    return None


def relations(archive: Package, name: str) -> dict[str, str]:
    """Relation id to part name of one part."""
    folder, base = posixpath.split(name)
    rels = f"{folder}/_rels/{base}.rels".lstrip("/")
    if rels not in archive.members:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target", "").startswith("/") else r.get("Target")[1:] for r in part(archive, rels) if r.get("TargetMode") != "External"}


def _unit(unit_type: str, content: str, **where) -> dict:
    return {"unit_type": unit_type, "content": content, **where}


def _run_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        name = e.tag
        if name == "t":
            out.append(e.text or "")
        elif name in ("br", "cr", "lineBreak"):
            out.append("\n")
        elif name == "tab":
            out.append("\t")
    return "".join(out)


def _word_lists(archive: Package, main: str) -> dict[str, tuple[str, dict[int, N.Level]]]:
    """numId to its abstract definition and that one's levels; a number with overrides of its own has no levels."""
    name = posixpath.join(posixpath.dirname(main), "numbering.xml")
    if name not in archive.members:
        return {}
    raw = _raw(archive, name)
    return _kept_numbering(raw) if len(raw) <= SMALL_PART else _numbering(raw)


def _numbering(raw: bytes) -> dict[str, tuple[str, dict[int, N.Level]]]:
    root, found, shapes = _parsed(raw), {}, {}
    for abstract in (x for x in root if x.tag == "abstractNum"):
        levels = {}
        for lvl in (x for x in abstract if x.tag == "lvl"):
            own = {x.tag: attr(x, "val") for x in lvl}
            supported = "isLgl" not in own and own.get("lvlRestart") in (None, "0")
            # A start that is left out is zero.
            levels[int(attr(lvl, "ilvl") or 0) + 1] = N.Level(N.number(own.get("start"), 0), N.WORD.get(own.get("numFmt") or "") if supported else None, own.get("lvlText"), own.get("lvlRestart") != "0")
        shapes[attr(abstract, "abstractNumId")] = {} if any(x.tag in ("numStyleLink", "styleLink") for x in abstract) else levels
    for num in (x for x in root if x.tag == "num"):
        of = next((attr(x, "val") for x in num if x.tag == "abstractNumId"), None)
        found[attr(num, "numId")] = (of, {} if any(x.tag == "lvlOverride" for x in num) else shapes.get(of, {}))
    return found


_kept_numbering = functools.lru_cache(SMALL_PARTS)(_numbering)


def _label_word_lists(events: list[tuple[dict, str | None, int, bool]], lists: dict[str, tuple[str, dict[int, N.Level]]]) -> None:
    """Labels for lists whose whole sequence is certain: one number for its definition, and all of it in the body."""
    groups: dict[str | None, list[tuple[dict, str | None, int, bool]]] = {}
    for event in events:
        groups.setdefault(lists.get(event[1], (event[1], {}))[0], []).append(event)
    for group in groups.values():
        if len({n for _, n, _, _ in group}) == 1 and all(body for *_, body in group) and group[0][1] in lists:
            for (unit, *_), label in zip(group, N.labels(((level, None) for _, _, level, _ in group), lists[group[0][1]][1], "%"), strict=True):
                unit["label"] = label


def docx(data: bytes) -> Iterator[dict]:
    archive = open_package(data)
    main = next((n for n in archive.members if n.endswith("word/document.xml")), None)
    if main is None:
        raise PackageError("part_missing")
    tables = 0
    events: list[tuple[dict, str | None, int, bool]] = []

    def listed(properties: ET.Element, unit: dict, body: bool) -> None:
        own = {x.tag: attr(x, "val") for x in properties}
        events.append((unit, own.get("numId"), (N.number(own.get("ilvl"), 0) or 0) + 1, body))

    def table(node: ET.Element, section: str) -> Iterator[dict]:
        nonlocal tables
        at, tables = tables, tables + 1
        open_merges: dict[int, dict] = {}
        cells: list[dict] = []
        for r, row in enumerate(node.findall("tr")):
            c = 0
            for cell in row.findall("tc"):
                properties = cell.find("tcPr")
                mark = {x.tag: x for x in properties} if properties is not None else {}
                span = int((attr(mark["gridSpan"], "val") if "gridSpan" in mark else None) or 1)
                merge = mark.get("vMerge")
                above = open_merges.get(c)
                if merge is not None and attr(merge, "val") != "restart":
                    if above is not None and above["col_span"] == span:
                        above["row_span"] += 1
                    else:
                        cells.append(_unit("issue", "merge_without_origin", section=section, table=at, row=r, col=c, row_span=1, col_span=span))
                else:
                    content = "\n".join([_run_text(p) for p in cell.iter("p")]).strip()
                    unit = _unit("table_cell", content, section=section, table=at, row=r, col=c, row_span=1, col_span=span)
                    cells.append(unit)
                    for p in cell.iter("p") if next(cell.iter("numPr"), None) is not None else ():
                        if (properties := next(p.iter("numPr"), None)) is not None:
                            listed(properties, {}, False)
                    open_merges.pop(c, None)
                    if merge is not None:
                        open_merges[c] = unit
                c += span
        yield from cells

    def walk(body: ET.Element, section: str) -> Iterator[dict]:
        for node in body:
            name = node.tag
            if name == "tbl":
                yield from table(node, section)
            elif name == "p":
                style = next((attr(x, "val") or "" for x in node.iter("pStyle")), "")
                heading = re.fullmatch(r"(?i)heading ?([1-9])", style)
                content = _run_text(node).strip()
                if content:
                    properties = next(node.iter("numPr"), None)
                    unit = _unit("heading" if heading else "list_item" if properties is not None else "paragraph", content, section=section, level=int(heading[1]) if heading else None)
                    if properties is not None:
                        listed(properties, unit, section == "body")
                    yield unit
            elif name in ("sdt", "sdtContent", "body", "ins"):
                yield from walk(node, section)

    root = part(archive, main)
    yield from walk(next((x for x in root if x.tag == "body"), root), "body")
    for target in relations(archive, main).values():
        kind = re.match(r"(header|footer|footnotes|endnotes|comments)", posixpath.basename(target))
        if kind and target in archive.members:
            name = {"footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}.get(kind[1], kind[1])
            for p in part(archive, target).iter("p"):
                if content := _run_text(p).strip():
                    yield _unit(name, content, section=posixpath.basename(target))
    _label_word_lists(events, _word_lists(archive, main))


def _slide_labels(body: ET.Element) -> dict[int, str | None]:
    """Labels of the automatically numbered paragraphs of one text body, by place; certain up to the first that inherits its bullet."""
    if any(next(style.iter("buAutoNum"), None) is not None for style in body.findall("lstStyle")):
        return {}
    events: list[tuple[int, int, str | None, str | None]] = []
    for place, p in enumerate(body):
        if p.tag == "p":
            shape, auto, other = p.find("pPr"), None, False
            for x in () if shape is None else shape:
                if x.tag == "buAutoNum":
                    auto = x
                elif x.tag in ("buNone", "buChar"):
                    other = True
            if auto is not None:
                events.append((place, (N.number(shape.get("lvl"), 0) or 0) + 1, auto.get("type"), auto.get("startAt")))
            elif not other:
                break
    if not events:
        return {}
    schemes: dict[int, set[str | None]] = {}
    for _, level, scheme, _ in events:
        schemes.setdefault(level, set()).add(scheme)
    levels = {}
    for level, found in schemes.items():
        style, shape = N.SLIDES.get(next(iter(found)) or "", (None, "")) if len(found) == 1 else (None, "")
        levels[level] = N.Level(1, style, shape.replace("{}", f"%{level}") or None)
    made = N.labels(((level, N.number(start, None)) for _, level, _, start in events), levels, "%")
    return {place: label for (place, *_), label in zip(events, made, strict=True)}


def pptx(data: bytes) -> Iterator[dict]:
    archive = open_package(data)
    deck = part(archive, "ppt/presentation.xml")
    links = relations(archive, "ppt/presentation.xml")
    for n, entry in enumerate(deck.iter("sldId"), 1):
        name = links.get(entry.get(f"{_REL}id"))
        if name is None or name not in archive.members:
            yield _unit("issue", "slide_missing", section=str(n))
            continue
        inside: set[int] = set()
        for node in (root := part(archive, name)).iter("tbl"):
            inside.update(id(x) for kind in ("p", "txBody") for x in node.iter(kind))
            for r, row in enumerate(node.findall("tr")):
                for c, cell in enumerate(row.findall("tc")):
                    if cell.get("hMerge") or cell.get("vMerge"):
                        continue
                    yield _unit("table_cell", "\n".join([_run_text(p) for p in cell.iter("p")]).strip(), section=str(n), row=r, col=c, row_span=int(cell.get("rowSpan", 1)), col_span=int(cell.get("gridSpan", 1)))
        made: dict[int, str | None] = {}
        for body in root.iter("txBody"):
            if id(body) not in inside:
                made |= {id(body[place]): label for place, label in _slide_labels(body).items()}
        for node in root.iter("p"):
            if id(node) not in inside and (content := _run_text(node).strip()):
                yield _unit("slide_text", content, section=str(n), label=made.get(id(node)))
        for target in relations(archive, name).values():
            if "notesSlide" in target and target in archive.members:
                for p in part(archive, target).iter("p"):
                    if content := _run_text(p).strip():
                        yield _unit("speaker_notes", content, section=str(n))


_REFERENCE, _INTEGER = re.compile(r"([A-Z]{1,3})([1-9][0-9]*)"), re.compile(r"-?[0-9]+")


@functools.lru_cache(4096)
def _place(ref: str) -> tuple[int, int]:
    m = _REFERENCE.fullmatch(ref)
    if not m:
        raise PackageError("cell_reference")
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def xlsx(data: bytes) -> Iterator[dict]:
    """Sheets and stored cells, rows and columns from 1; formulas keep their text and the stored result."""
    archive = open_package(data)
    book = part(archive, "xl/workbook.xml")
    links = relations(archive, "xl/workbook.xml")
    shared = []
    if "xl/sharedStrings.xml" in archive.members:
        shared = ["".join([t.text or "" for t in si.iter("t")]) for si in part(archive, "xl/sharedStrings.xml").findall("si")]
    for sheet in book.iter("sheet"):
        title, name = sheet.get("name", ""), links.get(sheet.get(f"{_REL}id"))
        yield _unit("sheet", title, section=title)
        if name is None or name not in archive.members:
            yield _unit("issue", "sheet_missing", section=title)
            continue
        root = part(archive, name)
        merges = {}
        for m in root.iter("mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            (r0, c0), (r1, c1) = _place(a), _place(b or a)
            merges[(r0, c0)] = (r1 - r0 + 1, c1 - c0 + 1)
        for cell in root.iter("c"):
            row, col = _place(cell.get("r", ""))
            raw = formula = None
            for x in cell:
                if x.tag == "v":
                    raw = x.text
                elif x.tag == "f":
                    formula = x.text
            kind = cell.get("t", "n")
            if kind == "s" and raw is not None:
                value, shown = "string", shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
            elif kind == "inlineStr":
                value, shown = "string", "".join([t.text or "" for t in cell.iter("t")])
            elif kind == "b":
                value, shown = "boolean", {"1": "true", "0": "false"}.get(raw or "", "")
            elif kind in ("str", "e"):
                value, shown = {"str": "string", "e": "error"}[kind], raw or ""
            else:
                value, shown = ("blank", "") if raw is None else ("integer" if _INTEGER.fullmatch(raw) else "number", raw)
            rs, cs = merges.get((row, col), (1, 1))
            yield {"unit_type": "sheet_cell", "content": shown, "section": title, "row": row, "col": col, "row_span": rs, "col_span": cs, "kind": value if formula is None else "formula", "raw": raw, "formula": formula}


def hwpx(data: bytes) -> Iterator[dict]:
    archive = open_package(data)
    names = sorted((n for n in archive.members if re.fullmatch(r"Contents/section[0-9]+\.xml", n)), key=lambda n: int(re.findall(r"[0-9]+", n)[0]))
    if not names:
        raise PackageError("part_missing")
    table = 0
    shapes, definitions = _hancom_lists(archive)
    events: dict[str, list[tuple[dict | None, int]]] = {}

    def listed(p: ET.Element, unit: dict | None) -> str:
        """Notes an item of a numbered list; one without a unit stands outside the body's flow."""
        kind, of, level = shapes.get(p.get("paraPrIDRef"), (None, None, 0))
        if kind == "NUMBER":
            events.setdefault(of, []).append((unit, level))
        return "paragraph" if kind in (None, "NONE", "OUTLINE") else "list_item"

    def walk(node: ET.Element, section: str) -> Iterator[dict]:
        nonlocal table
        for e in node:
            name = e.tag
            if name == "tbl":
                at, table = table, table + 1
                for cell in (x for row in e if row.tag == "tr" for x in row if x.tag == "tc"):
                    where = {x.tag: x for x in cell}
                    address, span = where.get("cellAddr"), where.get("cellSpan")
                    content = "\n".join(_run_text(p) for p in cell.iter() if p.tag == "p")
                    for p in (x for x in cell.iter() if x.tag == "p"):
                        listed(p, None)
                    number = lambda x, k, d: int(x.get(k, d)) if x is not None else d
                    yield _unit("table_cell", content, section=section, table=at, row=number(address, "rowAddr", 0), col=number(address, "colAddr", 0), row_span=number(span, "rowSpan", 1), col_span=number(span, "colSpan", 1))
            elif name == "p":
                own = "".join("".join(t.itertext()) for run in e if run.tag == "run" for t in run if t.tag == "t").strip()
                if own:
                    unit = _unit("paragraph", own, section=section)
                    unit["unit_type"] = listed(e, unit)
                    yield unit
                for run in e:
                    yield from walk(run, section)
            elif name in ("footNote", "endNote"):
                content = _run_text(e).strip()
                if content:
                    yield _unit("footnote" if name == "footNote" else "endnote", content, section=section)
            elif name not in ("t",):
                yield from walk(e, section)

    for n in names:
        yield from walk(part(archive, n), n)
    for of, items in events.items():
        # What follows an item outside the flow is not certain.
        certain = [x for x in itertools.takewhile(lambda x: x[0] is not None, items)]
        for (unit, _), label in zip(certain, N.labels(((level, None) for _, level in certain), definitions.get(of, {}), "^"), strict=True):
            unit["label"] = label


def _hancom_lists(archive: Package) -> tuple[dict[str | None, tuple[str | None, str | None, int]], dict[str | None, dict[int, N.Level]]]:
    """Paragraph shapes (id to kind, list and level) and the lists' levels, of the header."""
    if "Contents/header.xml" not in archive.members:
        return {}, {}
    shapes, lists = {}, {}
    for e in part(archive, "Contents/header.xml").iter():
        if e.tag == "paraPr":
            head = next((x for x in e if x.tag == "heading"), None)
            if head is not None:
                shapes[e.get("id")] = (head.get("type", "NONE"), head.get("idRef"), (N.number(head.get("level"), 0) or 0) + 1)
        elif e.tag == "numbering":
            whole = e.get("start")
            levels = {}
            for head in (x for x in e if x.tag == "paraHead"):
                level = N.number(head.get("level"), 1) or 1
                # The list's own start holds for its first level, and for all levels if it is one.
                start = head.get("start") or (whole if whole == "1" or level == 1 else None)
                levels[level] = N.Level(N.number(start, None), N.HANCOM.get(head.get("numFormat", "")), (head.text or "").strip() or None)
            lists[e.get("id")] = levels
    return shapes, lists


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "hwpx": hwpx, "hwp5": hwp.hwp}

_FIELDS = [("unit_type", pa.string()), ("content", pa.string()), ("section", pa.string()), ("table", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("raw", pa.string()), ("formula", pa.string()), ("label", pa.string())]
SCHEMA = "ordinal int, unit_type string, content string, section string, table int, row int, col int, row_span int, col_span int, level int, kind string, raw string, formula string, label string"


def read_units(data: bytes, adapter: str) -> list[dict]:
    """The units of one package; what can't be read is an issue unit at its end."""
    out: list[dict] = []
    try:
        out.extend(READERS[adapter](data))
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        out.append(_unit("issue", str(e)))
    return out


def units(files: DataFrame, key: str = "path", adapter: str = "adapter", content: str = "content") -> DataFrame:
    """(key, ordinal, ...) of packages; files has the adapter's name and the bytes."""
    kind = pa.schema([(key, pa.string()), ("ordinal", pa.int32()), *_FIELDS])

    def made(keys: list, ordinals: list[int], found: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([u.get(name) for u in found], of) for name, of in _FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ordinals, pa.int32()), *columns], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Units of many small documents go out together, and those of a large one in parts.
        keys, ordinals, rows, chars = [], [], [], 0
        for batch in batches:
            for k, a, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                k = k.as_py()
                for i, u in enumerate(read_units(data.as_py() or b"", a.as_py())):
                    keys.append(k)
                    ordinals.append(i)
                    rows.append(u)
                    chars += len(u["content"])
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield made(keys, ordinals, rows)
                        keys, ordinals, rows, chars = [], [], [], 0
        if rows:
            yield made(keys, ordinals, rows)

    return files.select(key, adapter, content).mapInArrow(run, f"{key} string, {SCHEMA}")
