"""Packages are read as the standard library reads them, and small documents go out together."""

import io
import random
import zipfile

import pyarrow as pa
import pytest

from docloom import reader_queries as R
from docloom.sinks import packages as P
from docloom.sources import packages as K


class Mapped:
    """Stands for a DataFrame: runs what is mapped over batches, and keeps its batches."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter(self.batches)))


LINES = [{"row": i, "l_linenumber": i + 1, "l_partkey": 7 * i, "l_returnflag": "RNA"[i % 3], "l_linestatus": "F"} for i in range(4)]


@pytest.mark.parametrize(("make", "adapter", "n"), [(R._sheet, "xlsx", 27), (R._deck, "pptx", 9), (R._word, "docx", 13)])
def test_small_documents_go_out_together(spark, make, adapter, n):
    given = pa.RecordBatch.from_pydict({"k": [str(i) for i in range(300)], "lines": [LINES] * 300})
    files = P.write(Mapped(given), "k", "lines", make)
    assert len(files) <= 3
    assert pa.Table.from_batches(files)["k"].to_pylist() == [str(i) for i in range(300)]
    units = K.units(Mapped(*(b.add_column(1, "adapter", pa.array([adapter] * b.num_rows)) for b in files)), "k")
    assert len(units) <= 3 and sum(b.num_rows for b in units) == 300 * n
    first = [u["unit_type"] for u in K.read_units(make("0", LINES), adapter)]
    got = pa.Table.from_batches(units).slice(0, n)
    assert got["unit_type"].to_pylist() == first and got["ordinal"].to_pylist() == list(range(n)) and set(got["k"].to_pylist()) == {"0"}


def test_large_documents_go_out_in_parts():
    data = P.word_document([("paragraph", "x" * 1000)] * 12000)
    given = pa.RecordBatch.from_pydict({"k": ["a", "b"], "adapter": ["docx", "docx"], "content": [data, data]})
    units = K.units(Mapped(given), "k")
    assert max(b.num_rows for b in units) <= K.BATCH_ROWS and pa.Table.from_batches(units)["ordinal"].to_pylist() == [*range(12000)] * 2


def test_lists_of_structs():
    whole = pa.array([[{"a": 1, "b": "x"}], [], [{"a": None, "b": "y"}, {"a": 3, "b": None}], [{"a": 4, "b": "z"}]])
    holes = pa.array([None, [None, {"a": 1, "b": "x"}]], whole.type)
    for column in (whole, whole.slice(1, 2), whole.slice(3), holes, whole.slice(0, 0)):
        assert list(P._rows(column)) == column.to_pylist()


def test_archives_as_the_standard_library_reads_them():
    chance = random.Random(5)
    parts = {f"word/p{i}.xml": "".join(chance.choice("ab<>") for _ in range(size)) for i, size in enumerate((0, 1, 511, 512, 5000))}
    kept = P.archive(parts)
    assert {n: zipfile.ZipFile(io.BytesIO(kept)).read(n).decode() for n in parts} == parts and kept == P.archive(parts)

    def library(comment=b"", **kw):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, body in parts.items():
                info = zipfile.ZipInfo(n)
                info.extra = kw.get("extra", b"")
                z.writestr(info, body, kw.get("method", zipfile.ZIP_DEFLATED))
            z.comment = comment
        return out.getvalue()

    for data in (kept, library(), library(method=zipfile.ZIP_STORED), library(method=zipfile.ZIP_BZIP2), library(comment=b"said"), library(extra=b"\x99\x99\0\0"), b"before" + library(), b"before" + kept):
        package = K.open_package(data)
        assert {n: package.read(n).decode() for n in package.members} == parts
    assert K.Package(kept).whole is None and K.Package(library(comment=b"said")).whole is not None
    for data in (b"", b"PK", kept[:-1], kept[: len(kept) // 2], b"x" * 100):
        with pytest.raises(K.PackageError, match="archive_unreadable"):
            K.open_package(data)
    # What is damaged inside is an error of the library's, never other bytes.
    for _ in range(300):
        at = chance.randrange(len(kept))
        data = kept[:at] + bytes([kept[at] ^ 1 << chance.randrange(8)]) + kept[at + 1 :]
        for n, body in parts.items():
            try:
                theirs = zipfile.ZipFile(io.BytesIO(data)).read(n)
            except Exception:  # noqa: BLE001
                theirs = None
            try:
                ours = K.open_package(data).read(n)
            except Exception:  # noqa: BLE001
                ours = None
            assert ours in (theirs, body.encode()) and (theirs is None or ours == theirs)
