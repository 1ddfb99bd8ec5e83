"""Hancom binary documents: compound file container, record framing, paragraph text."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# The record tag of paragraph text, and which control codes take eight units or mark characters.
PARA_TEXT = 67
EXTENDED = frozenset((1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23))
INLINE = frozenset((4, 5, 6, 7, 8, 9, 19, 20))
MAX_RECORDS, MAX_STREAM = 2_000_000, 256 << 20
_FREE = 0xFFFFFFFC


class HwpError(ValueError):
    pass


def streams(data: bytes, oversized: list[str] | None = None) -> dict[str, bytes]:
    """Path to bytes of the streams of a compound file; chains are bounded by the file's size.

    A stream beyond MAX_STREAM is not read; its path goes to oversized.
    """
    if data[:8] != MAGIC:
        raise HwpError("not_a_compound_file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir = struct.unpack_from("<I4xI", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini = struct.unpack_from("<II", data, 56)
    first_difat = struct.unpack_from("<I", data, 68)[0]
    size = 1 << shift
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    limit = len(data) // size + 2
    listed = [s for s in struct.unpack_from("<109I", data, 76) if s < _FREE]
    seen = 0
    while first_difat < _FREE and seen < limit:
        entries = struct.unpack(f"<{size // 4}I", sector(first_difat))
        listed += [s for s in entries[:-1] if s < _FREE]
        first_difat, seen = entries[-1], seen + 1
    fat: list[int] = []
    for s in listed[:n_fat]:
        raw = sector(s)
        fat += struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def chain(start: int, table: list[int], read, most: int) -> bytes:
        out, n = [], 0
        while start < _FREE:
            if start >= len(table) or n > most:
                raise HwpError("chain_broken")
            out.append(read(start))
            start, n = table[start], n + 1
        return b"".join(out)

    directory = chain(first_dir, fat, sector, limit)
    raw_mini = chain(first_mini, fat, sector, limit) if first_mini < _FREE else b""
    mini_fat = list(struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini))
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length = struct.unpack_from("<H", directory, at + 64)[0]
        name = directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        kind = directory[at + 66]
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        start, total = struct.unpack_from("<IQ", directory, at + 116)
        entries.append((name, kind, left, right, child, start, total))
    mini = chain(entries[0][5], fat, sector, limit) if entries and entries[0][5] < _FREE else b""
    small = 1 << mini_shift
    out: dict[str, bytes] = {}
    todo, visited = [(entries[0][4], "")] if entries else [], set()
    oversized = [] if oversized is None else oversized
    while todo:
        i, prefix = todo.pop()
        if i >= len(entries) or i in visited:
            continue
        visited.add(i)
        name, kind, left, right, child, start, total = entries[i]
        todo += [(left, prefix), (right, prefix)]
        if kind == 1:
            todo.append((child, f"{prefix}{name}/"))
        elif kind == 2 and total > MAX_STREAM:
            oversized.append(prefix + name)
        elif kind == 2:
            body = chain(start, mini_fat, lambda s: mini[s * small : (s + 1) * small], len(mini_fat) + 1) if total < cutoff else chain(start, fat, sector, limit)
            out[prefix + name] = body[:total]
    return out


def inflate(data: bytes, limit: int = MAX_STREAM) -> bytes:
    engine = zlib.decompressobj(-15)
    out = engine.decompress(data, limit)
    if engine.unconsumed_tail:
        raise HwpError("stream_limit")
    return out


def records(data: bytes, most: int = MAX_RECORDS) -> Iterator[tuple[int, int, int, bytes]]:
    """(ordinal, tag, level, bytes): ten bits of tag, ten of level, twelve of size, with an extended size after."""
    at = n = 0
    while at < len(data):
        if at + 4 > len(data) or n >= most:
            raise HwpError("record_limit" if n >= most else "record_truncated")
        head = struct.unpack_from("<I", data, at)[0]
        tag, level, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                raise HwpError("record_truncated")
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            raise HwpError("record_truncated")
        yield n, tag, level, data[at : at + size]
        at, n = at + size, n + 1


def paragraph_text(data: bytes) -> tuple[str, int]:
    """Text of a paragraph record and the number of controls in it; controls take eight units and show nothing."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, controls, i = bytearray(), 0, 0
    while i < len(units):
        u = units[i]
        if u >= 32:
            out += struct.pack("<H", u)
            i += 1
        elif u in EXTENDED or u in INLINE:
            if u == 9:
                out += struct.pack("<H", 9)
            controls += 1
            i += 8
        else:
            if u in (10, 13):
                out += struct.pack("<H", 10)
            elif u in (24, 30, 31):
                out += struct.pack("<H", 0x2D if u == 24 else 0x20)
            i += 1
    return out.decode("utf-16-le", "replace"), controls


def hwp(data: bytes) -> Iterator[dict]:
    oversized: list[str] = []
    parts = streams(data, oversized)
    header = parts.get("FileHeader", b"")
    flags = struct.unpack_from("<I", header, 36)[0] if len(header) >= 40 else 0
    if flags & 2:
        raise HwpError("document_encrypted")
    names = sorted((n for n in parts if re.fullmatch(r"BodyText/Section[0-9]+", n)), key=lambda n: int(n[len("BodyText/Section") :]))
    for name in names:
        body = inflate(parts[name]) if flags & 1 else parts[name]
        for _, tag, level, raw in records(body):
            if tag == PARA_TEXT:
                content = paragraph_text(raw)[0].strip()
                if content:
                    yield {"unit_type": "section_paragraph", "content": content, "section": name, "level": level}
    for name in sorted(oversized):
        yield {"unit_type": "issue", "content": "stream_limit", "section": name}
