r"""Personal data: spans of e-mail addresses, IPv4 addresses, card and phone numbers.

Base detectors read the text as it is.  A second reading goes through a
transducer that rewrites disguises and remembers, for every character it puts
out, the source range it came from:

* look-alike letters, digits and marks of other scripts, and full-width forms;
* zero-width characters, which vanish;
* at signs and dots in disguise: "[at]", "(dot)", " AT x DOT com", "&#64;", "[.]",
  "x(a)y.com", "x@y .com", and a plus sign apart from its country code;
* letters that pass for digits, in numbers of at least MIXED_DIGITS true digits;
* digits spelled as words, at least SPELLED_WORDS in a run of four or more numbers.

The base detectors then read the rewritten text, and each hit is mapped back to
source characters.  A mapped hit is added if its source differs from what the
detector read and no base span of the same kind covers it; base spans are never
changed.  All work is linear in the text.

Defined results: offsets are code points of the source, end exclusive; a null
text counts as empty and has no spans; ties in the start are ordered by kind
(email, ip, card, phone); repeated rows give repeated results; texts may be of
any length and are read whole; an empty table gives an empty table.  Output columns replace input columns of the same
name.  Recall by disguise is in tests/llm/test_twins.py.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Only what stands left of an at sign can start a match, so each at sign is looked at once.
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = start < at and _AT_DOMAIN.match(text, at)
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors, by start, then kind."""
    spans = []
    if "@" in text:
        spans += [("email", a, b) for a, b in _emails(text)]
    digits = _DIGIT.search(text)
    for m in _IP.finditer(text, digits.start()) if digits else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text, digits.start()) if digits else ():
        if m.end() - m.start() >= 14:
            number = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# Look-alikes of ASCII characters in Cyrillic, Greek and Armenian, and typographic marks.
_LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "ց": "g", "ı": "i", "ɡ": "g", "ɑ": "a",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "․": ".", "。": ".", "【": "[", "】": "]", "〔": "[", "〕": "]", "〈": "<", "〉": ">", "《": "<", "》": ">", "\u207a": "+", "\u208a": "+", "\u207b": "-", "｡": ".", "﹒": ".", "﹫": "@", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u2009": " ",
}
# Characters that show nothing.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# The words of digits in English, German, French and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Last labels that make an address of a disguise without brackets.
_TOP = "com|net|org|edu|gov|mil|int|info|biz|io|co|me|tv|ai|app|dev|xyz|online|site|eu|uk|us|ca|au|de|at|ch|fr|be|nl|lu|es|pt|it|mx|ar|br|cl|ru|ua|pl|cz|se|no|fi|dk|ie|jp|cn|in|example|test|invalid"

# Decimal digits of all scripts and letters in mathematical or full-width form become ASCII by their Unicode values.
_FOLD = {ord(k): v for k, v in _LOOK_ALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord(c): "" for c in _INVISIBLE}
for _zero in (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0, 0x1810, *range(0x1D7CE, 0x1D800, 10)):
    _FOLD |= {_zero + i: str(i) for i in range(10)}
for _base in range(0x1D400, 0x1D6A4, 52):
    _FOLD |= {_base + i: chr((65 if i < 26 else 71) + i) for i in range(52)}
for _base, _first in ((0x24B6, 65), (0x24D0, 97), (0x1F130, 65), (0x1F150, 65), (0x1F170, 65)):  # in circles and squares
    _FOLD |= {_base + i: chr(_first + i) for i in range(26)}
_FOLD |= {0x2460 + i: str(i + 1) for i in range(9)} | {0x24EA: "0"} | {0x2080 + i: str(i) for i in range(10)} | {0x2070: "0", 0xB9: "1", 0xB2: "2", 0xB3: "3"} | {0x2070 + i: str(i) for i in range(4, 10)}
# All that is folded lies outside ASCII and, but for one letter, outside the Latin letters with marks.
_FOLDED = re.compile("[^\x00-\x7f\xc0-\u0130\u0132-\u024f]")

_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Words for the at sign and the dot in English, German, French, Spanish and, as folded, Russian.
_DOT_WORD = "|".join(["dot", "d0t", "punkt", "point", "punto", "точка".translate(_FOLD)])
_AT_WORD = "|".join(["at", "собака".translate(_FOLD), "эт".translate(_FOLD)])
# Words that stand before a plain "at" without being a name.
_NO_NAMES = frozenset("me us you him her them it we they i is are was were be here there look looking found available located based stay live lives living work works working meet see shop buy read more arrive arrived aim".split())
_AT_SIGN = rf"_at_|[ \t]*{_OPEN}[ \t]*(?:{_AT_WORD}|@|ät|arobase|arroba|klammeraffe)[ \t]*{_CLOSE}[ \t]*"
_DOT_SIGN = rf"_dot_|[ \t]*{_OPEN}[ \t]*(?:{_DOT_WORD}|\.)[ \t]*{_CLOSE}[ \t]*"
_ENTITY_AT, _ENTITY_DOT = r"&#0*64;|&#x0*40;|&commat;|%40", r"&#0*46;|&#x0*2e;|&period;|%2e"
_LABEL = r"[a-z0-9-]+"
#: Rewrites: the groups named at and dot are what turns into "@" and ".".
_SIGNS = re.compile(rf"(?i)(?<=[a-z0-9])(?:(?P<at>{_AT_SIGN}|{_ENTITY_AT})|(?P<dot>{_DOT_SIGN}|{_ENTITY_DOT}))(?=[a-z0-9])")
_BARE = re.compile(
    rf"(?i)(?<![a-z0-9._%+-])(?:[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*(?: dot [a-z0-9_%+-]+)?)(?P<sep> (?:{_AT_WORD}) | @ ?|(?<! )@ )(?P<host>{_LABEL}(?:(?: (?:{_DOT_WORD}) | ?\. ?|\.){_LABEL}){{0,4}}(?: (?:{_DOT_WORD}) | ?\. ?)(?:{_TOP}))(?![a-z0-9-])"
)
_WORDED_AT = re.compile(rf"(?i) (?:{_AT_WORD}) \Z")
_BARE_DOT = re.compile(rf"(?i) (?:{_DOT_WORD}) | ?\. ?")
_BARE_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?: (?:{_DOT_WORD}) [0-9]{{1,3}}){{3}}(?![0-9])")
# "x(a)site.com", and "x@site .com" or "x@site(.)com" once its dot is read.
_PAREN_A = re.compile(rf"(?i)(?<=[a-z0-9])\(a\)(?={_LABEL}(?:(?:\.|{_DOT_SIGN}){_LABEL}){{0,4}}(?:\.|{_DOT_SIGN})(?:{_TOP})(?![a-z0-9-]))")
_LATE_DOT = re.compile(rf"(?i)(?<=[a-z0-9])@{_LABEL}(?:\.{_LABEL}){{0,4}}(?P<dot> \.)(?:{_TOP})(?![a-z0-9-])")
# A plus sign apart from its country code.
_LATE_CODE = re.compile(r"(?<![0-9)=+*/] )(?<![0-9A-Za-z)=+*/])\+(?P<gap> )(?=[0-9]{1,3}[ .-][ ().0-9-]+[0-9])")
#: Digit words that a run needs for a rewrite.
SPELLED_WORDS = 3
_ITEM = rf"(?:(?:{_WORDS})(?![^\W_])|[0-9]++)"
_GAP = rf"(?: (?:{_DOT_WORD}) |[ ,.()-]{{1,4}})"
_SPELLED = re.compile(rf"(?i)(?:(?<![^\W_])plus[ ,.-]+\(?)?(?<![^\W_]){_ITEM}(?:{_GAP}{_ITEM}){{3,}}")
_SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus[ ,.-]+\(?)|(?P<dot> (?:{_DOT_WORD}) )|(?P<word>{_WORDS})|(?P<digits>[0-9]+)|(?P<gap>[ ,.()-]+)")

# A text without any of these has nothing to rewrite.
# Letters that pass for digits among digits.
_DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
_MIXED_HINT = re.compile("[0-9][OoIlSB]|[OoIlSB][0-9]")
_MIXED_PART = "(?=[OoIlSB]{0,3}[0-9])[0-9OoIlSB]++"
_MIXED = re.compile(f"(?<![A-Za-z0-9]){_MIXED_PART}(?:[ .-]{_MIXED_PART})*+(?![A-Za-z0-9])")
MIXED_DIGITS = 8
_DIGIT = re.compile("[0-9]")
_DIGIT_WORD_SET = frozenset(_DIGIT_WORDS)
_DOT_WORDS_SPACED = tuple(f" {w} " for w in _DOT_WORD.split("|"))


def _has_signs(low: str) -> bool:
    """Whether lower-cased text may hold an at sign or a dot in brackets or as an entity."""
    return any(c in low for c in "[({<") or "&" in low and ("&#" in low or "&commat;" in low or "&period;" in low) or "%40" in low or "%2e" in low or "_at_" in low or "_dot_" in low


def _has_bare(low: str) -> bool:
    return any(w in low for w in _DOT_WORDS_SPACED) or "@" in low and (" @" in low or "@ " in low)


def _has_spelled(low: str) -> bool:
    """Whether words of digits stand in lower-cased text; the French "un" alone needs digits beside it."""
    found = _DIGIT_WORD_SET.intersection(low.replace("-", " ").replace(",", " ").replace(".", " ").split())
    return bool(found) and (found != {"un"} or _DIGIT.search(low) is not None)


class Tape:
    """Rewritten text, with the source range of each of its characters kept as runs."""

    def __init__(self, text: str):
        self.text = text
        # Run i covers output from at[i]; its source starts at src[i] and moves with the output unless fixed.
        self.at, self.src, self.size, self.fixed = [0], [0], [len(text)], [False]

    def source(self, i: int) -> tuple[int, int]:
        """Source range of output character i."""
        k = bisect.bisect_right(self.at, i) - 1
        if self.fixed[k]:
            return self.src[k], self.src[k] + self.size[k]
        start = self.src[k] + i - self.at[k]
        return start, start + 1

    def edit(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A tape on which each (start, end, new) of this one's text is replaced; edits are in order and apart."""
        out = Tape("")
        out.at, out.src, out.size, out.fixed = [], [], [], []
        parts, length, pos = [], 0, 0

        def keep(start: int, end: int) -> None:
            nonlocal length
            while start < end:
                k = bisect.bisect_right(self.at, start) - 1
                stop = min(end, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                out.at.append(length)
                out.fixed.append(self.fixed[k])
                out.src.append(self.src[k] if self.fixed[k] else self.src[k] + start - self.at[k])
                out.size.append(self.size[k] if self.fixed[k] else stop - start)
                parts.append(self.text[start:stop])
                length += stop - start
                start = stop

        for start, end, new in edits:
            keep(pos, start)
            if new:
                first, last = self.source(start)[0], self.source(end - 1)[1]
                for ch in new:  # every new character stands for the whole range it came from
                    out.at.append(length)
                    out.src.append(first)
                    out.size.append(last - first)
                    out.fixed.append(True)
                    parts.append(ch)
                    length += 1
            pos = end
        keep(pos, len(self.text))
        out.text = "".join(parts)
        return out


def _spelled(run: re.Match) -> Iterator[tuple[int, int, str]]:
    """Digit words become digits; what stands between single digits goes, so that they join."""
    parts = list(_SPELLED_PART.finditer(run[0]))
    kinds = [p.lastgroup for p in parts]
    groups = [len(p[0]) for p in parts if p.lastgroup == "digits"]
    dialled = "plus" in kinds and sum(groups) + kinds.count("word") >= 10 and (not groups or max(groups[-2:]) >= 3)
    if kinds.count("word") < SPELLED_WORDS and not dialled:
        return  # a number as digits, beside a word or two that may mean something else
    for p in parts:
        new = {"plus": "+", "dot": ".", "gap": "", "digits": None}.get(p.lastgroup, _DIGIT_WORDS.get(p[0].lower()))
        if new is not None:
            yield run.start() + p.start(), run.start() + p.end(), new


def rewrite(text: str) -> Tape | None:
    """The transducers' output, or None if they change nothing."""
    tape = Tape(text)
    if not text.isascii() and (found := [(m.start(), m.end(), _FOLD[ord(m[0])]) for m in _FOLDED.finditer(text) if ord(m[0]) in _FOLD]):
        tape = tape.edit(found)
    low = tape.text.lower()
    if "(a)" in low and (found := [(m.start(), m.end(), "@") for m in _PAREN_A.finditer(tape.text)]):
        tape = tape.edit(found)
        low = tape.text.lower()
    if _has_signs(low):
        if found := [(m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGNS.finditer(tape.text)]:
            tape = tape.edit(found)
            low = tape.text.lower()
    if _has_bare(low):
        found = []
        for m in _BARE.finditer(tape.text):
            if m["sep"] == "@" or (_WORDED_AT.match(m["sep"]) and (not re.search(rf"(?i) (?:{_DOT_WORD}) ", m["host"]) or m[0][: m.start("sep") - m.start()].lower() in _NO_NAMES)):
                continue
            found.append((m.start("sep"), m.end("sep"), "@"))
            base = m.start("host")
            found += [(base + d.start(), base + d.end(), ".") for d in _BARE_DOT.finditer(m["host"]) if d[0] != "."]
            found += [(m.start() + d.start(), m.start() + d.end(), ".") for d in re.finditer("(?i) dot ", tape.text[m.start() : m.start("sep")])]
        for m in _BARE_IP.finditer(tape.text):
            found += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _BARE_DOT.finditer(m[0])]
        if found:
            tape = tape.edit(sorted(found))
    if "@" in low and " ." in low and (found := [(m.start("dot"), m.end("dot"), ".") for m in _LATE_DOT.finditer(tape.text)]):
        tape = tape.edit(found)
        low = tape.text.lower()
    if "+ " in low and (found := [(m.start("gap"), m.end("gap"), "") for m in _LATE_CODE.finditer(tape.text)]):
        tape = tape.edit(found)
        low = tape.text.lower()
    if _DIGIT.search(tape.text) and _MIXED_HINT.search(tape.text):
        found = []
        for m in _MIXED.finditer(tape.text):
            letters = [i for i, c in enumerate(m[0]) if c in _DIGIT_LETTERS]
            if letters and sum(c.isdigit() for c in m[0]) >= MIXED_DIGITS:
                found += [(m.start() + i, m.start() + i + 1, _DIGIT_LETTERS[m[0][i]]) for i in letters]
        if found:
            tape = tape.edit(found)
            low = tape.text.lower()
    if _has_spelled(low) or "plus " in low:
        if found := [e for m in _SPELLED.finditer(tape.text) for e in _spelled(m)]:
            tape = tape.edit(found)
    return None if tape.text == text else tape


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by start, then kind."""
    base = detect(text)
    tape = rewrite(text)
    if tape is None:
        return base, []
    taken: dict[str, list[tuple[int, int]]] = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    added = []
    for kind, a, b in detect(tape.text):
        start, end = tape.source(a)[0], tape.source(b - 1)[1]
        if text[start:end] == tape.text[a:b]:
            continue  # read the same way by the base detectors, or cut by its surroundings there
        own = taken[kind]
        i = bisect.bisect_right(own, (start, len(text)))
        if i == 0 or own[i - 1][1] < end:
            own.insert(i, (start, end))
            added.append((kind, start, end))
    return base, sorted(added, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or each group of overlapping spans, replaced by the upper-case kind in brackets."""
    out, pos = [], 0
    last_end = -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a < last_end:
            last_end = max(last_end, b)
        else:
            if last_end >= 0:
                pos = last_end
            out += [text[pos:a], f"[{kind.upper()}]"]
            last_end = b
    return "".join(out) + text[max(last_end, 0) :]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())]))


def find_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """df with an array of structs (kind, start, end, added)."""
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, _SPAN, False)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for t in part.column(text).to_pylist():
            base, added = find(t or "")
            rows.append([{"kind": k, "start": a, "end": b, "added": new} for new, spans in ((False, base), (True, added)) for k, a, b in spans])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=[*part.schema.names, out])

    return map_texts(rest, schema, work, text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text masked; null texts stay null."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = []
        for t in part.column(text).to_pylist():
            base, added = find(t or "")
            new.append(mask(t, base + added) if base or added else t)
        yield part.set_column(part.schema.get_field_index(text), text, pa.array(new, pa.string()))

    return map_texts(df, df.schema, work, text)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, the number of added ones, and whether there is any span."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(8)]
        for t in part.column("text").to_pylist():
            base, added = find(t or "")
            for i, k in enumerate(KINDS):
                cols[i].append(sum(s[0] == k for s in base))
            cols[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
            cols[5].append(listed(base + added))
            cols[6].append(len(added))
            cols[7].append(bool(base or added))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "has_pii"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_texts(rows, f"key {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, has_pii boolean", work).withColumnRenamed("key", key)
