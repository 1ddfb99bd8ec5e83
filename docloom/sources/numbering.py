"""List labels that a document's own numbering definitions determine, for the package readers."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from docloom.functions.lists import CIRCLED, LETTERS, MAX_CIRCLED, MAX_LETTER, MAX_VALUE, ROMAN
from docloom.plans.packing import list_counters

# Number formats of word and Hancom documents, and the schemes of slides with their templates.
WORD = {"decimal": "decimal", "upperLetter": "upper_letter", "lowerLetter": "lower_letter", "upperRoman": "upper_roman", "lowerRoman": "lower_roman", "decimalEnclosedCircle": "circled_decimal"}
HANCOM = {
    "DIGIT": "decimal", "CIRCLED_DIGIT": "circled_decimal", "ROMAN_CAPITAL": "upper_roman", "ROMAN_SMALL": "lower_roman", "LATIN_CAPITAL": "upper_letter", "LATIN_SMALL": "lower_letter",
    "CIRCLED_LATIN_CAPITAL": "circled_upper_letter", "CIRCLED_LATIN_SMALL": "circled_lower_letter",
}
_SLIDE_STYLES = {"arabic": "decimal", "alphaUc": "upper_letter", "alphaLc": "lower_letter", "romanUc": "upper_roman", "romanLc": "lower_roman"}
_SLIDE_ENDS = {"Period": "{}.", "ParenR": "{})", "ParenBoth": "({})"}
SLIDES = {s + e: (style, shape) for s, style in _SLIDE_STYLES.items() for e, shape in _SLIDE_ENDS.items()} | {"arabicPlain": ("decimal", "{}"), "circleNumDbPlain": ("circled_decimal", "{}")}


def shown(value: int | None, style: str | None) -> str | None:
    """A counter in a style; None beyond the style's range."""
    if value is None or not 0 <= value <= MAX_VALUE or style is None or value == 0 and style != "decimal":
        return None
    if style == "decimal":
        return str(value)
    if style == "circled_decimal":
        return chr(CIRCLED + value - 1) if value <= MAX_CIRCLED else None
    if style in LETTERS:
        return chr(LETTERS[style] + value - 1) if value <= MAX_LETTER else None
    digits = "M" if value == MAX_VALUE else "".join(ROMAN[place][value // 10**place % 10] for place in (2, 1, 0))
    return digits if style == "upper_roman" else digits.lower()


@dataclass(frozen=True)
class Level:
    start: int | None
    style: str | None
    pattern: str | None
    restarts: bool = True


@functools.lru_cache(1024)
def _parts(pattern: str, marker: str) -> tuple[str, ...]:
    """Odd parts are what follows a marker: the level that is meant."""
    return tuple(re.split(f"{re.escape(marker)}(.?)", pattern, flags=re.S))


def labels(events: Iterable[tuple[int, int | None]], levels: dict[int, Level], marker: str) -> list[str | None]:
    """The label of each (level, explicit start) of one list: its level's pattern with the counters it refers to."""
    events = list(events)
    restarts = {k: x.restarts for k, x in levels.items()}
    values = list_counters(events, {k: x.start for k, x in levels.items() if x.start is not None}, restarts)
    out: list[str | None] = []
    standing: dict[int, int | None] = {}
    for (level, _), value in zip(events, values, strict=True):
        for deeper in [k for k in standing if k > level and restarts.get(k, True)]:
            del standing[deeper]
        standing[level] = value
        parts: list[str | None] = list(_parts((levels[level].pattern if level in levels else None) or "", marker))
        for i in range(1, len(parts), 2):
            at = int(parts[i]) if parts[i] in tuple("123456789") else 0
            parts[i] = shown(standing.get(at), levels[at].style) if 1 <= at <= level and at in levels else None
        out.append("".join(parts) if value is not None and parts != [""] and None not in parts else None)
    return out


def number(value: str | None, otherwise: int | None) -> int | None:
    return otherwise if value is None else int(value) if re.fullmatch(r"[+-]?[0-9]+", value) else None
