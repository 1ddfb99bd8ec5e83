"""List markers: counters rendered as decimals, letters, Roman or circled numerals, and level patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VALUE, MAX_CIRCLED, MAX_LETTER = 1000, 20, 26
# The digits of Roman numerals, ones to hundreds, and the code points where letter styles begin.
ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
)
LETTERS = {"upper_letter": 0x41, "lower_letter": 0x61, "circled_upper_letter": 0x24B6, "circled_lower_letter": 0x24D0}
CIRCLED = 0x2460


def roman(value: Column) -> Column:
    digit = lambda table, n: F.element_at(F.array(*map(F.lit, table)), (n % 10 + 1).cast("int"))
    v = value.cast("int")
    return F.when(v == 1000, "M").otherwise(F.concat(digit(ROMAN[2], F.floor(v / 100)), digit(ROMAN[1], F.floor(v / 10)), digit(ROMAN[0], v)))


def _from(origin: int, count: int, value: Column) -> Column:
    return F.element_at(F.array(*(F.lit(chr(origin + i)) for i in range(count))), value.cast("int"))


def render(value: Column, style: str) -> Column:
    """The displayed characters of a counter; null outside the range of the style."""
    inside = value.between(1, MAX_VALUE)
    if style == "decimal":
        return F.when(value.between(0, MAX_VALUE), value.cast("string"))
    if style == "upper_roman":
        return F.when(inside, roman(value))
    if style == "lower_roman":
        return F.when(inside, F.lower(roman(value)))
    if style == "circled_decimal":
        return F.when(value.between(1, MAX_CIRCLED), _from(CIRCLED, MAX_CIRCLED, F.greatest(F.lit(1), F.least(value, F.lit(MAX_CIRCLED)))))
    if style in LETTERS:
        return F.when(value.between(1, MAX_LETTER), _from(LETTERS[style], MAX_LETTER, F.greatest(F.lit(1), F.least(value, F.lit(MAX_LETTER)))))
    return F.lit(None).cast("string")


def substitute(pattern: str, marker: str, levels: dict[int, Column]) -> Column:
    """The pattern with each marker-digit reference replaced by that level's text; null if one is missing or malformed."""
    parts: list[Column] = []
    rest = pattern
    while rest:
        head, found, rest = rest.partition(marker)
        if head:
            parts.append(F.lit(head))
        if found:
            level = int(rest[0]) if rest[:1] in tuple("123456789") else 0
            if level not in levels:
                return F.lit(None).cast("string")
            parts.append(levels[level])
            rest = rest[1:]
    return F.concat(*parts) if parts else F.lit(None).cast("string")


def scheme_label(value: Column, style: str, template: str) -> Column:
    """A presentation scheme's template with "{}" replaced by the rendered counter."""
    return F.replace(F.lit(template), F.lit("{}"), render(value, style))
