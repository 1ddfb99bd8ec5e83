"""Boxes (left, top, right, bottom; origin at the top) and affine matrices [a, b, c, d, e, f] as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flip(bottom_left_box: Column, page_height: Column) -> Column:
    """A box measured from the bottom, measured from the top; null if it is not one."""
    b = bottom_left_box
    ok = (b["right"] >= b["left"]) & (b["top"] >= b["bottom"])
    return F.when(ok, F.struct(b["left"].alias("left"), (page_height - b["top"]).alias("top"), b["right"].alias("right"), (page_height - b["bottom"]).alias("bottom")))


def area(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common area by the smaller area; 0 where that is empty."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(F.lit(0.0))


def band(ratio: Column) -> Column:
    """In from 0.8, out to 0.2, ambiguous between."""
    return F.when(ratio >= 0.8, "inside").when(ratio <= 0.2, "outside").otherwise("ambiguous")


def compose(outer: Column, inner: Column) -> Column:
    o, i = [outer[k] for k in range(6)], [inner[k] for k in range(6)]
    return F.array(
        o[0] * i[0] + o[2] * i[1], o[1] * i[0] + o[3] * i[1], o[0] * i[2] + o[2] * i[3], o[1] * i[2] + o[3] * i[3], o[0] * i[4] + o[2] * i[5] + o[4], o[1] * i[4] + o[3] * i[5] + o[5]
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def same_line(a: Column, b: Column) -> Column:
    """Vertical overlap of half the smaller height and a gap of at most one height."""
    small = F.least(a["bottom"] - a["top"], b["bottom"] - b["top"])
    shared = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    gap = F.greatest(a["left"], b["left"]) - F.least(a["right"], b["right"])
    return (small > 0) & (shared >= 0.5 * small) & (gap <= F.greatest(a["bottom"] - a["top"], b["bottom"] - b["top"]))
