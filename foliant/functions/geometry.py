"""Boxes on the 1000 grid as expressions: validation, algebra, patches and alignment scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000.0


def box(values: Column) -> Column:
    """x0, y0, x1, y1 of an array of four numbers, null unless it spans an area."""
    v = [F.get(values, F.lit(i)).try_cast("double") for i in range(4)]
    good = (F.size(values) == 4) & (v[2] > v[0]) & (v[3] > v[1])
    return F.when(good, F.struct(*[x.alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of a that lies in b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def center(a: Column) -> tuple[Column, Column]:
    return (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2


def contains_point(a: Column, x: Column, y: Column) -> Column:
    return (a["x0"] <= x) & (x <= a["x1"]) & (a["y0"] <= y) & (y <= a["y1"])


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Between two intervals, zero where they meet."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(gap(a["x0"], a["x1"], b["x0"], b["x1"]), gap(a["y0"], a["y1"], b["y0"], b["y1"]))


def vertical_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def padded_union(a: Column, b: Column, pad: float = 0.0) -> Column:
    """The box around both, padded, within the grid."""
    return F.struct(
        F.greatest(F.lit(0.0), F.least(a["x0"], b["x0"]) - pad).alias("x0"), F.greatest(F.lit(0.0), F.least(a["y0"], b["y0"]) - pad).alias("y0"),
        F.least(F.lit(GRID), F.greatest(a["x1"], b["x1"]) + pad).alias("x1"), F.least(F.lit(GRID), F.greatest(a["y1"], b["y1"]) + pad).alias("y1"),
    )


def patch_box(index: Column, width: int, height: int) -> Column:
    """The cell of a row-major patch grid."""
    x, y = F.pmod(index, F.lit(width)), F.floor(index / width)
    w, h = GRID / width, GRID / height
    return F.struct((x * w).alias("x0"), (y * h).alias("y0"), ((x + 1) * w).alias("x1"), ((y + 1) * h).alias("y1"))


def page_box(a: Column, page_width: Column, page_height: Column, pad: float = 0.0) -> Column:
    """A grid box in page units, padded, within the page."""
    sx, sy = page_width / GRID, page_height / GRID
    return F.struct(
        F.greatest(F.lit(0.0), a["x0"] * sx - pad).alias("x0"), F.greatest(F.lit(0.0), a["y0"] * sy - pad).alias("y0"),
        F.least(page_width, a["x1"] * sx + pad).alias("x1"), F.least(page_height, a["y1"] * sy + pad).alias("y1"),
    )


def box_alignment(covered: Column, listed: Column, boxes_here: Column, boxes_all: Column) -> Column:
    """How well a chunk fits a page that was hit (G9): by the share of its boxes there and whether it is listed."""
    share = F.when(boxes_all > 0, boxes_here / boxes_all).otherwise(0.0)
    base = F.when(listed, 1.0).otherwise(0.75)
    return (
        F.when(~covered | (~listed & (boxes_here == 0)), 0.0)
        .when(share <= 0, F.when(listed, 0.65).otherwise(0.5))
        .otherwise(F.least(F.lit(1.0), base * (0.5 + 0.5 * share)))
    )


def resized(width: Column, height: Column, longest: int) -> Column:
    """Width and height of a picture whose longest side is at most `longest`."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.floor(height * scale).cast("int")).alias("height"))
