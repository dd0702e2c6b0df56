"""Plane geometry as Columns: lengths, projection on a segment, crossings, grid keys, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def around(x: Column, size: float) -> Column:
    """The cell of x and its two neighbours, one a row after explode()."""
    return F.array(cell(x, size) - 1, cell(x, size), cell(x, size) + 1)


def place_on(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of the segment at which the point nearest to p lies, 0 to 1."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size)))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Over 0 if p is left of a-b, under 0 if right."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Two segments (x1, y1, x2, y2) cross at a point inside both."""
    s1, s2 = side(*a, *b[:2]), side(*a, *b[2:])
    s3, s4 = side(*b, *a[:2]), side(*b, *a[2:])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def turn_direction(before: Column, after: Column) -> Column:
    """Change of heading (degrees): under 35 straight, over 150 u_turn, else left (positive) or right."""
    d = F.pmod(after - before + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(d) < 35, "straight").when(F.abs(d) > 150, "u_turn").when(d > 0, "left").otherwise("right")


def cells_along(x1: Column, y1: Column, x2: Column, y2: Column, size: float, pad: float) -> Column:
    """Structs (cx, cy) of the grid cells at most pad from the segment: per column of cells the rows it passes, not its whole box."""
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    slope = F.when(x1 == x2, F.lit(0.0)).otherwise((y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)))

    def column(cx: Column) -> Column:
        a, b = F.greatest(left, cx * F.lit(float(size)) - pad), F.least(right, (cx + 1) * F.lit(float(size)) + pad)
        a, b = F.least(a, right), F.greatest(b, left)
        ya, yb = y1 + (a - x1) * slope, y1 + (b - x1) * slope
        low = F.when(x1 == x2, F.least(y1, y2)).otherwise(F.least(ya, yb)) - pad
        high = F.when(x1 == x2, F.greatest(y1, y2)).otherwise(F.greatest(ya, yb)) + pad
        return F.transform(F.sequence(cell(low, size), cell(high, size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(left - pad, size), cell(right + pad, size)), column))


def meeting(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """x, y of where the lines through two segments meet, and its share of each segment; null if parallel."""
    ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    turn = F.nullif(ux * vy - uy * vx, F.lit(0.0))
    t = ((b[0] - a[0]) * vy - (b[1] - a[1]) * vx) / turn
    s = ((b[0] - a[0]) * uy - (b[1] - a[1]) * ux) / turn
    return a[0] + t * ux, a[1] + t * uy, t, s
