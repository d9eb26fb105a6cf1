"""Planar geometry as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Straight-line distance."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """L1 distance."""
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def along(a: Column, b: Column, pos: Column, w: Column) -> Column:
    """One coordinate of the place ``pos`` along an edge of weight w from a to b; a itself on an edge of weight 0."""
    return F.when(w == 0, a).otherwise(a + pos / w * (b - a))


def projected(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, w: Column) -> Column:
    """The offset, in weight units, of the nearest place on an edge to (px, py), clamped to [0, w]."""
    length2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    share = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length2
    return F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * w)


class Box:
    """A rectangle of four columns (or numbers): xmin, xmax, ymin, ymax."""

    def __init__(self, xmin, xmax, ymin, ymax):
        self.sides = tuple(x if isinstance(x, Column) else F.lit(float(x)) for x in (xmin, xmax, ymin, ymax))

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        """From columns named xmin, xmax, ymin, ymax behind a prefix."""
        return cls(*[F.col(f"{prefix}{s}") for s in ("xmin", "xmax", "ymin", "ymax")])

    @classmethod
    def around(cls, x1: Column, y1: Column, x2: Column, y2: Column) -> "Box":
        """The bounding rectangle of a segment."""
        return cls(F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2))

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{s}") for c, s in zip(self.sides, ("xmin", "xmax", "ymin", "ymax"), strict=True)]

    def area(self) -> Column:
        a, b, c, d = self.sides
        return (b - a) * (d - c)

    def margin(self) -> Column:
        """Half the perimeter."""
        a, b, c, d = self.sides
        return (b - a) + (d - c)

    def joined(self, other: "Box") -> "Box":
        a, b, c, d = self.sides
        e, f, g, h = other.sides
        return Box(F.least(a, e), F.greatest(b, f), F.least(c, g), F.greatest(d, h))

    def overlap(self, other: "Box") -> Column:
        a, b, c, d = self.sides
        e, f, g, h = other.sides
        none = F.lit(0.0)
        return F.greatest(F.least(b, f) - F.greatest(a, e), none) * F.greatest(F.least(d, h) - F.greatest(c, g), none)

    def enlargement(self, other: "Box") -> Column:
        """Area that this rectangle gains when it also covers the other."""
        return self.joined(other).area() - self.area()

    def gap2(self, other: "Box") -> Column:
        """Squared least distance between two rectangles; 0 if they meet."""
        a, b, c, d = self.sides
        e, f, g, h = other.sides
        dx, dy = F.greatest(e - b, a - f, F.lit(0.0)), F.greatest(g - d, c - h, F.lit(0.0))
        return dx * dx + dy * dy

    def gap(self, other: "Box") -> Column:
        return F.sqrt(self.gap2(other))

    def meets(self, other: "Box") -> Column:
        a, b, c, d = self.sides
        e, f, g, h = other.sides
        return (a <= f) & (e <= b) & (c <= h) & (g <= d)

    def inside(self, other: "Box") -> Column:
        """Whether this rectangle lies within the other."""
        a, b, c, d = self.sides
        e, f, g, h = other.sides
        return (a >= e) & (b <= f) & (c >= g) & (d <= h)

    def holds(self, x: Column, y: Column) -> Column:
        a, b, c, d = self.sides
        return x.between(a, b) & y.between(c, d)

    def meets_disc(self, x: Column, y: Column, r, slack: float = 1e-8) -> Column:
        r = r if isinstance(r, Column) else F.lit(float(r))
        return self.gap2(Box(x, x, y, y)) <= r * r + slack


def relation(box: Box, window: Box) -> Column:
    """'inside', 'overlap' or 'disjoint': how a rectangle lies to a window."""
    return F.when(box.inside(window), "inside").when(box.meets(window), "overlap").otherwise("disjoint")


def cell(x: Column, y: Column, size_x, size_y, n: int) -> Column:
    """The grid cell of a place: column * n + row, the last column and row taking what lies beyond."""
    cx = F.least(F.floor(x / size_x), F.lit(n - 1))
    cy = F.least(F.floor(y / size_y), F.lit(n - 1))
    return (cx * n + cy).cast("long")


def rescaled(x: Column, low: Column, high: Column, to: float = 10000.0) -> Column:
    """Min-max scaling to [0, to]; a constant column becomes 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((x - low) * to / (high - low))
