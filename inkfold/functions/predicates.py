"""Predicates on rectangles, points and segments. The three overlaps differ and never stand for one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.functions.geometry import Box


def touches(a: Box, b: Box) -> Column:
    """Inclusive overlap: a shared edge counts."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def overlaps(a: Box, b: Box) -> Column:
    """Overlap with positive area."""
    return (F.least(a[2], b[2]) - F.greatest(a[0], b[0]) > 0) & (F.least(a[3], b[3]) - F.greatest(a[1], b[1]) > 0)


def strictly_inside(x: Column, y: Column, r: Box) -> Column:
    return (x > r[0]) & (x < r[2]) & (y > r[1]) & (y < r[3])


def inside(x: Column, y: Column, r: Box) -> Column:
    """Half open, for pixels."""
    return (x >= r[0]) & (x < r[2]) & (y >= r[1]) & (y < r[3])


def segment_slab(ax: Column, ay: Column, bx: Column, by: Column, r: Box) -> Column:
    """Parameters t0 and t1 where a segment's line has entered and first leaves the rectangle's four half planes, and
    whether it ``misses`` one of them that it runs along."""
    dx, dy = bx - ax, by - ay
    edges = [(-dx, ax - r[0]), (dx, r[2] - ax), (-dy, ay - r[1]), (dy, r[3] - ay)]
    flat = [F.abs(p) < 1e-18 for p, _ in edges]
    t0 = F.greatest(F.lit(0.0), *[F.when(~f & (p < 0), F.try_divide(q, p)).otherwise(0.0) for f, (p, q) in zip(flat, edges)])
    t1 = F.least(F.lit(1.0), *[F.when(~f & (p > 0), F.try_divide(q, p)).otherwise(1.0) for f, (p, q) in zip(flat, edges)])
    misses = reduce(lambda a, b: a | b, [f & (q < 0) for f, (_, q) in zip(flat, edges)])
    return F.struct(t0.alias("t0"), t1.alias("t1"), misses.alias("misses"))


def meets(slab: Column) -> Column:
    return ~slab["misses"] & (slab["t0"] <= slab["t1"])


def segment_interval(ax: Column, ay: Column, bx: Column, by: Column, r: Box) -> tuple[Column, Column]:
    """Parameters t0 <= t1 of the part of a segment in the closed rectangle; null if none."""
    slab = segment_slab(ax, ay, bx, by, r)
    return F.when(meets(slab), slab["t0"]), F.when(meets(slab), slab["t1"])


def along_edge(ax: Column, ay: Column, bx: Column, by: Column, r: Box) -> Column:
    """The segment runs along an edge of the rectangle for more than a point."""

    def level(p: Column, q: Column, at: Column, length: Column) -> Column:
        return (F.abs(p - at) <= 1e-9) & (F.abs(q - at) <= 1e-9) & (length > 0)

    def shared(p: Column, q: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(p, q), high) > F.greatest(F.least(p, q), low) + 1e-12

    w, h = r[2] - r[0], r[3] - r[1]
    flat = (level(ay, by, r[1], w) | level(ay, by, r[3], w)) & shared(ax, bx, r[0], r[2])
    upright = (level(ax, bx, r[0], h) | level(ax, bx, r[2], h)) & shared(ay, by, r[1], r[3])
    return flat | upright


def enters(ax: Column, ay: Column, bx: Column, by: Column, r: Box) -> Column:
    """The segment meets the rectangle's interior."""
    t0, t1 = segment_interval(ax, ay, bx, by, r)
    mid = (t0 + t1) / 2
    through = (t1 - t0 >= 1e-12) & strictly_inside(ax + mid * (bx - ax), ay + mid * (by - ay), r)
    return strictly_inside(ax, ay, r) | strictly_inside(bx, by, r) | F.coalesce(through, F.lit(False))


def point_distance(x: Column, y: Column, r: Box) -> Column:
    dx = F.greatest(r[0] - x, x - r[2], F.lit(0.0))
    dy = F.greatest(r[1] - y, y - r[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, size), F.lit(0.0))))
    return F.sqrt((ax + t * dx - px) ** 2 + (ay + t * dy - py) ** 2)


def corner_distances(ax: Column, ay: Column, bx: Column, by: Column, r: Box) -> list[Column]:
    return [point_segment(x, y, ax, ay, bx, by) for x in (r[0], r[2]) for y in (r[1], r[3])]


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column, r: Box, slab: Column | None = None, corners: list[Column] | None = None) -> Column:
    """Distance of a segment from the closed rectangle: zero where it enters; else the nearest of its ends
    to the rectangle and of the corners to it. slab, corners: the segment's, where they are at hand."""
    corners = corner_distances(ax, ay, bx, by, r) if corners is None else corners
    apart = F.least(point_distance(ax, ay, r), point_distance(bx, by, r), *corners)
    return F.when(meets(segment_slab(ax, ay, bx, by, r) if slab is None else slab), 0.0).otherwise(apart)


def within(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance
