"""Cubic curves against marks, whole batches of curves at a time.

All curves of a batch are halved level by level in numpy: a piece that is clearly outside its mark is kept, one
that is clearly inside goes, the rest is halved again, and what is unclear at the last level goes. Every level
handles only the pieces still unclear, so the work follows the number of crossings.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np


Points = list[np.ndarray]


def halves(c: Points) -> tuple[Points, Points]:
    """One coordinate of the four control points of the first and second halves."""
    a, b, d = (c[0] + c[1]) / 2, (c[1] + c[2]) / 2, (c[2] + c[3]) / 2
    e, f = (a + b) / 2, (b + d) / 2
    mid = (e + f) / 2
    return [c[0], a, e, mid], [mid, f, d, c[3]]


def lowest(c: Points) -> np.ndarray:
    return np.minimum(np.minimum(c[0], c[1]), np.minimum(c[2], c[3]))


def highest(c: Points) -> np.ndarray:
    return np.maximum(np.maximum(c[0], c[1]), np.maximum(c[2], c[3]))


def slanted(x: Points, y: Points, r: Points) -> np.ndarray:
    """A line through two of the points separates the hull from the interior of the rectangle (x0, y0, x1, y1)."""
    out = np.zeros(len(x[0]), bool)
    for i, j in combinations(range(4), 2):
        u, v = y[i] - y[j], x[j] - x[i]
        along = [x[k] * u + y[k] * v for k in range(4)]
        # the corners' extremes: rounding is monotone, so the sum of the least products is the least sum
        left, right, below, above = r[0] * u, r[2] * u, r[1] * v, r[3] * v
        least, most = np.minimum(left, right) + np.minimum(below, above), np.maximum(left, right) + np.maximum(below, above)
        out |= ((highest(along) <= least) | (most <= lowest(along))) & ((u != 0) | (v != 0))
    return out


def kept_ranges(p: np.ndarray, marks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, t0, t1) of the parameter ranges outside each row's mark, in order; neighbouring pieces are one range."""
    row = np.arange(len(p))
    t0, t1 = np.zeros(len(p)), np.ones(len(p))
    x, y = ([np.ascontiguousarray(p[:, k, c]) for k in range(4)] for c in (0, 1))
    edges = [np.ascontiguousarray(marks[:, k]) for k in range(4)]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(depth + 1):
        r = edges if level == 0 else [e[row] for e in edges]
        low_x, high_x, low_y, high_y = lowest(x), highest(x), lowest(y), highest(y)
        clear = (high_x <= r[0]) | (low_x >= r[2]) | (high_y <= r[1]) | (low_y >= r[3])
        inside = (low_x > r[0]) & (high_x < r[2]) & (low_y > r[1]) & (high_y < r[3])
        open_ = np.flatnonzero(~(clear | inside))
        x, y = [c[open_] for c in x], [c[open_] for c in y]
        apart = slanted(x, y, [e[open_] for e in r])
        clear[open_[apart]] = True
        kept.append((row[clear], t0[clear], t1[clear]))
        if level == depth or apart.all():
            break
        unclear = open_[~apart]
        x, y = ([np.concatenate(two) for two in zip(*halves([c[~apart] for c in axis]))] for axis in (x, y))
        row, t0, t1 = row[unclear], t0[unclear], t1[unclear]
        mid = (t0 + t1) / 2
        row, t0, t1 = np.concatenate([row, row]), np.concatenate([t0, mid]), np.concatenate([mid, t1])
    row, t0, t1 = (np.concatenate(v) for v in zip(*kept))
    order = np.lexsort([t0, row])
    row, t0, t1 = row[order], t0[order], t1[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (t0[1:] != t1[:-1])
    first = np.flatnonzero(fresh)
    return row[first], t0[first], t1[np.append(first[1:], len(row))[: len(first)] - 1]


def arc(p: np.ndarray, t: np.ndarray, steps: int = 64) -> np.ndarray:
    """Length of each curve up to its parameter, by Simpson's rule."""
    d = 3 * np.diff(p, axis=1)
    h = np.maximum(t, 0) / steps
    s = h[:, None] * np.arange(steps + 1)
    weight = np.stack([(1 - s) ** 2, 2 * s * (1 - s), s * s])
    speed = np.hypot(*(sum(weight[k] * d[:, k, c, None] for k in range(3)) for c in (0, 1)))
    factor = np.where(np.arange(steps + 1) % 2, 4.0, 2.0)
    factor[[0, -1]] = 1.0
    return h / 3 * (speed @ factor)


def kept_arcs(p: np.ndarray, row: np.ndarray, t0: np.ndarray, t1: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Length of each range (row, t0, t1), given the curves' ``whole`` lengths; only ends inside a curve are measured."""
    upto = np.where(t1 == 1, whole[row], 0.0)
    for t, sign in ((t1, 1.0), (t0, -1.0)):
        inner = np.flatnonzero((t > 0) & (t < 1))
        upto[inner] += sign * arc(p[row[inner]], t[inner])
    return upto
