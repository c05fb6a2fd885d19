"""Geometry of pages and rectangles: canonical points (y up), viewport pixels (y down), device pixels.

Every helper is a Column expression and null wherever its input is invalid: non-finite, unordered or
outside what it accepts. Comparisons guard against NaN, which Spark orders above every number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCENT_RATIO, ASCENT_RATIO = 0.3, 1.0
GEOMETRY_EPSILON_PT = 0.02
Box = tuple[Column, Column, Column, Column]


def columns(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def crop() -> Box:
    return F.col("cx0"), F.col("cy0"), F.col("cx1"), F.col("cy1")


def finite(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values])


def ordered(box: Box) -> Column:
    return finite(*box) & (box[0] < box[2]) & (box[1] < box[3])


def struct(box: Box) -> Column:
    return F.struct(*[v.alias(c) for v, c in zip(box, ("x0", "y0", "x1", "y1"))])


def exact_rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270, else null."""
    turn = F.pmod(degrees, F.lit(360))
    return F.when(turn.isin(0, 90, 180, 270), turn)


def rounded_rotation(degrees: Column) -> Column:
    """Rotation after rounding half up, without the membership test."""
    return F.pmod(F.floor(degrees + F.lit(0.5)), F.lit(360))


def valid_context(box: Box, rotation: Column, user_unit: Column) -> Column:
    return F.coalesce(ordered(box) & finite(user_unit) & (user_unit > 0) & exact_rotation(rotation).isNotNull(), F.lit(False))


def valid_canonical(rect: Box, box: Box) -> Column:
    """Ordered and inside the crop box."""
    return F.coalesce(ordered(rect) & (rect[0] >= box[0]) & (rect[1] >= box[1]) & (rect[2] <= box[2]) & (rect[3] <= box[3]), F.lit(False))


def clip(rect: Box, box: Box) -> Column:
    """The rectangle within the crop box as a struct, null if nothing of it remains."""
    cut = (F.greatest(rect[0], box[0]), F.greatest(rect[1], box[1]), F.least(rect[2], box[2]), F.least(rect[3], box[3]))
    return F.when(ordered(cut), struct(cut))


def normalized(box: Box) -> Column:
    """Corners in order, null unless all four are finite."""
    a, b, c, d = box
    return F.when(finite(a, b, c, d), struct((F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))))


def _turned(rotation: Column, *cases: Column) -> Column:
    return reduce(lambda out, x: out.when(rotation == x[0], x[1]), zip((90, 180, 270), cases[1:]), F.when(rotation == 0, cases[0]))


def to_viewport(rect: Box, box: Box, rotation: Column, user_unit: Column, scale: float = 1.0) -> Column:
    """Struct x, y, w, h in viewport pixels."""
    k = user_unit * F.lit(scale)
    x0, y0, x1, y1 = rect
    cx0, cy0, cx1, cy1 = box

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        return (
            _turned(rotation, (x - cx0) * k, (y - cy0) * k, (cx1 - x) * k, (cy1 - y) * k),
            _turned(rotation, (cy1 - y) * k, (x - cx0) * k, (y - cy0) * k, (cx1 - x) * k),
        )

    (ax, ay), (bx, by) = point(x0, y0), point(x1, y1)
    return F.struct(F.least(ax, bx).alias("x"), F.least(ay, by).alias("y"), F.abs(bx - ax).alias("w"), F.abs(by - ay).alias("h"))


def to_canonical(x: Column, y: Column, w: Column, h: Column, box: Box, rotation: Column, user_unit: Column, scale: float = 1.0) -> Column:
    """Struct x0, y0, x1, y1 in points within the crop box, null if nothing remains."""
    k = user_unit * F.lit(scale)
    cx0, cy0, cx1, cy1 = box

    def point(px: Column, py: Column) -> tuple[Column, Column]:
        return (
            _turned(rotation, cx0 + px / k, cx0 + py / k, cx1 - px / k, cx1 - py / k),
            _turned(rotation, cy1 - py / k, cy0 + px / k, cy0 + py / k, cy1 - px / k),
        )

    (ax, ay), (bx, by) = point(x, y), point(x + w, y + h)
    return clip((F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)), box)


def display_size(box: Box, rotation: Column, user_unit: Column, scale: float = 1.0) -> tuple[Column, Column]:
    k = user_unit * F.lit(scale)
    w, h = (box[2] - box[0]) * k, (box[3] - box[1]) * k
    upright = F.pmod(rotation, F.lit(180)) == 0
    return F.when(upright, w).otherwise(h), F.when(upright, h).otherwise(w)


def number_text(x: Column) -> Column:
    """A double the way a script engine prints it: whole numbers without a point, at most six decimals here."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""))


def context_fingerprint(box: Box, rotation: Column, user_unit: Column) -> Column:
    return F.concat(F.lit("crop="), F.concat_ws(",", *map(number_text, box)), F.lit(";rot="), rotation.cast("string"), F.lit(";uu="), number_text(user_unit))


def with_text_box(items: DataFrame) -> DataFrame:
    """Items with their ink box x0, y0, x1, y1: the baseline along (a, b), 0.3 of the height below and 1.0
    above, swapped for a mirrored matrix. Items without advance or height, or without a matrix of six
    finite numbers, have no box and drop out. Staged, so that each step is computed once."""
    a, b, c, d, e, f = (F.col(f"__{k}") for k in "abcdef")
    names = {f"__{k}": F.get("transform", F.lit(i)) for i, k in enumerate("abcdef")}
    out = items.where(F.size("transform") == 6).withColumns(names).where(finite(a, b, c, d, e, f, F.col("width")))
    out = out.withColumns({"__advance": F.hypot(a, b), "__height": F.hypot(c, d)}).where("__advance > 0 and __height > 0")
    mirrored = a * d - b * c < 0
    out = out.withColumns({
        "__ux": a / F.col("__advance"), "__uy": b / F.col("__advance"),
        "__below": F.when(mirrored, ASCENT_RATIO).otherwise(DESCENT_RATIO) * F.col("__height"),
        "__above": F.when(mirrored, DESCENT_RATIO).otherwise(ASCENT_RATIO) * F.col("__height"),
    })
    ux, uy, below, above, w = (F.col(k) for k in ("__ux", "__uy", "__below", "__above", "width"))
    # the upward direction is the baseline turned by a quarter: (-uy, ux)
    xs = [e + uy * below, e + ux * w + uy * below, e - uy * above, e + ux * w - uy * above]
    ys = [f - ux * below, f + uy * w - ux * below, f + ux * above, f + uy * w + ux * above]
    # never null, and said so: else joins on the box push null tests, with all of the above, below the items
    edges = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    out = out.withColumns({k: F.coalesce(v, F.lit(float("nan"))) for k, v in edges.items()})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def upright_box(size: float, x: Column, y: Column, width: Column) -> Box:
    """The ink box of an item with the matrix (size, 0, 0, size, x, y) and a width of at least zero: that of
    with_text_box, for items in arrays, whose expressions are not compiled and should be short."""
    return x, y - DESCENT_RATIO * size, x + width, y + ASCENT_RATIO * size


def device_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Viewport rectangle in whole device pixels, outward, within the raster; null if empty."""
    box = (F.greatest(F.lit(0), F.floor(x)), F.greatest(F.lit(0), F.floor(y)), F.least(width, F.ceil(x + w)), F.least(height, F.ceil(y + h)))
    box = tuple(v.cast("long") for v in box)
    return F.when((box[0] < box[2]) & (box[1] < box[3]), struct(box))  # type: ignore[arg-type]


def shrink(box: Box, by: int) -> Column:
    inner = (box[0] + by, box[1] + by, box[2] - by, box[3] - by)
    return F.when((inner[0] < inner[2]) & (inner[1] < inner[3]), struct(inner))


def expand(box: Box, by: int, width: Column, height: Column) -> Column:
    return struct((F.greatest(F.lit(0), box[0] - by), F.greatest(F.lit(0), box[1] - by), F.least(width, box[2] + by), F.least(height, box[3] + by)))


Matrix = tuple[Column, Column, Column, Column, Column, Column]


def compose(outer: Matrix, inner: Matrix) -> Matrix:
    """The matrix that applies ``inner`` first."""
    a, b, c, d, e, f = outer
    ma, mb, mc, md, me, mf = inner
    return a * ma + c * mb, b * ma + d * mb, a * mc + c * md, b * mc + d * md, a * me + c * mf + e, b * me + d * mf + f


def local_mark(matrix: Matrix, mark: Box) -> Column:
    """The mark in stream coordinates; null for a non-finite, turned, singular or non-uniform matrix or an unordered mark."""
    a, b, c, d, e, f = matrix
    even = F.abs(F.abs(a) - F.abs(d)) <= F.lit(1e-9) * F.greatest(F.abs(a), F.abs(d))
    ok = finite(a, b, c, d, e, f) & (F.abs(b) <= 1e-12) & (F.abs(c) <= 1e-12) & (a != 0) & (d != 0) & even & ordered(mark)
    xs, ys = [F.try_divide(v - e, a) for v in (mark[0], mark[2])], [F.try_divide(v - f, d) for v in (mark[1], mark[3])]
    return F.when(ok, struct((F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))))
