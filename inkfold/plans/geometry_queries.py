"""Queries over page geometry, rectangles and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions import predicates as p
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev

_XY = ("x0", "y0", "x1", "y1")


def _context(spark: SparkSession, d: str) -> DataFrame:
    return ev.marks(spark, d).join(ev.page_evidence(spark, d).select("doc_id", "page_index", "rotation", "user_unit", "cx0", "cy0", "cx1", "cy1"), ["doc_id", "page_index"])


def _view(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).withColumn("v", g.to_viewport(g.columns(), g.crop(), F.col("rotation"), F.col("user_unit")))


def _back(df: DataFrame) -> DataFrame:
    v = F.col("v")
    return df.withColumn("back", g.to_canonical(v.x, v.y, v.w, v.h, g.crop(), F.col("rotation"), F.col("user_unit")))


def _rounded(prefix: str, *names: str):
    return [F.round(f"{prefix}{c}", 6).alias(c) for c in names]


@query("pdf_to_viewport", with_("SELECT doc_id, mark_no, round(vx, 6) AS x, round(vy, 6) AS y, round(vw, 6) AS w, round(vh, 6) AS h FROM view", "view"))
def pdf_to_viewport(spark, d):
    return _view(spark, d).select("doc_id", "mark_no", *_rounded("v.", "x", "y", "w", "h"))


_KEPT = "CASE WHEN a < c AND b < d THEN round({0}, 6) END AS {1}"
_CUT = ", ".join(_KEPT.format(k, n) for k, n in zip("abcd", _XY))


@query("viewport_to_pdf", with_(f"SELECT doc_id, mark_no, {_CUT} FROM cut", "cut"))
def viewport_to_pdf(spark, d):
    return _back(_view(spark, d)).select("doc_id", "mark_no", *_rounded("back.", *_XY))


@query("clip_to_crop", with_(f"SELECT doc_id, mark_no, {_CUT}, NOT (a < c AND b < d) AS is_empty FROM cut", "cut"))
def clip_to_crop(spark, d):
    out = _context(spark, d).withColumn("cut", g.clip(g.columns(), g.crop()))
    return out.select("doc_id", "mark_no", *_rounded("cut.", *_XY), F.col("cut").isNull().alias("is_empty"))


@query(
    "rect_round_trip",
    with_("SELECT doc_id, mark_no, a < c AND b < d AND abs(x0 - a) <= 0.02e0 AND abs(y0 - b) <= 0.02e0 AND abs(x1 - c) <= 0.02e0 AND abs(y1 - d) <= 0.02e0 AS is_valid FROM cut", "cut"),
)
def rect_round_trip(spark, d):
    return _back(_view(spark, d)).select("doc_id", "mark_no", round_trip_valid().alias("is_valid"))


def round_trip_valid():
    """Of rows with v and back: the rectangle survives both projections within the tolerance."""
    near = [F.abs(F.col(c) - F.col(f"back.{c}")) <= g.GEOMETRY_EPSILON_PT for c in _XY]
    return F.coalesce((F.col("v.w") > 0) & (F.col("v.h") > 0) & near[0] & near[1] & near[2] & near[3], F.lit(False))


@query(
    "display_size",
    with_(
        """SELECT doc_id, page_index, CASE WHEN rotation % 180 = 0 THEN cx1 - cx0 ELSE cy1 - cy0 END * user_unit * 2 AS w,
        CASE WHEN rotation % 180 = 0 THEN cy1 - cy0 ELSE cx1 - cx0 END * user_unit * 2 AS h FROM pages_""",
        "pages_",
    ),
)
def display_size(spark, d):
    w, h = g.display_size(g.crop(), F.col("rotation"), F.col("user_unit"), 2.0)
    return ev.page_evidence(spark, d).select("doc_id", "page_index", w.alias("w"), h.alias("h"))


@query("transform_rects", with_("SELECT doc_id, mark_no, page_index, round(vx, 6) AS x0, round(vy, 6) AS y0, round(vx + vw, 6) AS x1, round(vy + vh, 6) AS y1 FROM view", "view"))
def transform_rects(spark, d):
    v = F.col("v")
    return _view(spark, d).select("doc_id", "mark_no", "page_index", *[F.round(c, 6).alias(n) for c, n in zip((v.x, v.y, v.x + v.w, v.y + v.h), _XY)])


@query("verify_rects", with_(f"SELECT doc_id || '-' || mark_no AS selection_id, mark_no AS number, doc_id, page_index, {_CUT} FROM cut", "cut"))
def verify_rects(spark, d):
    selection = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("mark_no").cast("string"))
    return _back(_view(spark, d)).select(selection.alias("selection_id"), F.col("mark_no").alias("number"), "doc_id", "page_index", *_rounded("back.", *_XY))


@query(
    "normalized_rotation",
    with_(
        """SELECT doc_id, page_index, CASE WHEN doc_id % 7 <> 0 THEN rotation::DOUBLE END AS exact,
        CASE WHEN doc_id % 7 = 0 THEN (rotation + 45) % 360 ELSE rotation END AS rounded FROM pages_""",
        "pages_",
    ),
)
def normalized_rotation(spark, d):
    raw = F.col("rotation") - 720 * F.expr("doc_id % 3") + F.when(F.expr("doc_id % 7 = 0"), 45).otherwise(0)
    fuzzy = raw.cast("double") + F.when(F.expr("page_index % 2 = 0"), 0.4).otherwise(-0.5)
    return ev.page_evidence(spark, d).select("doc_id", "page_index", g.exact_rotation(raw).cast("double").alias("exact"), g.rounded_rotation(fuzzy).cast("long").alias("rounded"))


@query(
    "page_descriptors",
    with_("SELECT doc_id, page_index, cx0, cy0, cx1, cy1, rotation, user_unit, CASE WHEN has_text THEN 'text_based' ELSE 'blank' END AS classification FROM pages_", "pages_"),
)
def page_descriptors(spark, d):
    return descriptors(ev.page_evidence(spark, d))


def descriptors(pages: DataFrame) -> DataFrame:
    ok = g.valid_context(g.crop(), F.col("rotation"), F.col("user_unit"))
    return pages.where(ok).select("doc_id", "page_index", "cx0", "cy0", "cx1", "cy1", "rotation", "user_unit", F.when(F.col("has_text"), "text_based").otherwise("blank").alias("classification"))


def fnv_lane(text, seed: int):
    """One 32-bit FNV-1a lane over the characters of an ASCII text, as a long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.split(text, ""), F.lit(seed).cast("long"), lambda h, c: F.when(c == "", h).otherwise(step(h, c)))


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_BOX = " || ',' || ".join(_NUM.format(c) for c in ("cx0", "cy0", "cx1", "cy1"))
_CANON = f"""'[' || page_index || ',[' || {_BOX} || '],[' || {_BOX} || '],' || rotation || ',' || {_NUM.format("user_unit")} || ',"' || CASE WHEN has_text THEN 'text_based' ELSE 'blank' END || '"]'"""
_LANE = "list_reduce(list_prepend({0}::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(
    "descriptor_fingerprints",
    with_(
        """SELECT doc_id, count(*) AS pages, string_agg(fp, ':' ORDER BY page_index) AS fingerprint FROM (
        SELECT doc_id, page_index, lpad(lower(to_hex(h2)), 8, '0') || lpad(lower(to_hex(h1)), 8, '0') AS fp FROM lanes) GROUP BY doc_id""",
        "pages_",
        canon=f"SELECT doc_id, page_index, {_CANON} AS s FROM pages_",
        lanes=f"SELECT doc_id, page_index, {_LANE.format('3421674724')} AS h1, {_LANE.format('2216829733')} AS h2 FROM canon",
    ),
)
def descriptor_fingerprints(spark, d):
    box = F.concat(F.lit("["), F.concat_ws(",", *map(g.number_text, g.crop())), F.lit("]"))
    parts = [F.col("page_index").cast("string"), box, box, F.col("rotation").cast("string"), g.number_text(F.col("user_unit")), F.concat(F.lit('"'), F.col("classification"), F.lit('"'))]
    canon = descriptors(ev.page_evidence(spark, d)).withColumn("canon", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))
    lane = lambda seed: F.lpad(F.lower(F.hex(fnv_lane(F.col("canon"), seed))), 8, "0")
    prints = canon.select("doc_id", "page_index", F.concat(lane(0x84222325), lane(0xCBF29CE4)).alias("fp"))
    return prints.groupBy("doc_id").agg(F.count("*").alias("pages"), F.expr("listagg(fp, ':') WITHIN GROUP (ORDER BY page_index)").alias("fingerprint"))


@query(
    "geometry_fingerprints",
    with_(
        f"""SELECT doc_id, page_index, '0,0,612,792,' || {_BOX} || ',' || rotation || ',' || {_NUM.format("user_unit")} AS geometry,
        'crop=' || {_BOX} || ';rot=' || rotation || ';uu=' || {_NUM.format("user_unit")} AS transform FROM pages_""",
        "pages_",
    ),
)
def geometry_fingerprints(spark, d):
    return ev.page_evidence(spark, d).select("doc_id", "page_index", geometry_fingerprint().alias("geometry"), g.context_fingerprint(g.crop(), F.col("rotation"), F.col("user_unit")).alias("transform"))


def geometry_fingerprint():
    media = [F.lit(float(v)) for v in (0, 0, 612, 792)]
    return F.concat_ws(",", *map(g.number_text, [*media, *g.crop()]), F.col("rotation").cast("string"), g.number_text(F.col("user_unit")))


@query(
    "box_normalization",
    with_(
        """SELECT doc_id, mark_no, CASE WHEN doc_id % 14 <> 0 THEN x0 END AS nx0, CASE WHEN doc_id % 14 <> 0 THEN y0 END AS ny0, CASE WHEN doc_id % 14 <> 0 THEN x1 END AS nx1,
        CASE WHEN doc_id % 14 <> 0 THEN y1 END AS ny1, doc_id % 14 <> 0 AND doc_id % 4 <> 0 AND x0 >= cx0 AND y0 >= cy0 AND x1 <= cx1 AND y1 <= cy1 AS is_canonical,
        doc_id % 22 <> 0 AS is_context FROM markctx""",
        "markctx",
    ),
)
def box_normalization(spark, d):
    """Rectangles with swapped corners, and some with a NaN or an infinity."""
    turned = F.expr("doc_id % 4 = 0")
    bad = F.when(F.expr("doc_id % 28 = 0"), float("nan")).when(F.expr("doc_id % 14 = 0"), float("inf"))
    raw = _context(spark, d).select(
        "*", F.coalesce(bad, F.when(turned, F.col("x1")).otherwise(F.col("x0"))).alias("a"), F.when(turned, F.col("y1")).otherwise(F.col("y0")).alias("b"),
        F.when(turned, F.col("x0")).otherwise(F.col("x1")).alias("c"), F.when(turned, F.col("y0")).otherwise(F.col("y1")).alias("e"),
    )
    box = tuple(F.col(c) for c in "abce")
    unit = F.when(F.expr("doc_id % 44 = 0"), float("nan")).when(F.expr("doc_id % 22 = 0"), 0.0).otherwise(F.col("user_unit"))
    return raw.withColumn("n", g.normalized(box)).select(
        "doc_id", "mark_no", *[F.col(f"n.{c}").alias(f"n{c}") for c in _XY], g.valid_canonical(box, g.crop()).alias("is_canonical"), g.valid_context(g.crop(), F.col("rotation"), unit).alias("is_context"),
    )


_M = "1 + path % 3", "0", "0", "1 + path % 3", "path % 50", "seg * 5"


@query(
    "matrix_compose",
    with_(
        """SELECT path, seg, s * (1 + seg % 2) AS a, 0e0 AS b, 0e0 AS c, s * (1 + seg % 2) AS d, s * 10 + path % 50 AS e, s * (path % 20) + seg * 5 AS f
        FROM (SELECT path, seg, (1 + path % 3)::DOUBLE AS s FROM segs)""",
        "segs",
    ),
)
def matrix_compose(spark, d):
    outer = tuple(F.expr(x).cast("double") for x in _M)
    inner = tuple(F.expr(x).cast("double") for x in ("1 + seg % 2", "0", "0", "1 + seg % 2", "10", "path % 20"))
    return ev.strokes(spark, d).select("path", "seg", *[v.alias(k) for k, v in zip("abcdef", g.compose(outer, inner))])


@query(
    "local_marks",
    with_(
        """SELECT path, seg, CASE WHEN path % 5 < 3 THEN round((mx0 - 7) / s, 6) END AS x0, CASE WHEN path % 5 < 3 THEN round((my0 + 3) / s, 6) END AS y0,
        CASE WHEN path % 5 < 3 THEN round((mx1 - 7) / s, 6) END AS x1, CASE WHEN path % 5 < 3 THEN round((my1 + 3) / s, 6) END AS y1,
        path % 5 < 3 AND ax > (mx0 - 7) / s AND ax < (mx1 - 7) / s AND ay > (my0 + 3) / s AND ay < (my1 + 3) / s AS start_inside
        FROM (SELECT *, (1 + path % 3)::DOUBLE AS s FROM segs)""",
        "segs",
    ),
)
def local_marks(spark, d):
    """Marks under scaled, skewed (remainder 3) and singular (remainder 4) matrices."""
    s = F.expr("1 + path % 3").cast("double")
    skew = F.when(F.expr("path % 5 = 3"), 0.25).otherwise(0.0)
    matrix = (F.when(F.expr("path % 5 = 4"), 0.0).otherwise(s), skew, F.lit(0.0), s, F.lit(7.0), F.lit(-3.0))
    mark = tuple(F.col(f"m{c}") for c in _XY)
    out = ev.strokes(spark, d).withColumn("m", g.local_mark(matrix, mark))
    hit = F.coalesce(p.strictly_inside(F.col("ax"), F.col("ay"), g.columns("m.")), F.lit(False))
    return out.select("path", "seg", *_rounded("m.", *_XY), hit.alias("start_inside"))
