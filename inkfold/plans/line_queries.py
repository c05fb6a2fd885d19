"""Queries over strokes and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import lines as ln
from inkfold.plans.registry import query
from inkfold.plans.sql import with_
from inkfold.sources import evidence as ev

_PT = "sqrt(greatest(mx0 - {0}, {0} - mx1, 0e0) ** 2 + greatest(my0 - {1}, {1} - my1, 0e0) ** 2)"
_SEG = "sqrt((ax + u * dx - {0}) ** 2 + (ay + u * dy - {1}) ** 2)"


def _corner(x: str, y: str) -> str:
    u = f"greatest(0e0, least(1e0, CASE WHEN dx * dx + dy * dy > 0 THEN (({x} - ax) * dx + ({y} - ay) * dy) / (dx * dx + dy * dy) ELSE 0e0 END))"
    return f"sqrt((ax + {u} * dx - {x}) ** 2 + (ay + {u} * dy - {y}) ** 2)"


_DIST = f"""CASE WHEN t0 IS NOT NULL THEN 0e0 ELSE least({_PT.format("ax", "ay")}, {_PT.format("bx", "by_")}, {", ".join(_corner(x, y) for x in ("mx0", "mx1") for y in ("my0", "my1"))}) END"""
_TOUCH = f"SELECT *, {_DIST} AS distance FROM intervals"


@query(
    "line_touch",
    with_(f"SELECT path, seg, round(distance, 6) AS distance, distance <= line_width / 2 + 1e-9 AS stroke_touched, distance <= line_width / 2 + 0.75e0 AS fill_touched FROM ({_TOUCH})", "intervals"),
)
def line_touch(spark, d):
    return ln.touched(ev.strokes(spark, d)).select("path", "seg", F.round("distance", 6).alias("distance"), "stroke_touched", "fill_touched")


_ALONG = """((by_ = ay AND (ay = my0 OR ay = my1) AND least(greatest(ax, bx), mx1) > greatest(least(ax, bx), mx0) + 1e-12)
  OR (bx = ax AND (ax = mx0 OR ax = mx1) AND least(greatest(ay, by_), my1) > greatest(least(ay, by_), my0) + 1e-12))"""


@query("line_clip_intervals", with_(f"SELECT path, seg, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM intervals WHERE t0 IS NOT NULL AND NOT {_ALONG}", "intervals"))
def line_clip_intervals(spark, d):
    return ln.removed_intervals(ev.strokes(spark, d)).where("t0 is not null").select("path", "seg", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


_ENDS = """SELECT path, seg, t0, t1, least(t0 / 2, t1 / 3) AS s0, t1 / 2 AS s1 FROM intervals WHERE t0 IS NOT NULL"""


@query(
    "interval_union",
    with_(
        """SELECT path, round(min(t0), 6) AS t0, round(max(t1), 6) AS t1, count(*) AS parts FROM (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY t0, t1, seg) AS island
        FROM (SELECT *, max(t1) OVER (PARTITION BY path ORDER BY t0, t1, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals WHERE t0 IS NOT NULL)) GROUP BY path, island""",
        "intervals",
    ),
)
def interval_union(spark, d):
    """Removed intervals of a path's segments laid over one another and merged."""
    parts = ln.inner_intervals(ev.strokes(spark, d)).where("t0 is not null").select("path", "t0", "t1")
    return ln.union_intervals(parts, ["path"]).select("path", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "parts")


_PIECES = f"""SELECT c.path, c.seg, k0, k1, w.ax, w.ay, w.bx, w.by_, w.len, w.before + k0 * w.len AS arc FROM (
    SELECT path, seg, 0e0 AS k0, least(t0, 1e0) AS k1 FROM intervals WHERE t0 IS NOT NULL AND NOT {_ALONG} UNION ALL SELECT path, seg, t1, 1e0 FROM intervals WHERE t0 IS NOT NULL AND NOT {_ALONG}
    UNION ALL SELECT path, seg, 0e0, 1e0 FROM intervals WHERE t0 IS NULL OR {_ALONG}) c
  JOIN (SELECT *, coalesce(sum(len) OVER (PARTITION BY path ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM deltas)) w USING (path, seg)
  WHERE k1 > k0 + 1e-12 AND w.len > 0 AND (k1 - k0) * w.len >= 1e-12"""
_RUNS = """SELECT path, run, arg_min(sx, (seg, k0)) AS sx, arg_min(sy, (seg, k0)) AS sy, arg_max(ex, (seg, k0)) AS ex, arg_max(ey, (seg, k0)) AS ey, count(*) AS pieces, arg_min(arc, (seg, k0)) AS arc FROM (
  SELECT *, sum(CASE WHEN pex = sx AND pey = sy THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seg, k0) AS run FROM (SELECT *, lag(ex) OVER (PARTITION BY path ORDER BY seg, k0) AS pex, lag(ey) OVER (PARTITION BY path ORDER BY seg, k0) AS pey FROM (
  SELECT path, seg, k0, arc, CASE WHEN k0 = 0 THEN ax WHEN k0 = 1 THEN bx ELSE ax + (bx - ax) * k0 END AS sx, CASE WHEN k0 = 0 THEN ay WHEN k0 = 1 THEN by_ ELSE ay + (by_ - ay) * k0 END AS sy,
    CASE WHEN k1 = 0 THEN ax WHEN k1 = 1 THEN bx ELSE ax + (bx - ax) * k1 END AS ex, CASE WHEN k1 = 0 THEN ay WHEN k1 = 1 THEN by_ ELSE ay + (by_ - ay) * k1 END AS ey FROM pieces))) GROUP BY path, run"""


@query(
    "line_kept_runs",
    with_("SELECT path, CAST(run AS BIGINT) AS run, round(sx, 5) AS sx, round(sy, 5) AS sy, round(ex, 5) AS ex, round(ey, 5) AS ey, pieces FROM runs", "intervals", "deltas", pieces=_PIECES, runs=_RUNS),
)
def line_kept_runs(spark, d):
    runs = ln.stitched_runs(ln.kept_pieces(ev.strokes(spark, d)))
    return runs.select("path", F.col("run").cast("long").alias("run"), *[F.round(c, 5).alias(c) for c in ("sx", "sy", "ex", "ey")], "pieces")


@query(
    "dash_phases",
    with_(
        """SELECT path, CAST(run AS BIGINT) AS run, round(CASE WHEN abs(ph - period) < 1e-5 OR abs(ph) < 1e-5 THEN 0 ELSE ph END, 4) AS phase, period FROM (SELECT *, (path % 4 + arc) - floor((path % 4 + arc) / period) * period AS ph FROM (SELECT *, CASE path % 3 WHEN 0 THEN 8e0 WHEN 1 THEN 10e0 ELSE 9e0 END AS period FROM runs))""",
        "intervals", "deltas", pieces=_PIECES, runs=_RUNS,
    ),
)
def dash_phases(spark, d):
    """Where each run's dashes resume: arrays [5 3], [5] and [2 3 4] doubled when odd."""
    runs = ln.stitched_runs(ln.kept_pieces(ev.strokes(spark, d)))
    dashes = F.when(F.expr("path % 3 = 0"), F.array(F.lit(5.0), F.lit(3.0))).when(F.expr("path % 3 = 1"), F.array(F.lit(5.0))).otherwise(F.array(F.lit(2.0), F.lit(2.5), F.lit(2.5), F.lit(2.0)))
    out = runs.withColumn("dashes", dashes).withColumn("period", ln.dash_period(F.col("dashes")))
    phase = ln.dash_phase(F.col("dashes"), F.expr("path % 4").cast("double"), F.col("arc"))
    out = out.withColumn("p", phase)
    settled = F.when((F.abs(F.col("p") - F.col("period")) < 1e-5) | (F.abs(F.col("p")) < 1e-5), 0.0).otherwise(F.col("p"))
    return out.select("path", F.col("run").cast("long").alias("run"), F.round(settled, 4).alias("phase"), "period")


_IN = "sum(CASE WHEN (ay > {1}) <> (ny > {1}) AND ax + ({1} - ay) * (nx - ax) / (ny - ay) > {0} THEN 1 ELSE 0 END) % 2 = 1"
_POINTS = [("(mx0 + mx1) / 2", "(my0 + my1) / 2"), ("mx0", "my0"), ("mx0", "my1"), ("mx1", "my0"), ("mx1", "my1")]


@query(
    "path_decisions",
    with_(
        f"""SELECT path, kind, CASE WHEN kind = 'stroke' AND stroke THEN 'rewrite' WHEN kind = 'fill' AND fill THEN 'remove' WHEN kind = 'fillstroke' AND (stroke OR fill) THEN 'remove' ELSE 'verbatim' END AS decision FROM (
        SELECT path, ['stroke', 'fill', 'fillstroke'][path % 3 + 1] AS kind, bool_or(distance <= line_width / 2 + 1e-9) AS stroke, bool_or(distance <= line_width / 2 + 0.75e0) OR {" OR ".join(_IN.format(*q) for q in _POINTS)} AS fill
        FROM (SELECT *, coalesce(lead(ax) OVER w, first(ax) OVER (PARTITION BY path ORDER BY seg)) AS nx, coalesce(lead(ay) OVER w, first(ay) OVER (PARTITION BY path ORDER BY seg)) AS ny FROM ({_TOUCH}) WINDOW w AS (PARTITION BY path ORDER BY seg)) GROUP BY path)""",
        "intervals",
    ),
)
def path_decisions(spark, d):
    return ln.path_decisions(ev.strokes(spark, d))
