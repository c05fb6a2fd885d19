import math
import random

import pytest
from pyspark.sql import functions as F

from inkfold.functions import geometry as g
from inkfold.functions import predicates as p

CROPS = [(0, 0, 612, 792), (36, 48, 576, 744), (-50, -20, 300, 500)]
CONTEXTS = [(c, r, u) for c in CROPS for r, u in ((0, 1.0), (90, 2.0), (180, 0.5), (270, 1.0))]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit_box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_round_trip_over_contexts(spark):
    rng = random.Random(5)
    rows = []
    for crop, rotation, unit in CONTEXTS:
        for _ in range(25):
            x0, x1 = sorted(rng.uniform(crop[0], crop[2]) for _ in range(2))
            y0, y1 = sorted(rng.uniform(crop[1], crop[3]) for _ in range(2))
            rows.append((float(x0), float(y0), float(x1), float(y1), *map(float, crop), rotation, unit))
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, cx0 double, cy0 double, cx1 double, cy1 double, rotation int, user_unit double")
    df = df.withColumn("v", g.to_viewport(g.columns(), g.crop(), F.col("rotation"), F.col("user_unit"), 1.5))
    v = F.col("v")
    df = df.withColumn("b", g.to_canonical(v.x, v.y, v.w, v.h, g.crop(), F.col("rotation"), F.col("user_unit"), 1.5))
    for r in df.collect():
        assert r.b is not None
        assert max(abs(r.b[c] - r[c]) for c in ("x0", "y0", "x1", "y1")) < 1e-9
        assert r.v.x >= -1e-9 and r.v.y >= -1e-9


def test_rotation(spark):
    r = one(spark, a=g.exact_rotation(F.lit(-90)), b=g.exact_rotation(F.lit(45)), c=g.rounded_rotation(F.lit(89.6)), d=g.rounded_rotation(F.lit(-0.5)), e=g.exact_rotation(F.lit(720)))
    assert (r.a, r.b, r.c, r.d, r.e) == (270, None, 90, 0, 0)


def test_text_boxes(spark):
    rows = [
        ([24.0, 0.0, 0.0, 24.0, 100.0, 700.0], 54.672), ([0.0, 24.0, -24.0, 0.0, 100.0, 700.0], 54.672), ([0.0, 0.0, 0.0, 24.0, 1.0, 1.0], 5.0),
        ([24.0, 0.0, 0.0, 0.0, 1.0, 1.0], 5.0), ([24.0, 0.0, 0.0, 24.0, 1.0], 5.0), (None, 5.0), ([float("nan"), 0.0, 0.0, 24.0, 1.0, 1.0], 5.0),
    ]
    got = g.with_text_box(spark.createDataFrame(rows, "transform array<double>, width double")).select("x0", "y0", "x1", "y1").collect()
    assert len(got) == 2
    assert sorted(tuple(round(v, 3) for v in r) for r in got) == [(76.0, 700.0, 107.2, 754.672), (100.0, 692.8, 154.672, 724.0)]


def test_device_box(spark):
    page = lit_box(0, 0, 100, 100)
    v = g.to_viewport(lit_box(10, 10, 30, 30), page, F.lit(0), F.lit(1.0), 2.0)
    r = spark.range(1).select(v.alias("v")).select(g.device_box(F.col("v.x"), F.col("v.y"), F.col("v.w"), F.col("v.h"), F.lit(200), F.lit(200)).alias("b")).first().b
    assert tuple(r) == (20, 140, 60, 180)
    assert one(spark, b=g.shrink(lit_box(0, 0, 4, 9), 2)).b is None


def test_overlaps_differ(spark):
    a, edge, apart = lit_box(0, 0, 10, 10), lit_box(10, 0, 20, 10), lit_box(11, 0, 20, 10)
    r = one(spark, t1=p.touches(a, edge), t2=p.touches(a, apart), o1=p.overlaps(a, edge), o2=p.overlaps(a, lit_box(9, 9, 20, 20)))
    assert (r.t1, r.t2, r.o1, r.o2) == (True, False, False, True)


def test_nan_never_passes(spark):
    bad = (F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    crop = lit_box(0, 0, 9, 9)
    r = one(spark, n=g.normalized(bad), c=g.valid_canonical(bad, crop), o=g.clip(bad, crop), u=g.valid_context(crop, F.lit(0), F.lit(float("nan"))), k=g.valid_context(crop, F.lit(0), F.lit(1.0)))
    assert (r.n, r.c, r.o, r.u, r.k) == (None, False, None, False, True)


def test_matrix_and_local_mark(spark):
    lits = lambda *v: tuple(F.lit(float(x)) for x in v)
    m = g.compose(lits(1, 0, 0, 1, 100, 100), lits(2, 0, 0, 2, 10, 10))
    r = one(spark, a=m[0], e=m[4], f=m[5], mark=g.local_mark(lits(2, 0, 0, 2, 0, 0), lit_box(40, 0, 60, 30)), skew=g.local_mark(lits(1, 0.5, 0, 1, 0, 0), lit_box(0, 0, 1, 1)), zero=g.local_mark(lits(0, 0, 0, 1, 0, 0), lit_box(0, 0, 1, 1)))
    assert (r.a, r.e, r.f) == (2, 110, 110)
    assert tuple(r.mark) == (20, 0, 30, 15) and r.skew is None and r.zero is None


def test_segment_distance_against_sampling(spark):
    rng = random.Random(3)
    rows = [tuple(float(rng.randint(0, 40)) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    box = (12.0, 9.0, 25.0, 21.0)
    got = df.select("*", p.segment_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by")], lit_box(*box)).alias("d")).collect()
    for r in got:
        ts = [k / 400 for k in range(401)]
        near = min(math.hypot(max(box[0] - x, x - box[2], 0), max(box[1] - y, y - box[3], 0)) for t in ts for x, y in [(r.ax + t * (r.bx - r.ax), r.ay + t * (r.by - r.ay))])
        assert r.d <= near + 1e-9 and near - r.d < 0.2


def test_along_edge_and_enters(spark):
    box = lit_box(40, 0, 60, 20)
    seg = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(spark, on=p.along_edge(*seg(10, 20, 100, 20), box), off=p.along_edge(*seg(10, 10, 100, 10), box), point=p.along_edge(*seg(10, 20, 40, 20), box), cross=p.enters(*seg(10, 10, 100, 10), box), graze=p.enters(*seg(10, 20, 100, 20), box))
    assert (r.on, r.off, r.point, r.cross, r.graze) == (True, False, False, True, False)


@pytest.mark.parametrize("value,text", [(612.0, "612"), (0.5, "0.5"), (-3.25, "-3.25")])
def test_number_text(spark, value, text):
    assert one(spark, t=g.number_text(F.lit(value))).t == text


def test_a_segment_under_several_marks_keeps_what_none_of_them_covers(spark):
    from inkfold.operators import lines

    def row(seg, end, x0, x1):
        return 1, seg, 0.0, 0.0, end, 0.0, 1.0, x0, -1.0, x1, 1.0

    rows = [row(1, 10.0, 4.0, 6.0), row(1, 10.0, 5.0, 7.0), row(1, 10.0, 1.0, 2.0), row(1, 10.0, 20.0, 30.0), row(2, 0.0, 4.0, 6.0), row(3, 5.0, -1.0, 9.0), row(4, 5.0, 6.0, 9.0)]
    df = spark.createDataFrame(rows, "path long, seg long, ax double, ay double, bx double, by double, line_width double, mx0 double, my0 double, mx1 double, my1 double")
    kept = [(r.seg, round(r.k0, 9), round(r.k1, 9), round(r.arc, 9)) for r in lines.kept_pieces(df).orderBy("seg", "k0").collect()]
    assert kept == [(1, 0.0, 0.1, 0.0), (1, 0.2, 0.4, 2.0), (1, 0.7, 1.0, 7.0), (4, 0.0, 1.0, 15.0)]
    cut = lines.removed_intervals(df.where("seg = 1")).where("t0 is not null").select("path", "t0", "t1")
    assert [(round(r.t0, 9), round(r.t1, 9), r.parts) for r in lines.union_intervals(cut, ["path"]).orderBy("t0").collect()] == [(0.1, 0.2, 1), (0.4, 0.7, 2)]
