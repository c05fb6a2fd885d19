"""Line art against marks, natively for straight segments: what is removed, what stays, where dashes resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions import predicates as p
from inkfold.functions.geometry import Box
from inkfold.sources.tables import settled


def _ends() -> tuple[Column, Column, Column, Column]:
    return F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")


def _mark() -> Box:
    return F.col("mx0"), F.col("my0"), F.col("mx1"), F.col("my1")


def length() -> Column:
    ax, ay, bx, by = _ends()
    return F.hypot(bx - ax, by - ay)


def _entered(segments: DataFrame) -> DataFrame:
    """segments with ``slab``, computed once: repeated inline, it outgrows what the JVM compiles."""
    return settled(segments, "slab", p.segment_slab(*_ends(), _mark()))


def touched(segments: DataFrame) -> DataFrame:
    """segments with distance to the mark, stroke_touched (half the width away) and fill_touched."""
    out, names = _entered(segments), [f"corner{k}" for k in range(4)]
    for name, distance in zip(names, p.corner_distances(*_ends(), _mark())):
        out = settled(out, name, distance)
    out = settled(out, "distance", p.segment_distance(*_ends(), _mark(), F.col("slab"), [F.col(c) for c in names])).drop("slab", *names)
    return out.withColumns({"stroke_touched": F.col("distance") <= F.col("line_width") / 2 + 1e-9, "fill_touched": F.col("distance") <= F.col("line_width") / 2 + 0.75})


def inner_intervals(segments: DataFrame) -> DataFrame:
    """segments with the parameter interval t0, t1 in the closed mark; null if none."""
    inner = F.when(p.meets(F.col("slab")), F.col("slab"))
    return settled(_entered(segments), "inner", inner).select(*segments.columns, "inner.t0", "inner.t1")


def removed_intervals(segments: DataFrame) -> DataFrame:
    """segments with the parameter interval t0, t1 inside the mark; a segment along an edge keeps everything."""
    out = settled(inner_intervals(segments), "along", p.along_edge(*_ends(), _mark()))
    return out.withColumns({c: F.when(~F.col("along"), F.col(c)) for c in ("t0", "t1")}).drop("along")


def union_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t0, t1, parts: (t0, t1) merged per key where they meet within 1e-12, with the number merged. An island opens
    where a start lies beyond the largest end before it."""
    order = Window.partitionBy(*keys).orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("opens", F.when(reach.isNull() | (F.col("t0") > reach + 1e-12), 1).otherwise(0))
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opened.withColumn("island", island).groupBy(*keys, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("parts")).drop("island")


def gaps(removed: Column) -> Column:
    """Array of (k0, k1), what stays of [0, 1] without the removed (t0, t1), which are sorted and may overlap."""
    none = F.array().cast("array<struct<k0:double,k1:double>>")

    def step(done: Column, gone: Column) -> Column:
        gap = F.array(F.struct(done["reach"].alias("k0"), F.least(gone["t0"], F.lit(1.0)).alias("k1")))
        kept = F.when(gone["t0"] > done["reach"] + 1e-12, F.concat(done["kept"], gap)).otherwise(done["kept"])
        return F.struct(F.greatest(done["reach"], gone["t1"]).alias("reach"), kept.alias("kept"))

    def tail(done: Column) -> Column:
        return F.concat(done["kept"], F.array(F.struct(done["reach"].alias("k0"), F.lit(1.0).alias("k1"))))

    walked = F.aggregate(removed, F.struct(F.lit(0.0).alias("reach"), none.alias("kept")), step, tail)
    return F.filter(walked, lambda piece: piece["k1"] > piece["k0"] + 1e-12)


def kept_pieces(segments: DataFrame) -> DataFrame:
    """path, seg, ax, ay, bx, by, len, before (length of the path up to the segment), k0, k1, arc (length up to the piece)
    of what stays of each segment, which has a row for each of its marks. Everything is keyed by path, so segments that
    come dealt by path are not shuffled again; a list holds the marks of one segment."""
    cut = removed_intervals(segments)
    gone = F.collect_list(F.when(F.col("t0").isNotNull(), F.struct("t0", "t1")))
    one = cut.groupBy("path", "seg").agg(*[F.first(c).alias(c) for c in ("ax", "ay", "bx", "by")], F.sort_array(gone).alias("gone"))
    before = F.sum("len").over(Window.partitionBy("path").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    walked = one.withColumn("len", length()).withColumn("before", F.coalesce(before, F.lit(0.0))).where("len > 0")
    pieces = walked.select("path", "seg", "ax", "ay", "bx", "by", "len", "before", F.inline(gaps(F.col("gone"))))
    return pieces.where("(k1 - k0) * len >= 1e-12").withColumn("arc", F.col("before") + F.col("k0") * F.col("len"))


def stitched_runs(pieces: DataFrame) -> DataFrame:
    """path, run, sx, sy, ex, ey, pieces, arc: neighbouring pieces whose ends are equal form one run."""
    at = lambda t, a, b: F.when(F.col(t) == 0, F.col(a)).when(F.col(t) == 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col(t))
    ends = pieces.select("path", "seg", "k0", "arc", at("k0", "ax", "bx").alias("sx"), at("k0", "ay", "by").alias("sy"), at("k1", "ax", "bx").alias("ex"), at("k1", "ay", "by").alias("ey"))
    order = Window.partitionBy("path").orderBy("seg", "k0")
    opens = F.when((F.lag("ex").over(order) == F.col("sx")) & (F.lag("ey").over(order) == F.col("sy")), 0).otherwise(1)
    runs = ends.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at_start, at_end = F.struct("seg", "k0"), F.struct("seg", "k0")
    return runs.groupBy("path", "run").agg(
        F.min_by("sx", at_start).alias("sx"), F.min_by("sy", at_start).alias("sy"), F.max_by("ex", at_end).alias("ex"), F.max_by("ey", at_end).alias("ey"), F.count("*").alias("pieces"), F.min_by("arc", at_start).alias("arc"),
    )


def dash_period(array: Column) -> Column:
    """Sum of the dash array, doubled for an odd number of elements; zero for none."""
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(array) % 2 == 1, 2 * total).otherwise(total)


def dash_phase(array: Column, phase: Column, arc: Column) -> Column:
    period = dash_period(array)
    return F.when(period > 0, F.pmod(phase + arc, period)).otherwise(0.0)


def path_decisions(segments: DataFrame) -> DataFrame:
    """path, kind, decision. kind: stroke, fill or fillstroke by path. A fill is touched by its boundary
    or where it covers the mark's centre or a corner (crossings to the right, even-odd over the closed path)."""
    flags = touched(segments)
    edge_points = [((F.col("mx0") + F.col("mx1")) / 2, (F.col("my0") + F.col("my1")) / 2)] + [(F.col(x), F.col(y)) for x in ("mx0", "mx1") for y in ("my0", "my1")]
    order = Window.partitionBy("path").orderBy("seg")
    first = Window.partitionBy("path").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # fills run from each segment's start to the next one's, and back to the first
    poly = flags.withColumns({"nx": F.coalesce(F.lead("ax").over(order), F.first("ax").over(first)), "ny": F.coalesce(F.lead("ay").over(order), F.first("ay").over(first))})
    crossed = []
    for k, (px, py) in enumerate(edge_points):
        spans = (F.col("ay") > py) != (F.col("ny") > py)
        at = F.col("ax") + F.try_divide((py - F.col("ay")) * (F.col("nx") - F.col("ax")), F.col("ny") - F.col("ay"))
        crossed.append((F.count_if(spans & (at > px)) % 2 == 1).alias(f"in{k}"))
    by_path = poly.groupBy("path").agg(F.bool_or("stroke_touched").alias("stroke"), F.bool_or("fill_touched").alias("edge"), *crossed)
    fill = F.col("edge") | F.col("in0") | F.col("in1") | F.col("in2") | F.col("in3") | F.col("in4")
    kind = F.element_at(F.array(F.lit("stroke"), F.lit("fill"), F.lit("fillstroke")), (F.col("path") % 3 + 1).cast("int"))
    out = by_path.withColumn("kind", kind).withColumn("fill", fill)
    decision = (
        F.when((F.col("kind") == "stroke") & F.col("stroke"), "rewrite").when((F.col("kind") == "fill") & F.col("fill"), "remove")
        .when((F.col("kind") == "fillstroke") & (F.col("stroke") | F.col("fill")), "remove").otherwise("verbatim")
    )
    return out.select("path", "kind", decision.alias("decision"))
