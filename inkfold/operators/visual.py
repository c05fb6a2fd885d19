"""Raster evidence. Rasters here are rows of pixels keyed by page; whole-page rasters stay binary and are
compared by ``raster_differences``, which never explodes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.geometry import Box
from inkfold.functions.predicates import inside, within

UNAVAILABLE = "verify.visual.render-unavailable"
FILL_UNIFORMITY, FILL_BLACK, RETAINED, OUTSIDE = 4, 8, 4, 2


def _in(box: tuple[int, int, int, int]):
    edge: Box = tuple(F.lit(v) for v in box)  # type: ignore[assignment]
    return inside(F.col("x"), F.col("y"), edge)


def fill_verdicts(pixels: DataFrame, inner: tuple[int, int, int, int], whole: int | None = None) -> DataFrame:
    """Per raster r: the candidate's fill within ``inner`` is uniform, then near black; then nothing of
    the source shows through. A raster with other than ``whole`` pixels has no verdict but indeterminate."""
    kept = within(F.col("cand"), F.col("src"), RETAINED) & (F.col("src") > FILL_BLACK)
    found = pixels.groupBy("r").agg(
        F.count("*").alias("pixels"), F.count_if(_in(inner)).alias("n"), F.min(F.when(_in(inner), F.col("cand"))).alias("low"), F.max(F.when(_in(inner), F.col("cand"))).alias("high"), F.bool_or(_in(inner) & kept).alias("retained"),
    )
    reason = (
        F.when(F.col("pixels") != whole if whole else F.lit(False), UNAVAILABLE).when(F.col("n") == 0, "verify.visual.inner-region-empty").when(F.col("high") - F.col("low") > FILL_UNIFORMITY, "verify.visual.non-uniform-fill")
        .when((F.col("low") + F.col("high")) / 2 > FILL_BLACK, "verify.visual.unexpected-fill").when(F.col("retained"), "verify.visual.retained-pixels").otherwise("verify.visual.fill-ok")
    )
    out = found.withColumn("reason_code", reason)
    outcome = F.when(F.col("reason_code") == "verify.visual.fill-ok", "pass").when(F.col("reason_code").isin(UNAVAILABLE, "verify.visual.inner-region-empty"), "indeterminate").otherwise("fail")
    return out.select("r", outcome.alias("outcome"), "reason_code")


def outside_damage(pixels: DataFrame, zone: tuple[int, int, int, int], whole: int | None = None) -> DataFrame:
    """r, damaged: a pixel outside the exclusion zone differs beyond the tolerance; null for a raster with other than
    ``whole`` pixels."""
    damaged = F.bool_or(~_in(zone) & ~within(F.col("cand"), F.col("src"), OUTSIDE))
    return pixels.groupBy("r").agg((F.when(F.count("*") == whole, damaged) if whole else damaged).alias("damaged"))


def raster_differences(pages: DataFrame, tolerance: int = OUTSIDE) -> DataFrame:
    """r, differing: count of pixels apart by more than ``tolerance``. pages: r, src, cand binary, equal sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for a, b in zip(batch.column(1), batch.column(2)):
                x, y = (np.frombuffer(v.as_py(), np.uint8).astype(np.int16) for v in (a, b))
                counts.append(int((np.abs(x - y) > tolerance).sum()))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["r", "differing"])

    return pages.select("r", "src", "cand").mapInArrow(run, "r long, differing long")
