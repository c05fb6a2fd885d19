"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are contracted step by step; once at most ``in_one`` of them are left, a single task finishes them, in memory
set by that number, which spares a small graph the many short steps. The result is the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges are (u, v) with u > v; each step hangs neighbours on the smallest one."""
    if large:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def _in_one(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v) of longs, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if not parts:
            return
        nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while (label[u] != label[v]).any():
            a, b = label[u], label[v]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
        moved = label < np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, max_rounds: int = 60, in_one: int = 1 << 21) -> DataFrame:
    """edges: (a, b) of longs. Returns (node, component) for every node of an edge whose
    component is another, smaller node; component is the smallest node reachable. Self-loops and nulls
    are ignored. The graph stays distributed: each round aggregates per node and joins back, so a node
    with very many neighbours is split by the skewed-join rule and never gathered; only what is left of at most
    ``in_one`` edges is finished by one task."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if sign[0] <= in_one:
            return materialize(_in_one(now), "components")
        before = sign
        now = materialize(_stars(_stars(now, True), False), "stars")
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
