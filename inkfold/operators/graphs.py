"""Bounded walks over object graphs: one join per level, so depth is a parameter and rows have no cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def walk(roots: DataFrame, edges: DataFrame, depth: int, carry: dict[str, Column]) -> DataFrame:
    """Nodes reachable in at most ``depth`` steps: doc_id, node, level, trail and the carried columns.
    edges: doc_id, parent, child and what ``carry`` needs; ``carry`` maps a root column to its value one
    step on (the edge's columns and the parent's are in scope). A node on its own trail is not entered."""
    level = roots.withColumns({"level": F.lit(0), "trail": F.array("node")})
    out = [level]
    for k in range(1, depth + 1):
        joined = level.join(edges, (level.doc_id == edges.doc_id) & (level.node == edges.parent)).where(~F.array_contains("trail", F.col("child")))
        level = joined.select(level.doc_id, F.col("child").alias("node"), *[c.alias(name) for name, c in carry.items()], F.lit(k).alias("level"), F.array_append("trail", F.col("child")).alias("trail"))
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def cyclic(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id of documents in which a walked node leads back onto its trail."""
    on = (walked.doc_id == edges.doc_id) & (walked.node == edges.parent) & F.array_contains("trail", F.col("child"))
    return walked.join(edges, on).select(walked.doc_id).distinct()
