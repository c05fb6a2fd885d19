"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node that names its smallest ids, as many as an answer can hold; so no id that an
answer needs is lost and a large group of copies cannot isolate its graph. Nodes are dealt to shards of
about ``shard_rows``; each shard's graph is stored in shared storage as flat arrays: vectors, ids, and for
each level the neighbour numbers of its nodes. Queries are dealt in blocks; every block descends every
shard's graph, all queries of a block stepping together, and the shards' results merge by distance.

Candidates come from single precision; the returned distances are computed again in double precision on
the original vectors. Vectors of different length live in different shards and never meet.
Defined results: vectors that are null, empty, zero or hold a null, NaN or infinity take no part, nor do
null ids; equal distances go to the smaller id; with fewer candidates than k all of them are returned;
an empty table gives an empty result; rows that repeat an id and vector are one; other columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import fresh_path, materialize


@dataclass
class Graph:
    """vectors; levels from the base up: (node numbers, flat neighbours as positions in the level, -1 for none)."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _nearest(x: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of each row's k nearest others, nearest first."""
    n = len(x)
    k = min(k, n - 1)
    norm = (x * x).sum(1)
    near, far = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for s in range(0, n, rows):
        part = x[s : s + rows]
        d = norm[s : s + rows, None] + norm[None, :] - 2 * (part @ x.T)
        d[np.arange(len(part)), np.arange(s, s + len(part))] = np.inf
        got = np.argpartition(d, k - 1, axis=1)[:, :k]
        at = np.take_along_axis(d, got, 1)
        order = np.argsort(at, axis=1, kind="stable")
        near[s : s + rows], far[s : s + rows] = np.take_along_axis(got, order, 1), np.take_along_axis(at, order, 1)
    return near, np.maximum(far, 0)


def _diverse(x: np.ndarray, near: np.ndarray, far: np.ndarray, m: int, rows: int = 512) -> np.ndarray:
    """Mask of the neighbours kept: one is dropped if a nearer kept neighbour is closer to it than the node is."""
    n, k = near.shape
    keep = np.zeros((n, k), bool)
    for s in range(0, n, rows):
        y = x[near[s : s + rows]]
        norm = (y * y).sum(2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.einsum("nid,njd->nij", y, y, optimize=True)
        mine = keep[s : s + rows]
        for j in range(k):
            hidden = (mine[:, :j] & (between[:, j, :j] < far[s : s + rows, j, None])).any(1)
            mine[:, j] = ~hidden & (mine.sum(1) < m)
    return keep


def _links(x: np.ndarray, m: int, degree: int) -> np.ndarray:
    """Flat neighbours (n, degree + 2): diverse near ones in both directions, and the two nodes beside it
    in number, which keep the level connected."""
    n = len(x)
    out = np.full((n, degree + 2), -1, np.int32)
    if n > 1:
        near, far = _nearest(x, 2 * m)
        i, j = np.nonzero(_diverse(x, near, far, m))
        a, b, d = i.astype(np.int64), near[i, j].astype(np.int64), far[i, j]
        a, b, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        _, once = np.unique(a * n + b, return_index=True)
        a, b, d = a[once], b[once], d[once]
        order = np.lexsort([b, d, a])
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        kept = rank < degree
        out[a[kept], rank[kept]] = b[kept]
        for column, step in ((degree, 1), (degree + 1, -1)):
            beside = np.arange(n) + step
            known = (out[:, :degree] == beside[:, None]).any(1)
            # a neighbour listed twice would take two places in a beam
            out[:, column] = np.where(known | (beside < 0) | (beside >= n), -1, beside)
    return out


def build(vectors: np.ndarray, m: int = 16, seed: int = 7) -> Graph:
    """Graph over float32 rows. Each node reaches level l with chance m**-l."""
    graph = Graph(vectors)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / math.log(m)).astype(int)
    for level in range(int(height.max(initial=0)) + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        graph.levels.append((nodes, _links(vectors[nodes], m, 2 * m)))
    return graph


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest found from ``start``, and squared distances: each query expands its nearest
    unexpanded candidate until the beam holds none."""
    q, n = len(queries), len(x)
    width = min(width, n)
    ids = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf, np.float32)
    done = np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    ids[:, 0], dist[:, 0], done[:, 0] = start, ((x[start] - queries) ** 2).sum(1), False
    seen[rows, start] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = open_.argmin(1)
        has = np.isfinite(open_[np.arange(len(live)), pick])
        live, pick = live[has], pick[has]
        if not len(live):
            break
        done[live, pick] = True
        around = links[ids[live, pick]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        seen[live[:, None], np.where(around >= 0, around, ids[live, pick][:, None])] = True
        d = np.where(fresh, ((x[around] - queries[live, None, :]) ** 2).sum(2), np.inf)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1)
        all_f = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[live], ids[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_d, all_i, all_f))
    return ids, dist


def search(graph: Graph, queries: np.ndarray, k: int, width: int, rows: int = 256) -> np.ndarray:
    """Node numbers of each query's k nearest found (-1 for none), nearest first."""
    out = np.full((len(queries), k), -1, np.int64)
    for s in range(0, len(queries), rows):
        part = queries[s : s + rows]
        at = np.zeros(len(part), np.int64)
        for level in range(len(graph.levels) - 1, -1, -1):
            nodes, links = graph.levels[level]
            if level < len(graph.levels) - 1:
                at = np.searchsorted(nodes, graph.levels[level + 1][0][at])
            ids, dist = _beam(graph.vectors[nodes], links, part, at, 1 if level else max(width, k))
            if level:
                at = ids[:, 0]
            else:
                order = np.argsort(dist, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(ids, order, 1)
                out[s : s + rows, : got.shape[1]] = np.where(np.isfinite(np.take_along_axis(dist, order, 1)), got, -1)
    return out


def usable(vector: str) -> Column:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _save(fs: FileSystem, path: str, graph: Graph, ids: list[list[int]]) -> None:
    flat = {f"{kind}{i}": a for i, level in enumerate(graph.levels) for kind, a in zip(("nodes", "links"), level)}
    buffer = io.BytesIO()
    counts = np.array([len(x) for x in ids], np.int64)
    np.savez(buffer, vectors=graph.vectors, ids=np.array([i for x in ids for i in x], np.int64), counts=counts, **flat)
    with fs.open_output_stream(path) as out:
        out.write(buffer.getbuffer())


def _load(fs: FileSystem, path: str) -> tuple[Graph, list[list[int]]]:
    with fs.open_input_file(path) as f:
        z = np.load(io.BytesIO(f.read()))
    levels = [(z[f"nodes{i}"], z[f"links{i}"]) for i in range(sum(k.startswith("nodes") for k in z.files))]
    ends = np.cumsum(z["counts"])
    ids = z["ids"].tolist()
    return Graph(z["vectors"], levels), [ids[e - n : e] for n, e in zip(z["counts"].tolist(), ends.tolist())]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def build_index(vectors: DataFrame, keep_ids: int, shard_rows: int, m: int) -> tuple[str, DataFrame]:
    """Write a graph per shard; returns the folder and (dim, shard, path) rows. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    # a window with a small rank limit prunes each copy group before it is dealt
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = vectors.distinct().withColumn("rank", rank).where(F.col("rank") <= keep_ids)
    nodes = nodes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding"))
    nodes = materialize(nodes, "nodes")
    total = nodes.count()
    shards = max(1, -(-total // shard_rows))
    root = fresh_path(spark, "graphs")
    fs, folder = FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fs, folder = FileSystem.from_uri(root)
        ids = table["ids"].to_pylist()
        order = np.argsort([x[0] for x in ids], kind="stable")
        x = _matrix(table["embedding"].combine_chunks())[order]
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        name = f"{dim}-{shard}-{TaskContext.get().taskAttemptId()}.npz"
        # single precision finds candidates; double-precision inputs keep their values for the exact distances
        graph = build(x.astype(np.float32), m, seed=shard)
        graph.vectors = x
        _save(fs, f"{folder}/{name}", graph, [ids[i] for i in order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [name]})

    built = dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, path string")
    return root, materialize(built, "shards")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16384, m: int = 16, width: int = 256, block_rows: int = 512
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` (vec_id, embedding) of each row of
    ``queries`` (the same columns), itself left out; score is the Euclidean distance."""
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    root, shards = build_index(pick(vectors), k + 1, shard_rows, m)
    asked = pick(queries).distinct().withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # (shard, block) rows carry a path and a number; the block's vectors join by the number
    work = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = work.join(asked, ["dim", "block"]).select("dim", "shard", "block", "path", "vec_id", "embedding")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fs, folder = FileSystem.from_uri(root)
        graph, ids = _load(fs, f"{folder}/{table['path'][0].as_py()}")
        exact = graph.vectors.astype(np.float64)
        graph.vectors = graph.vectors.astype(np.float32)
        names = table["vec_id"].to_pylist()
        asked_for = _matrix(table["embedding"].combine_chunks())
        found = search(graph, asked_for.astype(np.float32), k + 1, width)
        rows = []
        for name, vector, near in zip(names, asked_for.astype(np.float64), found):
            near = near[near >= 0]
            gap = np.sqrt(((exact[near] - vector) ** 2).sum(1)).tolist()
            mine = sorted((d, i) for d, node in zip(gap, near.tolist()) for i in ids[node] if i != name)
            rows += [(name, i, d) for d, i in mine[:k]]
        columns = zip(*rows) if rows else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    # a task for each shard and block, as far as a few for each shuffle partition go: their work is not in their bytes
    n = max(1, min(shards.count() * blocks, 8 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = tasks.repartition(n, "dim", "shard", "block").groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
