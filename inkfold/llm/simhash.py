"""SimHash near-duplicate detection by tiled exact comparison.

Documents with equal fingerprints are one node. Nodes are cut into tiles by the population counts of their
fingerprints' upper halves and sorted within a tile by those of the lower ones, each tile a file in the shared
folder. A pair of tiles whose counts differ beyond the radius is skipped, as are the rows of a pair whose lower
counts do; every other pair is compared exactly with numpy exclusive-or and bit counts. Only the numbers of tiles
are dealt to tasks, which read the files, so what is shuffled does not grow with the pairs. Inside a task the
matches are reduced to a spanning forest before they leave it, so a large group never emits all its pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; rows with equal
ids or texts are each returned; a null id is returned and never names a component (a component of null
ids alone has a null component_id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import fresh_path, hash_bits, hash_hits, materialize, utf8
from inkfold.llm.components import components

TILE_ROWS = 16384


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words of a UTF-8 text, repeats included; of all its words if it
    has fewer; empty without words. A-Z count as small letters, words lie between ASCII white space."""
    words = text.lower().split()
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(b" ".join(words), seed)] if n else [], np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = end - length
    spans = zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, n - shingle + 1)


def vote(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes; zero without hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint of a UTF-8 text."""
    return vote(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[s:e], shingle, seed) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (i, j) over n nodes: larger roots hang on smaller ones, one edge a root."""
    label = np.arange(n)
    keep_i, keep_j = [i[:0]], [j[:0]]
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return np.concatenate(keep_i), np.concatenate(keep_j)
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        high, low = np.maximum(a, b), np.minimum(a, b)
        roots, first = np.unique(high, return_index=True)
        keep_i.append(i[first])
        keep_j.append(j[first])
        parent = np.arange(n)
        parent[roots] = low[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges of a spanning forest of (i, j) over n nodes."""
    _, once = np.unique(np.minimum(i, j) * n + np.maximum(i, j), return_index=True)
    a, b = forest(np.minimum(i, j)[once], np.maximum(i, j)[once], n)
    return once[np.searchsorted((np.minimum(i, j) * n + np.maximum(i, j))[once], a * n + b)]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the parts of the nodes i and j, each part named by its smallest label."""
    parent = np.arange(len(label))
    a, b = label[i], label[j]
    while (a != b).any():
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
    return parent[label]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (index in a, index in b) at most ``radius`` bits apart; the nodes
    are numbered through, those of b after those of a. Works in strips, so memory holds one strip."""
    na = len(a)
    got_i, got_j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, na, rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            got_i, got_j = np.concatenate([got_i, i + at]), np.concatenate([got_j, j + na])
            if len(got_i) > 4 * (na + len(b)):
                got_i, got_j = forest(got_i, got_j, na + len(b))
    return forest(got_i, got_j, na + len(b))


def _bands(counts: dict[int, tuple[int, int]], tile_rows: int, tile_weight: int) -> list[tuple[int, int, int]]:
    """(lowest, highest population count, parts) of the tiles' bands: neighbours join while they fit one tile, a
    larger one is dealt to parts. counts: rows and weight by population count, so at most 33 bands."""
    bands: list[list[int]] = []
    for p in sorted(counts):
        rows, weight = counts[p]
        if bands and bands[-1][2] + rows <= tile_rows and bands[-1][3] + weight <= tile_weight:
            bands[-1][1:] = [p, bands[-1][2] + rows, bands[-1][3] + weight]
        else:
            bands.append([p, p, rows, weight])
    return [(low, high, max(-(-rows // tile_rows), -(-weight // tile_weight), 1)) for low, high, rows, weight in bands]


@dataclass
class Tiles:
    """Stored tiles: the folder, a row (band, part, name) per tile, and the bands."""

    root: str
    names: DataFrame
    bands: list[tuple[int, int, int]]


def write_tiles(nodes: DataFrame, columns: tuple[str, ...], tile_rows: int, weight: str | None = None, tile_weight: int = 1 << 62) -> Tiles:
    """Store the long ``columns`` of ``nodes`` by tile, and its column ``sets`` (array of long) if there is one, of
    which the tiles hold at most about ``tile_weight`` values as counted by ``weight``. Rows that repeat the first
    column count once."""
    spark = nodes.sparkSession
    listed = [*columns, "sets"] if "sets" in nodes.columns else list(columns)
    counted = nodes.select(*listed, F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("__ones"))
    heavy = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.lit(0)
    bands = _bands({r["__ones"]: (r.rows, r.weight) for r in counted.groupBy("__ones").agg(F.count("*").alias("rows"), heavy.alias("weight")).collect()}, tile_rows, tile_weight)
    band, parts = F.lit(-1), F.lit(1)
    for k, (low, high, n) in enumerate(bands):
        inside = F.col("__ones").between(low, high)
        band, parts = F.when(inside, k).otherwise(band), F.when(inside, n).otherwise(parts)
    dealt = counted.select(*listed, band.alias("band"), F.pmod(F.xxhash64(columns[0], F.lit(7)), parts).cast("int").alias("part"))
    root = fresh_path(spark, "tiles")
    fs, folder = FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fs, folder = FileSystem.from_uri(root)
        held = {c: table[c].to_numpy() for c in columns}
        _, order = np.unique(held[columns[0]], return_index=True)
        low = np.bitwise_count(held["fp"][order].view(np.uint64) & np.uint64(0xFFFFFFFF))
        order = order[np.argsort(low, kind="stable")]
        held = {c: v[order] for c, v in held.items()}
        name = f"{table['band'][0].as_py()}-{table['part'][0].as_py()}-{TaskContext.get().taskAttemptId()}"
        if "sets" in listed:
            sets = table["sets"].combine_chunks()
            at, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            with fs.open_output_stream(f"{folder}/{name}.sets", compression=None) as out:
                for k in order.tolist():
                    out.write(values[at[k] : at[k + 1]].tobytes())
            held["at"] = np.concatenate([[0], np.cumsum(at[order + 1] - at[order])])
        buffer = io.BytesIO()
        np.savez(buffer, **held)
        with fs.open_output_stream(f"{folder}/{name}.npz") as out:
            out.write(buffer.getbuffer())
        return pa.table({"band": table["band"][:1], "part": table["part"][:1], "name": [name]})

    return Tiles(root, materialize(dealt.groupBy("band", "part").applyInArrow(run, "band int, part int, name string"), "tile-names"), bands)


class Tile:
    """One stored tile: its columns as arrays, its sets read by byte ranges."""

    def __init__(self, root: str, name: str):
        self.fs, folder = FileSystem.from_uri(root)
        self.name, self.path = name, f"{folder}/{name}"
        with self.fs.open_input_file(f"{self.path}.npz") as f:
            held = np.load(io.BytesIO(f.read()))
        self.columns = {c: held[c] for c in held.files}
        self.low = np.bitwise_count(self["fp"].view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def sets(self, rows: np.ndarray, gap: int = 1 << 15) -> list[np.ndarray]:
        """The sets of ascending rows; ranges less than ``gap`` values apart are read together."""
        start, stop = self["at"][rows], self["at"][rows + 1]
        out: list[np.ndarray] = []
        with self.fs.open_input_file(f"{self.path}.sets") as f:
            for part in np.split(np.arange(len(rows)), np.flatnonzero(start[1:] - stop[:-1] > gap) + 1) if len(rows) else ():
                low, high = int(start[part[0]]), int(stop[part[-1]])
                f.seek(8 * low)
                data = np.frombuffer(f.read(8 * (high - low)), np.int64)
                out += [data[s:e] for s, e in zip((start[part] - low).tolist(), (stop[part] - low).tolist())]
        return out


def on_tile_pairs(tiles: Tiles, radius: int, work: Callable[[Tile, Tile], Iterator[tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """The rows that ``work`` yields for each pair of tiles (a tile with itself too) that may hold fingerprints at
    most ``radius`` bits apart. Tasks get the tiles' names and read the files."""
    spark = tiles.names.sparkSession
    reach = [(i, j) for i, x in enumerate(tiles.bands) for j, y in enumerate(tiles.bands) if i <= j and y[0] - x[1] <= radius]
    # a task per pair of tiles, as far as a few for each shuffle partition go: their work is not in their bytes
    count = sum(tiles.bands[i][2] * tiles.bands[j][2] for i, j in reach)
    tasks = max(1, min(count, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    steps = spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("band"), F.lit(j).alias("other")) for i, j in reach or [(-2, -2)]])))
    left = tiles.names.join(F.broadcast(steps), "band").select(F.col("band").alias("from_band"), F.col("part").alias("from_part"), F.col("other").alias("band"), F.col("name").alias("left"))
    pairs = left.join(tiles.names.withColumnRenamed("name", "right"), "band").where("from_band < band or part >= from_part").select("left", "right")
    root, names = tiles.root, [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a is None or a.name != left:
                    a = Tile(root, left)
                for found in work(a, a if left == right else Tile(root, right)):
                    if len(found[0]):
                        yield pa.record_batch([pa.array(x) for x in found], names)

    return pairs.repartition(tasks, F.xxhash64("left", "right")).sortWithinPartitions("left").mapInArrow(run, schema)


def strips(a: Tile, b: Tile, radius: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row in a, row in b, bits) of the pairs whose fp are at most ``radius`` bits apart, strip by strip of a; of a
    tile with itself each pair comes once. Rows are sorted by the population count of the lower half, so those
    that can be near a strip are one range of b."""
    x, y = a["fp"].view(np.uint64), b["fp"].view(np.uint64)
    # the least difference of the upper halves' counts over the two tiles
    p, q = (np.bitwise_count(v >> np.uint64(32)).astype(np.int64) for v in (x, y))
    left = radius - max(0, int(q.min() - p.max()), int(p.min() - q.max()))
    for at in range(0, len(x), rows):
        stop = min(at + rows, len(x))
        low, high = np.searchsorted(b.low, a.low[at] - left), np.searchsorted(b.low, a.low[stop - 1] + left, "right")
        if a is b:
            low = max(int(low), at)
        d = np.bitwise_count(x[at:stop, None] ^ y[None, low:high])
        i, j = np.nonzero(d <= radius)
        w = d[i, j].astype(np.int64)
        i, j = i + at, j + low
        if a is b:
            once = i < j
            i, j, w = i[once], j[once], w[once]
        yield i, j, w


def links(nodes: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at most ``radius`` bits apart. ``nodes``: distinct fp."""

    def work(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, ...]]:
        shift = 0 if a is b else len(a["fp"])
        n = shift + len(b["fp"])
        got_i, got_j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j, _ in strips(a, b, radius, 256):
            got_i, got_j = np.concatenate([got_i, i]), np.concatenate([got_j, j + shift])
            if len(got_i) > 4 * n:
                got_i, got_j = forest(got_i, got_j, n)
        i, j = forest(got_i, got_j, n)
        yield a["fp"][i], b["fp"][j - shift]

    return on_tile_pairs(write_tiles(nodes, ("fp",), tile_rows), radius, work, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id long, text string)."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(nodes.select("fp"), radius, tile_rows))
    # a node outside every edge is its own component
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = materialize(named, "named")
    least = named.where("root <> fp").select("root", "least").groupBy("root").agg(F.min("least").alias("other"))
    linked = named.join(least, "root", "left").join(named.select(F.col("fp").alias("root"), F.col("least").alias("own")), "root")
    ids = linked.select("fp", F.least("own", F.coalesce("other", "own")).alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Copies by similarity. A similarity of 0.8 over shingles lies about ten bits apart, too far for 64 bits to
# decide, so two independent fingerprints are compared, of the distinct shingles, as similarity is of sets. A
# first pass over all tiles names the nodes that are close to any other. Only those nodes' sets are stored, in
# tiles again, and a second pass over them verifies close pairs by their sets where it finds them: only verified
# links, reduced to a spanning forest, leave a task, and no close pair is left unverified unless verified links
# already join it. Sets too small for the radii are joined exactly on their least hashes.

#: The expected share of differing bits at a similarity of 0.8 is 0.152; these lie 3.6 deviations above it.
FIRST_RADIUS, BOTH_RADIUS = 20, 34
WIDE_TILE_ROWS = 32768
#: Hashes that a tile of sets holds, unless a single set has more.
TILE_HASHES = 1 << 22
#: Sets up to this size are compared with all others by exact links only: votes of a few shingles spread wider.
FEW = 20
FEW_TILE_ROWS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def remix(hashes: np.ndarray) -> np.ndarray:
    """A second, independent 64-bit hash of each hash."""
    h = hashes * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def double_fingerprints(docs: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """(doc_id, text_key, key, n, few, fp, fp2) per row; key is the 128-bit hash of the set of shingle hashes, n its
    size, few its sorted hashes if those of a set of ``FEW`` can be alike to it, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            raw = data.tobytes()
            found = np.zeros((2, len(at) - 1), np.uint64)
            keys: list[bytes] = []
            sizes: list[int] = []
            few: list[np.ndarray | None] = []
            for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                hashes = np.unique(shingle_hashes(raw[s:e], shingle, seed))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                few.append(hashes.view(np.int64) if len(hashes) * similarity <= FEW + 1e-6 else None)
                found[:, k] = vote(hashes), vote(remix(hashes))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(few, pa.list_(pa.int64())), *(pa.array(f.view(np.int64)) for f in found)],
                ["doc_id", "text_key", "key", "n", "few", "fp", "fp2"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, key binary, n long, few array<long>, fp long, fp2 long")


def close_strips(a: Tile, b: Tile, first: int, both: int, similarity: float, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row in a, row in b) of the pairs within both radii, strip by strip of a. Sets whose sizes alone rule the
    similarity out are no pairs."""
    p, q = a["fp2"].view(np.uint64), b["fp2"].view(np.uint64)
    for i, j, w in strips(a, b, first, rows):
        near = w + np.bitwise_count(p[i] ^ q[j]) <= both
        i, j = i[near], j[near]
        m, n = a["n"][i], b["n"][j]
        near = np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6
        yield i[near], j[near]


def close_nodes(nodes: DataFrame, first: int, both: int, similarity: float, tile_rows: int) -> DataFrame:
    """The distinct ids of nodes that are close to another. nodes: id, n, fp, fp2."""

    def work(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, ...]]:
        near = [np.zeros(len(a["id"]), bool), np.zeros(len(b["id"]), bool)]
        for i, j in close_strips(a, b, first, both, similarity):
            near[0][i], near[1][j] = True, True
        yield (np.unique(np.concatenate([a["id"][near[0]], b["id"][near[1]]])),)

    return on_tile_pairs(write_tiles(nodes, ("id", "n", "fp", "fp2"), tile_rows), first, work, "id long").distinct()


class Sets:
    """Sets of hashes by number, renumbered densely, for many comparisons of one with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        kinds, self.values = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(kinds), bool)

    def alike(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Mask of the pairs (i, j), sorted by i, of a Jaccard similarity of at least ``similarity``. No set is empty."""
        out = np.zeros(len(i), bool)
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(i)]):
            k, others = i[s], j[s:e]
            mine = self.values[self.at[k] : self.at[k + 1]]
            self.flag[mine] = True
            if 4 * self.size[others].sum() > len(self.values):
                common = np.add.reduceat(self.flag[self.values], self.at[:-1], dtype=np.int64)[others]
            else:
                ends = np.cumsum(self.size[others])
                spots = np.arange(ends[-1]) + np.repeat(self.at[others] - (ends - self.size[others]), self.size[others])
                common = np.add.reduceat(self.flag[self.values[spots]], ends - self.size[others], dtype=np.int64)
            self.flag[mine] = False
            out[s:e] = common >= similarity * (self.size[k] + self.size[others] - common)
        return out


def similar_links(nodes: DataFrame, first: int, both: int, similarity: float, tile_rows: int) -> DataFrame:
    """Edges (a, b) that connect all close nodes at least ``similarity`` alike. nodes: id, n, fp, fp2, sets."""

    def work(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, ...]]:
        shift = 0 if a is b else len(a["id"])
        label = np.arange(shift + len(b["id"]))
        number = np.full(len(label), -1)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> Iterator[tuple[np.ndarray, ...]]:
            """Verify what is pending: first a forest of it, then every pair that verified links do not join."""
            nonlocal label
            i, j = (np.concatenate(x) for x in zip(*pending))
            pending.clear()
            # the sets of the rows that this strip needs
            left, right = np.unique(i), np.unique(j)
            held = Sets([*a.sets(left), *b.sets(right - shift)])
            number[left] = np.arange(len(left))
            place = np.full(len(label), -1)
            place[right] = len(left) + np.arange(len(right))
            for some in (True, False):
                open_ = np.flatnonzero(label[i] != label[j])
                if not len(open_):
                    return
                if some:
                    open_ = open_[spanning(label[i[open_]], label[j[open_]], len(label))]
                open_ = open_[np.argsort(i[open_], kind="stable")]
                good = open_[held.alike(number[i[open_]], place[j[open_]], similarity)]
                kept = good[spanning(label[i[good]], label[j[good]], len(label))]
                label = merged(label, i[kept], j[kept])
                yield a["id"][i[kept]], b["id"][j[kept] - shift]

        for i, j in close_strips(a, b, first, both, similarity):
            j = j + shift
            open_ = label[i] != label[j]
            if open_.any():
                pending.append((i[open_], j[open_]))
                if sum(len(x) for x, _ in pending) > 1 << 16:
                    yield from settle()
        if pending:
            yield from settle()

    return on_tile_pairs(write_tiles(nodes, ("id", "n", "fp", "fp2"), tile_rows, "n", TILE_HASHES), first, work, "a long, b long")


def alike_pairs(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (index in a, index in b) of sets at least ``similarity`` alike."""
    shift = 0 if a is b else len(a)
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    held = np.concatenate(b)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(b)), size_b)[order]
    got_i, got_j = [], []
    for i, x in enumerate(a):
        at = zip(np.searchsorted(held, x), np.searchsorted(held, x, "right"))
        common = np.bincount(np.concatenate([owner[s:e] for s, e in at]), minlength=len(b))
        j = np.flatnonzero(common >= similarity * (size_a[i] + size_b - common))
        got_i.append(np.full(len(j), i))
        got_j.append(j + shift)
    i, j = forest(np.concatenate(got_i), np.concatenate(got_j), shift + len(b))
    return i, j - shift


def few_links(nodes: DataFrame, similarity: float, tile_rows: int = FEW_TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect all sets of few shingles at least ``similarity`` alike. nodes: id, n, few, with
    few not empty. Of two such sets of n and m hashes one of the least n - ceil(similarity * n) + 1 is common."""
    least = F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1
    # a hash of one set alone links nothing
    held = materialize(nodes.select("id", "few", F.explode(F.slice("few", F.lit(1), least.cast("int"))).alias("hash")), "few-hashes")
    counts = held.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / tile_rows)
    tiles = materialize(
        held.join(counts, "hash").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        .groupBy("hash", "part").agg(F.collect_list(F.struct("id", "few")).alias("rows")),
        "few-tiles",
    )
    left = tiles.select("hash", F.col("part").alias("from_part"), F.col("rows").alias("left"))
    pairs = left.join(tiles.withColumnRenamed("rows", "right"), "hash").where("part >= from_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k].values, batch.column(1)[k].values
                ids, sets = [], []
                for rows in (left,) if batch.column(2)[k].as_py() else (left, right):
                    ids.append(rows.field("id").to_numpy())
                    sets.append([x.values.to_numpy() for x in rows.field("few")])
                i, j = alike_pairs(sets[0], sets[-1], similarity)
                if len(i):
                    yield pa.record_batch([pa.array(ids[0][i]), pa.array(ids[-1][j])], ["a", "b"])

    pairs = pairs.select("left", "right", (F.col("part") == F.col("from_part")).alias("same"), "hash", "part", "from_part")
    return pairs.repartition("hash", "part", "from_part").select("left", "right", "same").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(id, n, fp, fp2, sets): ``wanted`` (id, n, fp, fp2, doc_id, text_key) with the sorted shingle hashes of its
    texts. Texts that are surely not wanted are left out before the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, ends = utf8(part.column(4))
                raw = data.tobytes()
                sets = [np.unique(shingle_hashes(raw[s:e], shingle, seed)).view(np.int64) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.record_batch([*part.columns[:4], pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "fp", "fp2", "sets"])

    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), "text")
    keyed, _ = hash_hits(keyed, hash_bits(wanted, F.col("doc_id"), F.col("text_key")), F.col("doc"), F.col("key"))
    texts = wanted.join(keyed, (F.col("doc_id") == F.col("doc")) & (F.col("text_key") == F.col("key"))).select("id", "n", "fp", "fp2", "text")
    return texts.mapInArrow(run, "id long, n long, fp long, fp2 long, sets array<long>")


def drop_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, tile_rows: int = WIDE_TILE_ROWS) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id: groups are the
    components of pairs at least ``similarity`` alike. Rows that repeat both doc_id and text all stay or go, texts
    that share a doc_id are judged apart; rows without an id stay; texts without words are copies of one another."""
    marked = materialize(double_fingerprints(docs.where("doc_id is not null"), shingle, seed, similarity), "double-fingerprints")
    # a node per set, numbered where it is written
    best = F.min(F.struct("doc_id", "text_key")).alias("best")
    nodes = marked.groupBy("key").agg(best, *(F.first(c).alias(c) for c in ("n", "few", "fp", "fp2")))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "key", "best.*", "n", "few", "fp", "fp2"), "nodes")
    few = few_links(nodes.where("n > 0 and few is not null"), similarity)
    wide = nodes.where(F.col("n") > FEW).select("id", "n", "fp", "fp2", "doc_id", "text_key")
    close = materialize(close_nodes(wide, FIRST_RADIUS, BOTH_RADIUS, similarity, tile_rows), "close")
    wide = materialize(wide.join(close, "id", "left_semi"), "wide")
    edges = similar_links(shingle_sets(docs, wide, shingle, seed), FIRST_RADIUS, BOTH_RADIUS, similarity, tile_rows)
    joined = components(edges.union(few))
    # the smallest document of a group of several nodes, then of a node
    named = materialize(nodes.select("id", "key", F.col("doc_id").alias("least")).join(joined, nodes.id == joined.node, "left").select("key", "least", F.coalesce("component", "id").alias("root")), "named")
    group = named.groupBy("root").agg(F.min("least").alias("kept"))
    keeps = named.join(group, "root").select("key", "kept")
    gone = marked.join(keeps, "key").where("doc_id <> kept").select("doc_id", "text_key").distinct()
    gone = materialize(gone.toDF("gone_id", "gone_key"), "copies")
    # most rows are seen to stay without a shuffle of their texts
    key = (F.col("doc_id"), F.xxhash64("text"))
    maybe, stay = hash_hits(docs, hash_bits(gone, F.col("gone_id"), F.col("gone_key")), *key)
    maybe = maybe.join(gone, (maybe.doc_id == gone.gone_id) & (F.xxhash64(maybe.text) == gone.gone_key), "left_anti")
    return stay.union(maybe.select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``docs`` without the rows that are linked to a row of smaller doc_id; of rows that repeat a doc_id
    all stay or go, and rows without an id stay. Only the ids that go take part in the join."""
    found = near_duplicates(docs, radius, shingle, seed, tile_rows)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
