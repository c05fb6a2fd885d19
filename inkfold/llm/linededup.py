"""Line dedup by distinct-site spread.

A line's key is a hash of the line without surrounding blanks. Each key has a HyperLogLog sketch of the
sites it occurs on; sketches merge by aggregation. Where the estimate is clear of the threshold it
decides; near the threshold the sites are counted exactly. Lines on at least ``min_sites`` sites are
boilerplate: all their occurrences go but the first (smallest doc_id, then position), so no content
vanishes from the corpus. Lines shorter than ``min_chars`` are never touched.

Defined results: a null text stays null; a null site counts as one site, the empty one; rows equal in
doc_id and text share their positions and so keep or lose the same lines; null ids order first; an
empty table gives an empty result; columns beyond doc_id, text and source pass through untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import hash_bits, hash_hits, materialize, unused

_KEY = "__text_key"
_CUT = "__cut"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text key, pos, site, h) of each line of at least ``min_chars`` characters."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias(_KEY), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(_lines("text")).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(" \t\r")))
        .where(F.length("line") >= min_chars)
        .select("doc_id", _KEY, "pos", "site", F.xxhash64("line").alias("h"))
    )


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """(h) of the lines on at least ``min_sites`` distinct sites."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = spread.select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    # four standard errors of the sketch, and one for its rounding
    slack = 4 * 1.04 / 2 ** (lg_k / 2) * min_sites + 1
    spread = materialize(spread.where(F.col("sites") >= min_sites - slack), "spread")
    clear = spread.where(F.col("sites") > min_sites + slack).select("h")
    near = spread.where(F.col("sites") <= min_sites + slack).select("h")
    exact = (
        lines.join(near, "h", "left_semi").select("h", "site").distinct()
        .groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    )
    return clear.union(exact)


def removals(docs: DataFrame, min_sites: int, min_chars: int, lg_k: int = 12) -> DataFrame:
    """(doc_id, text key, cut) of the documents that lose lines; cut lists the positions."""
    lines = materialize(line_table(docs, min_chars), "lines")
    # written tables have known sizes: a small one is broadcast at once and a line that very many
    # documents share is never dealt by its hash; a large one joins by shuffle, skewed keys split
    shared = materialize(lines.join(materialize(boilerplate(lines, min_sites, lg_k), "boilerplate"), "h").drop("site"), "shared")
    spot = F.struct("doc_id", _KEY, "pos")
    first = materialize(shared.groupBy("h").agg(F.min(spot).alias("first")), "first")
    later = shared.join(first, "h").where(~spot.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", _KEY).agg(F.collect_set("pos").alias(_CUT))


def dedup_lines(docs: DataFrame, min_sites: int = 4, min_chars: int = 20, lg_k: int = 12, counts: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with repeated boilerplate lines cut from ``text``; with
    ``counts`` also n_lines and n_removed, in place of columns of those names. Documents that surely lose no line
    are not shuffled."""
    id_, key, gone = (unused(x, docs.columns) for x in ("id", "key", "gone"))
    cut = materialize(removals(docs, min_sites, min_chars, lg_k).toDF(id_, key, gone), "cut")
    maybe, whole = hash_hits(docs, hash_bits(cut, F.col(id_), F.col(key)), F.col("doc_id"), F.xxhash64("text"))
    right = cut.hint("shuffle_hash")
    joined = maybe.join(right, maybe.doc_id.eqNullSafe(right[id_]) & (F.xxhash64(maybe.text) == right[key]), "left").drop(id_, key)
    joined = joined.union(whole.withColumn(gone, F.lit(None).cast("array<int>")))
    kept = F.array_join(F.filter(_lines("text"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    own = ("n_lines", "n_removed") if counts else ()
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in own]
    if counts:
        out += [F.coalesce(F.size(_lines("text")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


#: DuckDB: the rows of the op5 query.
SQL = """
WITH lines AS (
  SELECT doc_id, source, md5(text) AS k, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, k, pos, raw, coalesce(source, '') AS site, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines
), spread AS (
  SELECT line FROM keyed WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT site) >= 4
), ranked AS (
  SELECT doc_id, k, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS r FROM keyed WHERE line IN (SELECT line FROM spread)
), marked AS (
  SELECT q.doc_id, q.pos, q.raw, coalesce(r.r > 1, false) AS gone
  FROM keyed q LEFT JOIN ranked r ON q.doc_id = r.doc_id AND q.k = r.k AND q.pos = r.pos
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""
