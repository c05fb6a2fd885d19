"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks. Weights are rounded to
shares of a period of Q slots (largest remainder). Block i of a source with share a is released at slot
floor(iQ/a) and due at ceil((i+1)Q/a); every slot goes to the released block with the earliest deadline,
so at every slot each source is less than one block from its share. All windows repeat each period, so
one period (Q rows, set by parameters and not by the corpus) is scheduled and every block finds its slot
by arithmetic and a join with that table: no pass over the corpus is sequential. Against the target weights
themselves the rounding drifts with the length of the mix.

With ``exact`` the windows are those of the weights as fractions, floor(iW/w) and ceil((i+1)W/w), for every
slot before the horizon: each source is then less than one block from its target weight throughout. Those
slots, one for each whole block of the corpus at most, are scheduled one by one on the driver and written
segment by segment, so only a segment is held. Blocks beyond the horizon follow by the rounded period.

All documents are kept. When a source runs out its later slots stay empty; ``in_mix`` marks the slots
before the first empty one, where the deviation bound holds.

Numbering documents within a source does not gather a source in one task: rows are dealt by source and
leading digits of their order key, numbered there, and shifted by the running counts of the buckets. Rows without
an id would share one key; they are dealt by the hash of their text.
Defined results: a null source is the source named by the empty text; null ids order by the empty text and then by
their texts' hashes; rows that repeat each take a place; an empty table gives an empty result; other columns pass
through whatever their names, but for those named as the mix's own, which are replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from fractions import Fraction
from math import lcm, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import fresh_path

MAX_SOURCES = 100_000


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` slots by largest remainder; every source gets at least one."""
    total = sum(weights[s] for s in sorted(weights))
    exact = {s: weights[s] * period / total for s in sorted(weights)}
    share = {s: max(int(x), 1) for s, x in exact.items()}
    rest = period - sum(share.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))[: max(rest, 0)]:
        share[s] += 1
    while rest < 0:  # sources that were lifted to one slot take it from the largest
        most = max(sorted(share), key=share.get)
        share[most] -= 1
        rest += 1
    return share


def period_schedule(share: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) by earliest deadline first among released blocks."""
    period = sum(share.values())
    coming = sorted((i * period // a, -(-(i + 1) * period // a), s, i) for s, a in share.items() for i in range(a))
    ready: list[tuple[int, str, int]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(coming) and coming[at][0] <= slot:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        due, s, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError(f"block {i} of {s!r} misses slot {due}")
        out.append((s, i, slot))
    return out


def exact_schedule(weights: dict[str, float], blocks: dict[str, int], segment: int = 1 << 18) -> Iterator[list[tuple[str, int, int]]]:
    """Segments of (source, block, slot) by earliest deadline first in windows of the exact weights, up to the
    first slot that falls to a source whose ``blocks`` are used up."""
    exact = {s: Fraction(weights[s]) for s in sorted(weights)}
    scale = lcm(*(x.denominator for x in exact.values()))
    part = {s: int(x * scale) for s, x in exact.items()}
    total = sum(part.values())
    # a source has one block under way: in ``coming`` until its release, then in ``ready``
    coming = [(0, -(-total // a), s, 0) for s, a in part.items()]
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int, int]] = []
    slot = 0
    while True:
        while coming and coming[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(coming)[1:])
        due, s, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError(f"block {i} of {s!r} misses slot {due}")
        if i >= blocks[s]:
            break
        out.append((s, i, slot))
        heapq.heappush(coming, ((i + 1) * total // part[s], -(-(i + 2) * total // part[s]), s, i + 1))
        slot += 1
        if len(out) == segment:
            yield out
            out = []
    yield out


def square_root_weights(counts: dict[str, int]) -> dict[str, float]:
    """Targets that flatten the corpus: each source by the square root of its documents."""
    return {s: sqrt(n) for s, n in counts.items()}


def mix(docs: DataFrame, block_docs: int = 16, weights: dict[str, float] | None = None, period: int = 1024, exact: bool = False) -> DataFrame:
    """``docs`` (doc_id, source, ...) with mix_block (of its source), mix_slot, mix_place (in the block)
    and in_mix. ``weights``: target weight by source, by default the square root of its documents;
    sources without a weight are an error, as they would be lost. ``exact``: hold the bound against the weights."""
    spark = docs.sparkSession
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    # the input's columns travel as one, so that no name of theirs meets one of the mix's
    named = docs.select(F.struct("*").alias("__all"), "doc_id", F.coalesce("source", F.lit("")).alias("__source"), text.alias("__text"))
    found = named.groupBy("__source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["__source"]: r.n for r in found}
    weights = square_root_weights(counts) if weights is None else {s or "": w for s, w in weights.items()}
    if missing := sorted(s for s in counts if weights.get(s, 0) <= 0):
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    weights = {s: weights[s] for s in counts}
    while period < 4 * len(weights):
        period *= 2
    share = quotas(weights, period) if weights else {}
    planned = period_schedule(share)
    slots = {(s, i): slot for s, i, slot in planned}
    head = None
    done = dict.fromkeys(counts, 0)
    if exact and counts:
        path, horizon = fresh_path(spark, "mix"), 0
        for rows in exact_schedule(weights, {s: n // block_docs for s, n in counts.items()}):
            for s, i, _ in rows:
                done[s] = i + 1
            horizon += len(rows)
            spark.createDataFrame(rows, "__source string, __block long, __head long").write.mode("append").parquet(path)
        head = spark.read.schema("__source string, __block long, __head long").parquet(path)
    # the first slot whose block is missing or short
    if head is None:
        horizon = min((n // block_docs // share[s] * period + slots[s, n // block_docs % share[s]] for s, n in counts.items()), default=0)

    text = json.dumps([{"s": s, "i": i, "a": share[s], "slot": slot, "done": done[s]} for s, i, slot in planned])
    table = spark.range(1, numPartitions=1).select(
        F.inline(F.from_json(F.lit(text), "array<struct<s:string,i:long,a:long,slot:long,done:long>>")).alias("__source", "__i", "__share", "__slot", "__done")
    )
    shares = table.where("__i = 0").select("__source", "__share", "__done")
    # about 4000 rows a bucket; the numbering does not depend on the number of buckets
    digits, n = 1, sum(counts.values())
    while 16**digits * 4000 < n and digits < 8:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    empty = F.md5(F.lit("").cast("binary"))
    side = F.when(F.col("doc_id").isNull(), F.concat(F.lit("1"), F.substring(F.lpad(F.hex(F.col("__text").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), 1, digits))).when(F.col("__key") < empty, "0").otherwise("2")
    keyed = named.withColumn("__key", key).withColumn("__bucket", F.concat(F.substring("__key", 1, digits), side))
    per_bucket = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", "doc_id", "__text")
    ranked = keyed.withColumn("__row", F.row_number().over(within)).join(starts, ["__source", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__row") - 1).withColumn("__block", F.expr(f"__rank div {block_docs}"))
    ranked = ranked.join(F.broadcast(shares), "__source")
    # the block's place in the period's arithmetic: blocks before the horizon do not count
    later = F.col("__block")
    if head is not None:
        ranked = ranked.join(head, ["__source", "__block"], "left")
        later = F.greatest(F.col("__block") - F.col("__done"), F.lit(0))
    ranked = ranked.withColumn("__later", later).withColumn("__i", F.col("__later") % F.col("__share"))
    placed = ranked.join(F.broadcast(table.select("__source", "__i", "__slot")), ["__source", "__i"])
    slot = F.expr(f"__later div __share * {period}") + F.col("__slot")
    if head is not None:
        slot = F.coalesce("__head", slot + horizon)
    own = ("mix_block", "mix_slot", "mix_place", "in_mix")
    return placed.select(
        *[F.col("__all").getField(c).alias(c) for c in docs.columns if c not in own], F.col("__block").alias("mix_block"), slot.alias("mix_slot"), (F.col("__rank") % block_docs).alias("mix_place"), (slot < horizon).alias("in_mix")
    )


#: DuckDB: the rows of the op1 query. The period's slots are scheduled one by one in a recursive query.
SQL = """
WITH RECURSIVE named AS (
  SELECT doc_id, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), counts AS (
  SELECT s, count(*) AS n, sqrt(count(*)) AS w FROM named GROUP BY s
), exact AS (
  SELECT s, n, w * 1024 / (SELECT sum(w) FROM counts) AS x FROM counts
), floored AS (
  SELECT s, n, x, greatest(CAST(floor(x) AS BIGINT), 1) AS a0, row_number() OVER (ORDER BY floor(x) - x, s) AS r FROM exact
), shares AS (
  SELECT s, n, CAST(a0 + CASE WHEN r <= 1024 - (SELECT sum(a0) FROM floored) THEN 1 ELSE 0 END AS BIGINT) AS a,
         row_number() OVER (ORDER BY s) AS idx FROM floored
), lists AS (
  SELECT list(a ORDER BY idx) AS a, count(*) AS m FROM shares
), plan(slot, done, pick, a, m) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), a, m FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(range(1, m + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p, a, m
  FROM (
    SELECT *, list_min(list_transform(range(1, m + 1), lambda j:
      CASE WHEN done[j] < a[j] AND done[j] * 1024 // a[j] <= slot + 1
           THEN ((done[j] + 1) * 1024 + a[j] - 1) // a[j] * 100000 + j ELSE 1000000000000 END)) % 100000 AS p
    FROM plan WHERE slot + 1 < 1024
  )
), slots AS (
  SELECT pick AS idx, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS i FROM plan WHERE slot >= 0
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS rank FROM named
), horizon AS (
  SELECT min((n // 16) // a * 1024 + slot) AS h FROM shares JOIN slots ON shares.idx = slots.idx AND slots.i = (n // 16) % a
)
SELECT doc_id, r.s AS source, CAST(rank // 16 AS BIGINT) AS mix_block,
       CAST((rank // 16) // a * 1024 + slot AS BIGINT) AS mix_slot, CAST(rank % 16 AS BIGINT) AS mix_place,
       (rank // 16) // a * 1024 + slot < h AS in_mix
FROM ranked r JOIN shares ON r.s = shares.s JOIN slots ON slots.idx = shares.idx AND slots.i = (rank // 16) % a, horizon
"""
