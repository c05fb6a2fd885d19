"""URL filtering by host and path rules, and by association rules mined from labelled URLs.

A URL becomes a set of tokens: ``h:`` for host labels and their hyphenated parts, ``p:`` for path parts
(numbers as ``#``). Spark FP-growth mines token combinations that go with a label; rules are pruned by
support, confidence and redundancy (a rule that a more general one of no less confidence covers) and
kept in an inverted index from token to rule. A URL's rules are found through the index by counting
matched tokens; the rule of highest confidence, then support, then size decides, else the default.
Equal token sets are looked up once.

Tokens that always occur together are mined as one item, since sets that differ only in them say the same; so a
template of many parts does not make FP-growth list all subsets of its parts. Rules name each of such tokens.

Explicit rules come first: they fit a host and its subdomains when the path starts with theirs; of those
that fit the longest wins.
Defined results: a URL that is null or has no ``://`` has empty host and path, no tokens and the default
verdict; repeated rows are each returned; below ``min_rows`` URLs nothing is mined; an empty table gives
an empty result; columns beyond page_id and url are ignored.
"""

from __future__ import annotations

import json
from itertools import combinations, product
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://"

#: Words in host names that mark a URL as unwanted when labels are made.
SEED_WORDS = ("ads", "bets", "casino", "pills", "spam")


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AFTER + r"([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path); null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """The token set of a row's host and path, sorted."""
    host = F.split("host", r"[^a-z0-9]+")
    path = F.split(F.translate(F.col("path"), _UPPER, _LOWER), r"[^a-z0-9]+")
    path = F.transform(path, lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
    host, path = (F.filter(x, lambda y: y != "") for x in (host, path))
    return F.array_sort(F.array_distinct(F.concat(F.transform(host, lambda x: F.concat(F.lit("h:"), x)), F.transform(path, lambda x: F.concat(F.lit("p:"), x)))))


def seed_label() -> Column:
    """block where a part of the host is a seed word, else null."""
    parts = F.split("host", r"[^a-z0-9]+")
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, SEED_WORDS))), "block")


def mine(
    labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float, max_tokens: int, max_rules: int
) -> list[tuple[list[str], str, float, float]]:
    """(tokens, verdict, confidence, support) of the rules, best first. labelled: tokens, label (non-null).
    A rule holds for at least ``min_rows`` rows and the share ``min_support`` of them, so at most 1 / min_support
    tokens of a URL matter. ``max_rules`` bounds the rules, best first, after redundant ones are left out."""
    sets = materialize(labelled.where(F.size("tokens") > 0).groupBy("tokens", "label").agg(F.count("*").alias("rows")), "token-sets")
    n = sets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    least = max(ceil(min_support * n), min_rows)
    if n < least:
        return []
    # tokens of the same sets have equal sums of hashes over them
    hash_ = F.xxhash64("tokens").cast("decimal(38,0)")
    each = sets.select("rows", "label", hash_.alias("of"), F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.sum("rows").alias("rows"), F.count("*").alias("sets"), F.sum("of").alias("of")).where(F.col("rows") >= least)
    # at most (tokens of a URL) / min_support rows
    classes: dict[tuple, list[str]] = {}
    for r in frequent.collect():
        classes.setdefault((r.rows, r.sets, r.of), []).append(r.token)
    same = {min(c): sorted(c) for c in classes.values()}
    items = labelled.where(F.size("tokens") > 0).select(F.array_append(F.filter("tokens", lambda t: t.isin(sorted(same))), F.concat(F.lit("label="), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
    found = (
        model.associationRules.where(F.element_at("consequent", 1).startswith("label=") & (F.size("antecedent") <= max_tokens))
        .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 7, 99).alias("verdict"), "confidence", "support").collect()
    )
    # more general rules first: one that covers another with no less confidence makes it redundant
    general: dict[frozenset[str], float] = {}
    kept: list[tuple[list[str], str, float, float]] = []
    for r in sorted(found, key=lambda r: (len(r.tokens), -r.confidence, -r.support, r.tokens)):
        parts = [frozenset(c) for k in range(1, len(r.tokens)) for c in combinations(r.tokens, k)]
        if not any(general.get(p, -1.0) >= r.confidence for p in parts):
            general[frozenset(r.tokens)] = r.confidence
            kept += [(sorted(choice), r.verdict, r.confidence, r.support) for choice in product(*(same[t] for t in r.tokens))]
    return sorted(kept, key=lambda r: (-r[2], -r[3], -len(r[0]), r[0], r[1]))[:max_rules]


def _literal(near: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values without leaving the JVM."""
    kind = "array<struct<" + schema.replace(" string", ":string").replace(" int", ":int").replace(" double", ":double") + ">>"
    return near.sparkSession.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def match(sets: DataFrame, rules: list[tuple[list[str], str, float, float]]) -> DataFrame:
    """(tokens, mined_rule, mined_verdict, confidence) for the token sets that a rule fits; the rank of a
    rule in ``rules`` breaks ties. The index holds at most max_rules * max_tokens rows."""
    index = _literal(sets, [{"token": t, "rank": i, "size": len(ts)} for i, (ts, *_) in enumerate(rules) for t in ts], "token string, rank int, size int")
    facts = _literal(
        sets, [{"rank": i, "mined_rule": " ".join(ts), "mined_verdict": v, "confidence": c} for i, (ts, v, c, _) in enumerate(rules)],
        "rank int, mined_rule string, mined_verdict string, confidence double",
    )
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    full = hits.groupBy("tokens", "rank").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size")
    return full.groupBy("tokens").agg(F.min("rank").alias("rank")).join(F.broadcast(facts), "rank").drop("rank")


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.005, min_rows: int = 10, min_confidence: float = 0.8,
    max_tokens: int = 3, max_rules: int = 2000, default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence per row of ``pages``. Labels for mining:
    block where the host has a seed word, else the explicit rule's verdict, else the default, so that a
    rule's confidence is measured against every URL it would decide and not only against labelled ones."""
    rule, verdict = ruled(rules)
    read = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("tokens", tokens())
    read = read.withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = read.select("tokens", F.coalesce(seed_label(), F.col("ruled"), F.lit(default)).alias("label"))
    mined = mine(labelled, min_support, min_rows, min_confidence, max_tokens, max_rules)
    if mined:
        # URLs without tokens would share one key; no rule fits them
        bare = read.where(F.size("tokens") == 0).withColumns({"mined_rule": F.lit(None).cast("string"), "mined_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
        full = read.where(F.size("tokens") > 0)
        read = full.join(match(full.select("tokens").distinct(), mined), "tokens", "left").unionByName(bare)
    else:
        read = read.withColumns({"mined_rule": F.lit(None).cast("string"), "mined_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return read.select("page_id", "host", "path", "rule", F.coalesce("ruled", "mined_verdict", F.lit(default)).alias("verdict"), "mined_rule", "confidence")


#: DuckDB: the rows of the op8 query. Token sets of up to three are counted outright.
SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), hit AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut
), read AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
         list_filter(string_split_regex(host, '[^a-z0-9]+'), lambda x: x <> '') AS hs,
         list_filter(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS ps
  FROM hit
), sets AS (
  SELECT *, list_sort(list_distinct(list_concat(list_transform(hs, lambda x: 'h:' || x),
           list_transform(ps, lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END)))) AS tokens,
         CASE WHEN list_has_any(hs, ['ads', 'bets', 'casino', 'pills', 'spam']) THEN 'block' ELSE coalesce(ruled, 'allow') END AS label
  FROM read
), toks AS (
  SELECT tokens, t, i, label, n FROM (
    SELECT tokens, label, count(*) AS n, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM sets WHERE len(tokens) > 0 GROUP BY tokens, label)
), combos AS (
  SELECT [t] AS c, label, n FROM toks
  UNION ALL SELECT [a.t, b.t], a.label, a.n FROM toks a JOIN toks b ON a.tokens = b.tokens AND a.label = b.label AND a.i < b.i
  UNION ALL SELECT [a.t, b.t, d.t], a.label, a.n FROM toks a JOIN toks b ON a.tokens = b.tokens AND a.label = b.label AND a.i < b.i
    JOIN toks d ON a.tokens = d.tokens AND a.label = d.label AND b.i < d.i
), counted AS (
  SELECT c, label, sum(n) AS hits, sum(sum(n)) OVER (PARTITION BY c) AS n FROM combos GROUP BY c, label
), total AS (
  SELECT count(*) AS n FROM sets WHERE len(tokens) > 0
), candidates AS (
  SELECT c, label AS verdict, CAST(hits AS DOUBLE) / CAST(counted.n AS DOUBLE) AS confidence, hits FROM counted, total
  WHERE hits >= greatest(ceil(0.005 * total.n), 10) AND CAST(hits AS DOUBLE) / CAST(counted.n AS DOUBLE) >= 0.8
  ORDER BY confidence DESC, hits DESC, len(c) DESC, c, verdict LIMIT 2000
), rules AS (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, hits DESC, len(c) DESC, c, verdict) AS rank FROM candidates a
  WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE len(b.c) < len(a.c) AND b.confidence >= a.confidence AND list_has_all(a.c, b.c))
), best AS (
  SELECT tokens, min(rank) AS rank FROM (SELECT DISTINCT tokens FROM sets) s JOIN rules r ON list_has_all(s.tokens, r.c) GROUP BY tokens
)
SELECT page_id, host, path, rule, coalesce(ruled, verdict, 'allow') AS verdict, array_to_string(c, ' ') AS mined_rule, confidence
FROM sets LEFT JOIN best ON sets.tokens = best.tokens LEFT JOIN rules ON best.rank = rules.rank
"""
