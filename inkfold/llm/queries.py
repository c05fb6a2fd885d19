"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import ann, decontam, langid, linededup, mixing, quality, simhash, toxicity, urlrules, warc
from inkfold.llm.common import remainder, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), radius=4, shingle=4)


def _held_out(modulus: int, held: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out")


def _predicted(threshold: float) -> Column:
    return (F.col("score") >= threshold).cast("int").alias("predicted")


@_query
def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), modulus=3, held=1)
    return quality.score(docs, model).select("doc_id", _held_out(3, 1), "score", _predicted(0.5))


@_query
def op7_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=4, held=2)
    return toxicity.score(docs, model).select("doc_id", _held_out(4, 2), "score", _predicted(0.3))


@_query
def op3_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.fit(docs, modulus=4, held=2)
    return langid.predict(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


@_query
def op5_line_dedup_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and the MD5 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = linededup.dedup_lines(docs, min_sites=4, min_chars=20, counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op5_line_dedup_site_spread"] = linededup.SQL


@_query
def op6_decontamination_qgram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@_query
def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and slot in a mix by the square root of each source's size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return mixing.mix(docs, block_docs=16, period=1024)


ORACLES["op1_pfair_mixing"] = mixing.SQL


@_query
def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is archived; then every URL is looked up in the index and its records are read back."""
    pages = spread(table(spark, sf_dir, "pages"))
    return warc.archive(pages, least_bytes=0).records(urls=pages)


ORACLES["op2_warc_capture_index"] = warc.SQL

#: Fixed values: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@_query
def op8_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op8_url_association_rules"] = urlrules.SQL


@_query
def op4_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)
