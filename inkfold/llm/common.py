"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over the cores: a file may be a single row group and so a single
    task. A table of many files stays as its scan deals it, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a temporary one only where the
    setting is missing and all executors are in this process, as in a local test. On a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made by this process, for cleanup().
_made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def cleanup(spark: SparkSession) -> None:
    """Delete the tables and files that this process has written to the shared folder. For when every
    result has been consumed: frames that still read them fail afterwards."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder: a lost executor costs a
    reread, not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_bits(wanted: DataFrame, *keys: Column, bits: int = 1 << 24) -> DataFrame:
    """(word, mask): a bitmap of the hashes of ``wanted``'s keys, 64 bits a row. Whatever the table, it has at most
    bits / 64 rows (262,144, some 4 MB), so it may be broadcast."""
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    return wanted.select((at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def hash_hits(df: DataFrame, bitmap: DataFrame, *keys: Column, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may be among those ``bitmap`` was made of, and those that surely are not. Only the
    former have to be shuffled to find out; rows with null keys count as any others."""
    word, mask, hit = (unused(x, df.columns) for x in ("word", "mask", "hit"))
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    both = df.join(F.broadcast(bitmap.toDF(word, mask)), (at / 64).cast("long") == F.col(word), "left")
    both = both.withColumn(hit, F.coalesce(F.getbit(F.col(mask), (at % 64).cast("int")) == 1, F.lit(False)))
    return both.where(F.col(hit)).select(*df.columns), both.where(~F.col(hit)).select(*df.columns)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, max_rows: int) -> DataFrame:
    """Texts with a label to learn from: doc_id, text, y. At most ``max_rows`` label rows whose
    remainder is not ``held``, chosen by a hash of doc_id, so the sample, unlike the corpus, is bounded
    and may be broadcast to the scan of the texts. Of texts that share a doc_id the one whose hash is the
    least teaches, so there are no more texts than label rows."""
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
