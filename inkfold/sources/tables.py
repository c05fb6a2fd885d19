"""Stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt over the cores: a file may be a single row group and so a single
    task. A table of many files stays as its scan deals it, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: later filters on it are not pushed below it, where the
    optimizer would have to repeat ``value``."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw source files: path, length, content. Gates can filter on length before content is decoded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
