"""Sinks. A candidate is always a full rewrite: an existing target is an error, never appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_candidate(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def canonical_json(**fields: Column) -> Column:
    """JSON with keys sorted and absent values dropped; nested structs are passed as built with ``canonical_struct``."""
    return F.to_json(canonical_struct(**fields), {"ignoreNullFields": "true"})


def canonical_struct(**fields: Column) -> Column:
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def canonical_bytes(json: Column) -> Column:
    return F.encode(json, "UTF-8")


def content_identity(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
