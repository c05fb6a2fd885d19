"""Text values: normalisation and visibility."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: White space to collapse, or a character that may be a format character or Unicode white space.
_UNSETTLED = r"[^\x{21}-\x{7E}\x{A1}-\x{AC}\x{AE}-\x{24F} ]|^ | $|  "


def collapsed(s: Column) -> Column:
    """Format characters dropped, white space (Unicode) collapsed to one blank and trimmed; assumes NFC.
    A single scan finds the texts that need none of it."""
    settled = F.trim(F.regexp_replace(F.regexp_replace(s, r"\p{Cf}", ""), r"(?U)\s+", " "))
    return F.when(~s.rlike(_UNSETTLED), s).otherwise(settled)


def normalized_values(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with the normalised text of ``column``. Only rows with characters above U+00FF can change
    under NFC composition or Latin decomposition, so the others never reach Python."""
    simple = F.coalesce(F.col(column), F.lit("")).rlike(r"^[\x{0}-\x{2FF}]*$")
    plain = df.where(simple).withColumn(to, collapsed(F.col(column)))
    other = df.where(~simple).withColumn(to, collapsed(_nfc(F.col(column))))
    return plain.unionByName(other)


def visible(s: Column) -> Column:
    """Something remains after normalisation; a printing ASCII character decides at once."""
    return F.coalesce(s.rlike("[!-~]") | (collapsed(s) != ""), F.lit(False))
