"""Small helpers that several operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def word_count(text: str) -> Column:
    """Number of words of a column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of all columns: together they identify a row up to exact repeats."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
