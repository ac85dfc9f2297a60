"""Reproducible draws. Every choice depends on a seed, a purpose and a key alone, never on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, purpose: str, key: Column) -> Column:
    """A hexadecimal key whose order is a shuffle of the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), key.cast("string")))


def uniform(seed: int, purpose: str, key: Column) -> Column:
    """A number in [0, 1) with 32 random bits."""
    return F.conv(F.substring(order_key(seed, purpose, key), 1, 8), 16, 10).cast("double") / 4294967296.0


def integer(seed: int, purpose: str, key: Column, size: Column | int) -> Column:
    """A number in 0 .. size - 1."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor(uniform(seed, purpose, key) * size).cast("int")
