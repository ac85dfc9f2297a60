"""Prefix sums over a total order, without a task that sees all rows.

Rows are dealt to ranges of the order and the range number is written with the row, so that later
steps agree on it. One number per range and column goes through a window; all other work is within
ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.tables import Workspace

SLICE = "__slice"
#: Slices of a table, at most. One row per slice is broadcast, so this bounds it; larger tables have longer slices.
MOST_SLICES = 20_000


def prefix_sums(ws: Workspace, df: DataFrame, name: str, order: list[Column], sums: dict[str, str], rows_per_slice: int = 50_000) -> DataFrame:
    """Add, for each ``out: column`` of ``sums``, the sum of ``column`` over the rows before this one.

    ``df`` is read twice and should be a written table of narrow rows. ``order`` must be total but for
    rows that are equal in all columns. Numbers are summed as longs. Empty tables give empty results.
    """
    rows = df.count()
    slices = max(1, min(MOST_SLICES, -(-rows // rows_per_slice)))
    dealt = ws.table(df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id()), name)
    totals = dealt.groupBy(SLICE).agg(*[F.sum(c).cast("long").alias(f"__of_{out}") for out, c in sums.items()])
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, so MOST_SLICES rows at most.
    offsets = totals.select(SLICE, *[F.coalesce(F.sum(f"__of_{out}").over(before), F.lit(0)).alias(f"__at_{out}") for out in sums])
    within = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(offsets), SLICE)
    out = reduce(lambda d, x: d.withColumn(x[0], (F.col(f"__at_{x[0]}") + F.coalesce(F.sum(x[1]).over(within), F.lit(0))).cast("long")), sums.items(), joined)
    return out.drop(SLICE, *[f"__at_{out_}" for out_ in sums])


def smallest(ws: Workspace, df: DataFrame, name: str, order: list[Column], most: int, sorted_in_memory: int = 1_000_000) -> DataFrame:
    """The first ``most`` rows of an order. Few are picked by one task from each task's few; many by their ranks."""
    if most <= sorted_in_memory:
        return df.orderBy(*order).limit(most)
    ranked = prefix_sums(ws, ws.table(df.withColumn("__one", F.lit(1).cast("long")), f"{name}-rows"), name, order, {"__rank": "__one"})
    return ranked.where(F.col("__rank") < most).drop("__rank", "__one")
