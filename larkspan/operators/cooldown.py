"""Greedy cooldown: keep a hit, then skip hits until ``gap`` after it.

A hit is compared with the last kept one, not with the last one seen, so this is no session window. Streams are cut into
blocks of positions, ``BLOCK`` gaps long. What a block keeps depends on what came before through one position only, the
first one that is free again; and only hits within a gap of the block's start can be its first kept hit. So a block is
folded once for each of these few entries, all blocks at once, and a stream's blocks are then chained by their entries.
No task holds a stream's hits, however long it is and however close its hits are. A block that no hit lies within a gap
before has one entry, its first hit.

Null positions are no hits. Repeated positions count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.shipping import ship

#: Gaps in a block. It keeps at most so many hits, and with whole positions it holds at most so many times the gap.
BLOCK = 1_024


def _positive(gap: float | int) -> None:
    if gap < 0:
        raise ValueError(f"the cooldown must not be negative, got {gap}")


def _block(at: Column, gap: float | int) -> Column:
    return F.floor(at / F.lit(gap * BLOCK)).cast("long")


def _entries(hits: DataFrame, keys: list[str], position: str, gap: float | int) -> DataFrame:
    """``keys, __block, __bound, __runs``: for each block and each hit that may be its first kept one, ``e``, the number kept ``n`` and the next free position ``free``.

    ``__bound``: whether a hit lies less than a gap before the block.
    """
    at, block = F.col("__p"), F.col("__own")
    rows = hits.where(F.col(position).isNotNull()).select(*keys, F.col(position).alias("__p"), _block(F.col(position), gap).alias("__own"))
    # Hits less than a gap from their block's end are told to the next one.
    late = at + F.lit(gap) >= (block + 1) * F.lit(gap * BLOCK)
    told = rows.select(*keys, "__p", "__own", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))).alias("__block"))
    mine = F.col("__own") == F.col("__block")
    blocks = told.groupBy(*keys, "__block").agg(F.array_sort(F.collect_set(F.when(mine, at))).alias("__at"), F.max(F.when(~mine, at)).alias("__before")).where(F.size("__at") > 0)
    free = F.col("__before") + F.lit(gap)
    # All that lie within a gap of the last hit before, and the first beyond.
    possible = F.filter("__at", lambda x, i: (i == 0) | (x < free) | (F.get("__at", i - 1) < free))
    entries = F.when(F.col("__before").isNull(), F.slice("__at", 1, 1)).otherwise(possible)

    def run(e: Column) -> Column:
        start = F.struct(e.alias("free"), F.lit(0).cast("long").alias("n"))

        def step(s: Column, x: Column) -> Column:
            keep = x >= s["free"]
            return F.struct(F.when(keep, x + F.lit(gap)).otherwise(s["free"]).alias("free"), (s["n"] + keep.cast("long")).alias("n"))

        return F.aggregate("__at", start, step, lambda s: F.struct(e.alias("e"), s["n"].alias("n"), s["free"].alias("free")))

    return blocks.select(*keys, "__block", F.col("__before").isNotNull().alias("__bound"), F.transform(entries, run).alias("__runs"))


def _taken(block: Column, free: Column) -> Column:
    """The run of a block whose entry is its first hit that is free; null if none is."""
    return F.get(F.filter(block["__runs"], lambda r: ~block["__bound"] | free.isNull() | (r["e"] >= free)), F.lit(0))


def _chain(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "__bound", "__runs"))).alias("__blocks"))


def count_kept(hits: DataFrame, keys: list[str], position: str, gap: int) -> DataFrame:
    """Number of kept hits per key as ``kept``; keys without hits have no row."""
    if gap < 1:
        raise ValueError(f"the cooldown must be at least 1, got {gap}")
    entries = _entries(hits.withColumn(position, F.col(position).cast("long")), keys, position, gap)
    start = F.struct(F.lit(None).cast("long").alias("free"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, block: Column) -> Column:
        run = _taken(block, s["free"])
        return F.struct(F.coalesce(run["free"], s["free"]).alias("free"), (s["n"] + F.coalesce(run["n"], F.lit(0).cast("long"))).alias("n"))

    return _chain(entries, keys).select(*keys, F.aggregate("__blocks", start, step, lambda s: s["n"]).alias("kept"))


def _with_free(hits: DataFrame, keys: list[str], position: str, gap: float | int, tie: str) -> DataFrame:
    """``keys, position, tie, __block, __free``: the hits with the first position of their block that is free, null if all are."""
    entries = _entries(hits, keys, position, gap)
    kind = entries.schema["__runs"].dataType.elementType["free"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("free"), F.array().cast(f"array<struct<block:bigint,free:{kind}>>").alias("all"))

    def step(s: Column, block: Column) -> Column:
        # Blocks that nothing before can bind aren't noted.
        noted = F.when(block["__bound"], F.concat(s["all"], F.array(F.struct(block["__block"].alias("block"), s["free"].alias("free"))))).otherwise(s["all"])
        return F.struct(F.coalesce(_taken(block, s["free"])["free"], s["free"]).alias("free"), noted.alias("all"))

    bound = _chain(entries, keys).select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.explode(F.aggregate("__blocks", start, step, lambda s: s["all"])).alias("__f"))
    rows = hits.where(F.col(position).isNotNull()).select(*keys, position, tie, _block(F.col(position), gap).alias("__block"))
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__of_{k}")), keys, F.col("__block") == F.col("__f.block"))
    return rows.join(bound, on, "left").select(*keys, position, tie, "__block", F.col("__f.free").alias("__free"))


def select_kept(hits: DataFrame, keys: list[str], position: str, gap: float | int, tie: str) -> DataFrame:
    """The kept hits as ``keys, position, tie``; equal positions go by ``tie``. A gap of 0 keeps all."""
    _positive(gap)
    if gap == 0:
        return hits.select(*keys, position, tie)
    kind = dict(hits.dtypes)
    rows = _with_free(hits, keys, position, gap, tie)
    start = F.struct(F.col("__free").alias("free"), F.array().cast(f"array<struct<p:{kind[position]},t:{kind[tie]}>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        keep = s["free"].isNull() | (x["p"] >= s["free"])
        return F.struct(F.when(keep, x["p"] + F.lit(gap)).otherwise(s["free"]).alias("free"), F.when(keep, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    # A position's first hit by tie stands for all; a block keeps BLOCK hits at most, so its list stays short.
    first = rows.groupBy(*keys, "__block", "__free", position).agg(F.min(tie).alias(tie))
    blocks = first.groupBy(*keys, "__block", "__free").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(tie).alias("t")))).alias("__at"))
    kept = blocks.select(*keys, F.explode(F.aggregate("__at", start, step, lambda s: s["kept"])).alias("__k"))
    return kept.select(*keys, F.col("__k.p").alias(position), F.col("__k.t").alias(tie))


def select_kept_streamed(hits: DataFrame, keys: list[str], position: str, gap: float | int, tie: str) -> DataFrame:
    """The same for blocks too large for an array, as of fine time stamps: sorted rows stream through tasks that hold one position."""
    _positive(gap)
    if gap == 0:
        return hits.select(*keys, position, tie)
    ship(hits.sparkSession)
    rows = _with_free(hits, keys, position, gap, tie)
    group = [*keys, "__block"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, None
        for part in parts:
            keep = []
            for at, bound, *own in zip(part[position], part["__free"], *(part[k] for k in group), strict=True):
                own = [None if pd.isna(k) else k for k in own]
                if own != current:
                    current, free = own, None if pd.isna(bound) else bound
                keep.append(free is None or at >= free)
                free = at + gap if keep[-1] else free
            yield part.loc[keep, [*keys, position, tie]]

    return rows.repartition(*group).sortWithinPartitions(*group, position, tie).mapInPandas(run, hits.select(*keys, position, tie).schema)
