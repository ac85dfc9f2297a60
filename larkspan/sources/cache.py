"""A memo table of synthesised clips, keyed by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.prefix import prefix_sums
from larkspan.tables import Workspace, at_most

VERSION = "v3"
DEFAULT_LIMIT_MB = 1000


def cache_key(text: Column, voice: Column, backend: Column, speed: Column, options: Column | None = None) -> Column:
    """SHA-256 of version, text, voice, backend, speed and options (JSON with sorted keys), parted by zero bytes."""
    return F.sha2(F.concat_ws("\0", F.lit(VERSION), text, voice, backend, speed.cast("string"), options if options is not None else F.lit("{}")), 256)


def keep_recent(entries: DataFrame, limit_bytes: int, sorted_in_memory: int = 1_000_000) -> DataFrame:
    """Entries ``key, bytes, last_access`` that stay when the oldest go until the rest fits. A large index goes through prefix sums over ranges."""
    if not at_most(entries, sorted_in_memory):
        ws = Workspace(entries.sparkSession, "cache")
        placed = prefix_sums(ws, ws.table(entries, "entries"), "ranked", [F.col("last_access").desc(), F.col("key").desc()], {"__before": "bytes"})
        return placed.where(F.col("__before") + F.col("bytes") <= limit_bytes).drop("__before")
    newer = Window.orderBy(F.col("last_access").desc(), F.col("key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("total", F.sum("bytes").over(newer)).where(F.col("total") <= limit_bytes).drop("total")


def touch(entries: DataFrame, accesses: DataFrame) -> DataFrame:
    """The index with the newest access of each key."""
    every = entries.select("key", "bytes", "last_access").unionByName(accesses.select("key", "bytes", "last_access"))
    return every.groupBy("key").agg(F.max_by("bytes", "last_access").alias("bytes"), F.max("last_access").alias("last_access"))


def stats(entries: DataFrame) -> DataFrame:
    """One row ``entries, megabytes, oldest, newest``."""
    return entries.agg(F.count("*").alias("entries"), (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("megabytes"), F.min("last_access").alias("oldest"), F.max("last_access").alias("newest"))


def misses(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct requests (``key``, ...) that the memo table lacks: only these are synthesised."""
    return requests.dropDuplicates(["key"]).join(entries.select("key"), "key", "left_anti")
