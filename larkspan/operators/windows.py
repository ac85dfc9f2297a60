"""Windows over long signals, and running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.prefix import prefix_sums
from larkspan.tables import Workspace, lookup


def check_windows(window: int, hop: int, chunk: float | None = None) -> None:
    if window <= 0:
        raise ValueError(f"the window must be positive, got {window}")
    if hop <= 0:
        raise ValueError(f"the hop must be positive, got {hop}")
    if chunk is not None and chunk <= 0:
        raise ValueError(f"the chunk must be positive, got {chunk}")


def window_starts(size: Column, window: int, hop: int) -> Column:
    """Starts of all windows of a signal of ``size`` samples: every ``hop`` while a window fits, then one that ends with the signal; 0 alone if it is no longer than a window."""
    check_windows(window, hop)
    regular = F.sequence(F.lit(0).cast("long"), size - window, F.lit(hop).cast("long"))
    last = F.element_at(regular, -1)
    tail = F.when(last + window < size, F.array(size - window)).otherwise(F.array().cast("array<bigint>"))
    return F.when(size <= window, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.transform(regular, lambda x: x.cast("long")), tail))


def sliding_windows(signals: DataFrame, window: int, hop: int, rate: int = 16000) -> DataFrame:
    """``signal_id, window_start, window_end, timestamp, samples`` of ``signals(signal_id, audio)``. A short signal's window is padded with zeros but ends with the signal."""
    size = F.size("audio").cast("long")
    rows = signals.select("signal_id", "audio", size.alias("__size"), F.explode(window_starts(size, window, hop)).alias("window_start"))
    end = F.least(F.col("window_start") + window, F.col("__size"))
    own = F.slice("audio", (F.col("window_start") + 1).cast("int"), F.lit(window))
    padded = F.when(F.size(own) < window, F.concat(own, F.array_repeat(F.lit(0.0).cast("float"), F.lit(window) - F.size(own)))).otherwise(own)
    return rows.select("signal_id", "window_start", end.alias("window_end"), (F.col("window_start") / F.lit(float(rate))).alias("timestamp"), padded.alias("samples"))


def gapped_starts(size: Column, window: int, hop: int, chunk: int) -> Column:
    """Starts where each chunk of ``chunk`` samples restarts the grid and stops a window before its end, as a compatible mode: what straddles a boundary isn't covered."""
    check_windows(window, hop, chunk)
    chunks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), size - 1), F.lit(chunk).cast("long"))

    def own(at: Column) -> Column:
        end = F.least(at + chunk, size)
        length = F.when(end < size, end - at - window).otherwise(end - at)
        return F.transform(F.when(length > 0, window_starts(length, window, hop)).otherwise(F.array().cast("array<bigint>")), lambda x: x + at)

    return F.when(size <= chunk, window_starts(size, window, hop)).otherwise(F.flatten(F.transform(chunks, own)))


def first_of_start(predictions: DataFrame, order: str) -> DataFrame:
    """The first prediction by ``order`` of each window start of a signal."""
    first = Window.partitionBy("signal_id", "window_start").orderBy(order)
    return predictions.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def running_offsets(rows: DataFrame, size: str, order: str, by: list[str], large: bool = False) -> DataFrame:
    """Add ``start`` and ``end``: where each row's data lies if those of its group follow one another.

    ``large``: for groups that no task should hold, such as one split of a whole corpus. Prefix sums over ranges of
    (group, order) are taken then, less the sum before the group's first row.
    """
    if large:
        ws = Workspace(rows.sparkSession, "offsets")
        order_by = [F.col(c).asc_nulls_last() for c in (*by, order)]
        placed = ws.table(prefix_sums(ws, ws.table(rows, "rows"), "ranked", order_by, {"__at": size}), "placed")
        firsts = placed.groupBy(*[F.col(c).alias(f"__by_{c}") for c in by]).agg(F.min("__at").alias("__first"))
        on = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__by_{c}")), by, F.lit(True))
        joined = placed.join(lookup(firsts), on)
        return joined.select(*rows.columns, (F.col("__at") - F.col("__first")).alias("start"), (F.col("__at") - F.col("__first") + F.col(size)).cast("long").alias("end"))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.col(size).cast("long"))


def clip_names(clips: DataFrame) -> DataFrame:
    """Add ``clip_name``: ``stem_T<seconds>.wav``, with ``_n`` before the suffix for the n-th more of one name."""
    base = F.format_string("%s_T%.3f", "stem", "timestamp")
    number = F.row_number().over(Window.partitionBy("__base").orderBy("timestamp", "window_start")) - 1
    named = clips.withColumn("__base", base).withColumn("__k", number)
    return named.withColumn("clip_name", F.concat("__base", F.when(F.col("__k") > 0, F.concat(F.lit("_"), F.col("__k").cast("string"))).otherwise(F.lit("")), F.lit(".wav"))).drop("__base", "__k")
