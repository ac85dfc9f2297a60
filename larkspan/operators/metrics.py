"""Evaluation of scored streams: false accepts, misses, sweeps over thresholds and equal error rates.

``scores`` has ``stream_id, frame, prediction, ground_truth``. Both comparisons are strict: a prediction equal to
the threshold is neither a detection nor a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.cooldown import count_kept

COOLDOWN = 75


def _hours(hours: float) -> float:
    if hours <= 0:
        raise ValueError(f"the duration must be positive, got {hours}")
    return float(hours)


def _threshold(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError(f"the threshold must be between 0 and 1, got {threshold}")
    return float(threshold)


def false_accepts(scores: DataFrame, threshold: float, cooldown: int = COOLDOWN) -> DataFrame:
    """``stream_id, false_accepts``: detections after the greedy cooldown, true positives included. Streams without detections have 0."""
    hits = scores.where(F.col("prediction") > threshold)
    kept = count_kept(hits, ["stream_id"], "frame", cooldown)
    return scores.select("stream_id").distinct().join(kept, "stream_id", "left").select("stream_id", F.coalesce("kept", F.lit(0)).cast("long").alias("false_accepts"))


def false_accepts_per_hour(scores: DataFrame, hours: float, threshold: float, cooldown: int = COOLDOWN) -> DataFrame:
    """``stream_id, far`` in events per hour."""
    hours = _hours(hours)
    return false_accepts(scores, threshold, cooldown).select("stream_id", (F.col("false_accepts") / F.lit(hours)).alias("far"))


def false_negatives(scores: DataFrame, threshold: float) -> DataFrame:
    """``stream_id, positives, misses``."""
    positive = F.col("ground_truth") == 1
    return scores.groupBy("stream_id").agg(F.count_if(positive).alias("positives"), F.count_if(positive & (F.col("prediction") < threshold)).alias("misses"))


def false_reject_rate(scores: DataFrame, threshold: float) -> DataFrame:
    """``stream_id, frr``; 0 without positives."""
    counts = false_negatives(scores, _threshold(threshold))
    return counts.select("stream_id", F.coalesce(F.try_divide(F.col("misses").cast("double"), F.col("positives").cast("double")), F.lit(0.0)).alias("frr"))


def grid(n: int) -> Column:
    """``n`` thresholds from 0 to 1."""
    if n < 2:
        raise ValueError(f"at least 2 thresholds are needed, got {n}")
    step = 1.0 / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, F.lit(1.0)).otherwise(i * F.lit(step)))


def _far_at(scores: DataFrame, thresholds: Column, hours: float, cooldown: int) -> DataFrame:
    """``threshold, far`` over all streams, for thresholds with hits."""
    hits = scores.select("stream_id", "frame", "prediction", thresholds.alias("__all")).select("stream_id", "frame", F.explode(F.filter("__all", lambda t: F.col("prediction") > t)).alias("threshold"))
    kept = count_kept(hits, ["threshold", "stream_id"], "frame", cooldown)
    return kept.groupBy("threshold").agg((F.sum("kept") / F.lit(_hours(hours))).alias("far"))


def sweep(scores: DataFrame, hours: float, n: int = 100, cooldown: int = COOLDOWN) -> DataFrame:
    """``threshold, far, frr`` at ``n`` thresholds over all streams.

    Only hits meet thresholds. Misses need one pass: each positive counts at the first threshold above
    it, and a running sum over the at most ``n`` counts gives all.
    """
    spark, thresholds = scores.sparkSession, grid(n)
    table = spark.range(1).select(F.posexplode(thresholds).alias("k", "threshold"))
    first = F.size(F.filter(thresholds, lambda t: t <= F.col("prediction")))
    positives = scores.where("ground_truth = 1").groupBy(first.alias("k")).agg(F.count("*").alias("n"))
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy())
    # The last row holds the positives that no threshold exceeds.
    slots = table.select("k", "threshold").unionByName(spark.range(1).select(F.lit(n).alias("k"), F.lit(None).cast("double").alias("threshold")))
    missed = slots.join(F.broadcast(positives), "k", "left").select("k", "threshold", F.sum(F.coalesce("n", F.lit(0))).over(order).alias("misses"), total.alias("positives"))
    frr = missed.where("threshold is not null").select("threshold", F.coalesce(F.try_divide(F.col("misses").cast("double"), F.col("positives").cast("double")), F.lit(0.0)).alias("frr"))
    return frr.join(F.broadcast(_far_at(scores, thresholds, hours, cooldown)), "threshold", "left").select("threshold", F.coalesce("far", F.lit(0.0)).alias("far"), "frr")


def optimal_threshold(swept: DataFrame) -> DataFrame:
    """The row whose ``far`` (per hour, as it is) and ``frr`` are nearest; the lowest threshold of equals."""
    best = F.min(F.struct(F.abs(F.col("far") - F.col("frr")).alias("d"), "threshold", "far", "frr"))
    return swept.agg(best.alias("b")).where("b is not null").select("b.threshold", "b.far", "b.frr")


def roc(swept: DataFrame) -> DataFrame:
    """One row ``eer, eer_threshold, points``: mean of ``far`` and ``frr`` where they are nearest; zeros without points."""
    best = F.min(F.struct(F.abs(F.col("far") - F.col("frr")).alias("d"), "threshold", "far", "frr"))
    return swept.agg(best.alias("b"), F.count("*").alias("points")).select(F.coalesce((F.col("b.far") + F.col("b.frr")) / 2, F.lit(0.0)).alias("eer"), F.coalesce("b.threshold", F.lit(0.0)).alias("eer_threshold"), "points")


def roc_from_arrays(curves: DataFrame) -> DataFrame:
    """``id, eer, eer_threshold`` of supplied ``id, far[], frr[], thresholds[]?``; the index stands in for missing thresholds. Arrays of different lengths are an error."""
    checked = F.when(F.size("far") != F.size("frr"), F.raise_error(F.lit("far and frr differ in length"))).otherwise(F.arrays_zip("far", "frr"))
    points = curves.select("id", "thresholds", F.posexplode_outer(checked).alias("i", "p"))
    threshold = F.coalesce(F.get("thresholds", F.col("i")), F.col("i").cast("double"))
    best = F.min(F.when(F.col("i").isNotNull(), F.struct(F.abs(F.col("p.far") - F.col("p.frr")).alias("d"), F.col("i"), F.col("p.far").alias("far"), F.col("p.frr").alias("frr"), threshold.alias("t"))))
    return points.groupBy("id").agg(best.alias("b")).select("id", F.coalesce((F.col("b.far") + F.col("b.frr")) / 2, F.lit(0.0)).alias("eer"), F.coalesce("b.t", F.lit(0.0)).alias("eer_threshold"))


def equal_error(scores: DataFrame, hours: float, n: int = 200, cooldown: int = COOLDOWN) -> DataFrame:
    """One row ``eer, threshold`` by interpolation.

    ``far`` is divided by its maximum; at the first change of sign of the difference to ``frr`` (zero
    being a sign of its own) the threshold is interpolated and both rates are evaluated again there.
    Without a change: ``frr`` at the nearest point.
    """
    swept = sweep(scores, hours, n, cooldown)
    whole = Window.partitionBy()
    normal = swept.withColumn("top", F.max("far").over(whole)).withColumn("d", F.when(F.col("top") > 0, F.col("far") / F.col("top")).otherwise(F.col("far")) - F.col("frr"))
    order = Window.orderBy("threshold")
    steps = normal.select("*", F.lead("threshold").over(order).alias("t1"), F.lead("d").over(order).alias("d1"))
    crossing = F.min(F.when(F.signum("d") != F.signum("d1"), F.struct("threshold", "d", "t1", "d1")))
    nearest = F.min(F.struct(F.abs("d").alias("d"), "threshold", "frr"))
    found = steps.agg(crossing.alias("c"), nearest.alias("n"), F.max("top").alias("top"))
    between = F.col("c.threshold") - F.col("c.d") * (F.col("c.t1") - F.col("c.threshold")) / (F.col("c.d1") - F.col("c.d"))
    at = found.select(F.when(F.col("c").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), between))).alias("at"), "top", F.col("n.frr").alias("frr_near"), F.col("n.threshold").alias("near"))
    # One row, not collected: the second evaluation joins it.
    again = scores.join(F.broadcast(at.select("at")), F.lit(True))
    hits = again.where(F.col("prediction") > F.col("at"))
    far = count_kept(hits, ["stream_id"], "frame", cooldown).agg((F.coalesce(F.sum("kept"), F.lit(0)) / F.lit(_hours(hours))).alias("far"))
    positive = F.col("ground_truth") == 1
    frr = again.agg(F.coalesce(F.try_divide(F.count_if(positive & (F.col("prediction") < F.col("at"))).cast("double"), F.count_if(positive).cast("double")), F.lit(0.0)).alias("frr"))
    one = at.join(F.broadcast(far), F.lit(True)).join(F.broadcast(frr), F.lit(True))
    eer = F.when(F.col("top") > 0, (F.col("far") / F.col("top") + F.col("frr")) / 2).otherwise(F.col("frr"))
    return one.select(F.when(F.col("at").isNotNull(), eer).otherwise(F.col("frr_near")).alias("eer"), F.coalesce("at", "near").alias("threshold"))


def report(scores: DataFrame, hours: float, threshold: float = 0.5, cooldown: int = COOLDOWN, n: int = 200) -> DataFrame:
    """One row ``far, frr, eer, optimal_threshold, audio_duration_hours, total_samples`` over all streams."""
    hours = _hours(hours)
    positive = F.col("ground_truth") == 1
    rates = scores.agg(F.count("*").alias("total_samples"), F.coalesce(F.try_divide(F.count_if(positive & (F.col("prediction") < _threshold(threshold))).cast("double"), F.count_if(positive).cast("double")), F.lit(0.0)).alias("frr"))
    accepts = count_kept(scores.where(F.col("prediction") > threshold), ["stream_id"], "frame", cooldown).agg((F.coalesce(F.sum("kept"), F.lit(0)) / F.lit(hours)).alias("far"))
    eer = equal_error(scores, hours, n, cooldown)
    joined = rates.join(F.broadcast(accepts), F.lit(True)).join(F.broadcast(eer), F.lit(True))
    return joined.select("far", "frr", "eer", F.col("threshold").alias("optimal_threshold"), F.lit(hours).alias("audio_duration_hours"), "total_samples")
