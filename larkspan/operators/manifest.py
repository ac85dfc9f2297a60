"""Manifest algebra: validation, union, merge, append, audits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.draws import order_key
from larkspan.operators.prefix import smallest
from larkspan.tables import Workspace

#: Rules that a row must keep to be written, with what is said of a breach.
RULES: list[tuple[str, str]] = [
    ("path is null or path = ''", "path is empty"),
    ("path like '/%'", "path must be relative"),
    ("label is null or label not in (0, 1)", "label must be 0 or 1"),
    ("duration_ms is null or duration_ms <= 0", "duration_ms must be positive"),
    ("sample_rate is null or sample_rate <= 0", "sample_rate must be positive"),
]


def breaches() -> Column:
    """What is wrong with a row, in the order of the rules."""
    return F.filter(F.array(*[F.when(F.expr(rule), F.lit(said)) for rule, said in RULES]), lambda x: x.isNotNull())


def validate(manifest: DataFrame) -> DataFrame:
    """``path, position, message`` for each breach; no rows if all is well."""
    return manifest.select("path", F.posexplode(breaches()).alias("position", "message"))


def invariants(manifest: DataFrame) -> DataFrame:
    """``path, valid`` by the rules of construction: a label of 0 or 1, a duration of 0 or more, a positive rate."""
    valid = F.col("label").isin(0, 1) & (F.col("duration_ms") >= 0) & (F.col("sample_rate") > 0)
    return manifest.select("path", F.coalesce(valid, F.lit(False)).alias("valid"))


def speaker(column: str = "voice") -> Column:
    """The voice, or ``unknown`` if it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def speaker_counts(manifest: DataFrame, by: str = "voice") -> DataFrame:
    """``speaker, positives, negatives`` per group."""
    return manifest.groupBy(speaker(by).alias("speaker")).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def collisions(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Paths that are in both, in order of the paths if sorted; an error if a merge is to follow."""
    return positives.select("path").join(negatives.select("path"), "path", "left_semi").distinct()


def union(*manifests: DataFrame) -> DataFrame:
    """All rows of all manifests, repeats included, with ``origin`` telling which."""
    out = manifests[0].withColumn("origin", F.lit(0))
    for k, more in enumerate(manifests[1:], 1):
        out = out.unionByName(more.withColumn("origin", F.lit(k)))
    return out


def downsample(negatives: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """``target`` negatives by a draw on their paths; all if there are no more."""
    return smallest(Workspace(negatives.sparkSession, "downsample"), negatives, "ranked", [order_key(seed, "ratio", F.col("path")).asc(), F.col("path").asc()], target)


def merge(positives: DataFrame, negatives: DataFrame, ratio: float | None = None, seed: int | None = 42) -> DataFrame:
    """Positives and, at ``ratio`` per positive, negatives; ``position`` is a shuffled order, or a stable one without seed.

    Paths in both are an error, as is an empty result. A ratio of 0 takes no negatives; without positives
    all negatives stay whatever the ratio.
    """
    common = [r["path"] for r in collisions(positives, negatives).orderBy("path").limit(6).collect()]
    if common:
        raise ValueError(f"paths are in both manifests: {', '.join(common[:5])}{', ...' if len(common) > 5 else ''}")
    n_positive = positives.count()
    if ratio is not None and ratio < 0:
        raise ValueError(f"the ratio must not be negative, got {ratio}")
    if n_positive and ratio is not None:
        negatives = downsample(negatives, int(n_positive * ratio), seed or 0)
    elif not n_positive and not negatives.limit(1).count():
        raise ValueError("both manifests are empty")
    return union(positives, negatives)


def shuffled(manifest: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``order_key``; sorting by it and the path shuffles reproducibly. Nothing is gathered in one place to number rows."""
    return manifest.withColumn("order_key", order_key(seed, "shuffle", F.col("path")))


def merge_stats(merged: DataFrame) -> DataFrame:
    """One row ``total, positives, negatives, actual_ratio``; a ratio of 0 without positives."""
    counts = merged.agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return counts.withColumn("actual_ratio", F.coalesce(F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")), F.lit(0.0)))


def append_new(training: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows of ``new`` whose path isn't in ``training``, the first by ``order`` of each path."""
    first = Window.partitionBy("path").orderBy(order)
    fresh = new.join(training.select("path").distinct(), "path", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def missing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose ``path`` isn't in ``listing(path)``."""
    return manifest.join(listing.select("path").distinct(), "path", "left_anti")


def overlap_audit(splits: DataFrame) -> DataFrame:
    """``path, splits`` for each path in more than one split: one pass in place of a join for each pair."""
    return splits.groupBy("path").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def leak_audit(splits: DataFrame) -> DataFrame:
    """``voice, splits`` for each voice in more than one split; null voices don't count."""
    return splits.where("voice is not null").groupBy("voice").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def completeness_audit(original: DataFrame, splits: DataFrame) -> DataFrame:
    """``path, problem``: rows that are missing from the splits, and rows that are extra there."""
    a, b = original.select("path").distinct(), splits.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, "path", "left_anti").withColumn("problem", F.lit("extra")))


def class_distribution(manifest: DataFrame) -> DataFrame:
    """``label, n`` and whether the label is valid."""
    return manifest.groupBy("label").agg(F.count("*").alias("n")).withColumn("valid", F.coalesce(F.col("label").isin(0, 1), F.lit(False)))


def split_cube(splits: DataFrame) -> DataFrame:
    """``split, label, n`` with totals: null stands for all."""
    return splits.cube("split", "label").agg(F.count("*").alias("n"))


def first_wins(phrases: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """Distinct phrases without regard to case and outer blanks, the first of each by ``order``, up to ``most``."""
    key = F.lower(F.trim("phrase"))
    out = phrases.where(key != "").withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").select(order, F.trim("phrase").alias("phrase"))
    return out.orderBy(order).limit(most) if most is not None else out
