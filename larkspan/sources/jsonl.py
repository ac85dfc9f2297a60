"""Manifests as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.manifest import validate
from larkspan.schemas import DEFAULT_RATE, MANIFEST, MANIFEST_DEFAULTS
from larkspan.tables import Workspace, lookup


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read with defaults for missing keys; unknown keys are dropped, blank lines skipped, and a bad line fails the load."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in MANIFEST_DEFAULTS.items()} | {"metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def sparse(manifest: DataFrame) -> DataFrame:
    """What is written: defaults become null, and null keys aren't written."""
    return manifest.select(
        "path", "label", "text",
        *[c for c in ("voice", "backend") if c in manifest.columns],
        F.nullif("duration_ms", F.lit(0)).alias("duration_ms"),
        F.nullif("sample_rate", F.lit(DEFAULT_RATE)).alias("sample_rate"),
        *([F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata")] if "metadata" in manifest.columns else []),
        *[c for c in ("split",) if c in manifest.columns],
    )


def write_manifest(manifest: DataFrame, path: str, by_split: bool = False) -> None:
    """Validate all rows, then write; nothing is written if a row breaks a rule. The writer's commit leaves the old files until the new are whole."""
    wrong = validate(manifest).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['path']}: {r['message']}" for r in wrong))
    writer = sparse(manifest).write.mode("overwrite").option("ignoreNullFields", True)
    (writer.partitionBy("split") if by_split else writer).json(path)


def read_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with ``line``, and ``line, message`` of the others. Lines are numbered per file, from 1, blank ones included.

    Files are read in splits. A line's number is its place in its split, as tasks number rows in reading order, and the
    lines of the file's splits before.
    """
    ws = Workspace(spark, "tolerant")
    read = spark.read.option("lineSep", "\n").text(path)
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    text = ws.table(read.select(F.regexp_replace("value", "\r$", "").alias("raw"), *split, F.monotonically_increasing_id().alias("__id")), "lines")
    splits = text.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__first")).alias("__add"))
    numbered = text.where(F.trim("raw") != "").join(lookup(offsets), ["__file", "__start"])
    lines = numbered.select((F.col("__id") + F.col("__add")).alias("line"), F.from_json("raw", MANIFEST, {"mode": "PERMISSIVE"}).alias("m"), F.try_parse_json("raw").alias("v"))
    problem = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(F.coalesce(F.col("m.path"), F.lit("")) == "", "path is missing")
        .when(~F.coalesce(F.col("m.label"), F.lit(0)).isin(0, 1), "label must be 0 or 1")
        .when(F.coalesce(F.col("m.duration_ms"), F.lit(0)) < 0, "duration_ms must not be negative")
        .when(F.coalesce(F.col("m.sample_rate"), F.lit(DEFAULT_RATE)) <= 0, "sample_rate must be positive")
    )
    judged = lines.withColumn("problem", problem)
    good = judged.where("problem is null").select("line", "m.*")
    good = good.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in MANIFEST_DEFAULTS.items()})
    return good, judged.where("problem is not null").select("line", F.format_string("Line %d: %s", "line", "problem").alias("message"))
