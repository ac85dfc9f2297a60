"""The driver's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of the recordings behind ``scores``.
HOURS = 720.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_id, frame, prediction, ground_truth, seconds, event_id``: a stream for each user of ``events``, frames in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        (F.col("value") / (F.col("value") + 50.0)).alias("prediction"),
        (F.col("event_type") == "purchase").cast("int").alias("ground_truth"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1000000.0).alias("seconds"),
        "event_id",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as clips: the source speaks, the language is the backend, characters are milliseconds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"),
        F.col("quality").cast("int").alias("label"),
        "text",
        F.col("source").alias("voice"),
        F.col("lang").alias("backend"),
        F.col("n_chars").cast("int").alias("duration_ms"),
        F.lit(16000).alias("sample_rate"),
        F.col("doc_id").alias("position"),
        F.col("toxic").cast("int").alias("toxic"),
    )


def flawed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with flaws put in by the id, for validation."""
    m = manifest(spark, sf_dir)
    i = F.col("position")
    return m.withColumns(
        {
            "path": F.when(i % 11 == 0, "").when(i % 13 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path")),
            "label": F.when(i % 17 == 0, 2).otherwise(F.col("label")),
            "duration_ms": F.when(i % 19 == 0, 0).when(i % 23 == 0, -1).otherwise(F.col("duration_ms")),
            "sample_rate": F.when(i % 29 == 0, 0).otherwise(F.col("sample_rate")),
        }
    )


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("clips/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.col("embedding").alias("audio"), (F.col("label") == 0).cast("int").alias("label"), F.lit(16000).alias("sample_rate"), F.col("vec_id").alias("position"), F.col("label").alias("class"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of up to 64 clips each: clips of one class and one block of ids, in order."""
    e = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 640) * 10 + F.col("label")).cast("long").alias("signal_id"), "vec_id", "embedding")
    ordered = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    return e.groupBy("signal_id").agg(F.flatten(F.transform(ordered, lambda s: s["embedding"])).alias("audio"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position, phrase``: the words of each benchmark item, letters only, in lower case, in phrases of three; the last may be shorter."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")).where(F.size("words") > 0)
    starts = F.posexplode(F.sequence(F.lit(1), F.size("words"), F.lit(3)))
    return items.select("item_id", "words", starts.alias("piece", "start")).select((F.col("item_id") * 1_000_000 + F.col("piece")).alias("position"), F.array_join(F.slice("words", F.col("start"), F.lit(3)), " ").alias("phrase"))
