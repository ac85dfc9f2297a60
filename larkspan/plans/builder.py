"""Dataset builds: phrases, synthesis, merge, split and files; and the loop of mining hard negatives."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.phonetics import confusions
from larkspan.functions.phrases import TOPICS, file_name, synthetic_negatives
from larkspan.operators import manifest as M
from larkspan.operators.assignment import SPLIT_SHARES, allocate, assign_groups, combinations, deal, execution_order, split_rows
from larkspan.operators.cooldown import select_kept
from larkspan.operators.windows import clip_names, sliding_windows
from larkspan.plans.config import Config
from larkspan.sources.jsonl import read_tolerant, write_manifest
from larkspan.sources.scoring import Model, score
from larkspan.sources.synthesis import synthesize

#: Words for random negatives where a caller brings none.
VOCABULARY = ("open", "close", "window", "music", "morning", "coffee", "yellow", "seven", "garden", "listen", "quick", "table", "river", "summer", "paper", "begin", "orange", "circle", "follow", "winter")


@dataclass(frozen=True)
class Build:
    """The tables of a build; nothing runs until one is used."""

    positives: DataFrame
    negatives: DataFrame
    merged: DataFrame
    splits: DataFrame

    def summary(self) -> DataFrame:
        return M.split_cube(self.splits)


def _providers(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(k, p.backend, list(p.voices), p.speed, p.acceleration) for k, p in enumerate(config.providers)]
    return spark.createDataFrame(rows, "provider_pos int, backend string, voices array<string>, speed double, acceleration string")


def _requests(config: Config, rows: DataFrame, providers: DataFrame, variants: DataFrame) -> DataFrame:
    """Deal voices to rows ``position, phrase`` in turn."""
    combos = combinations(variants, providers).select("combo", "backend", "voice")
    told = providers.select("backend", F.explode("voices").alias("voice"), "speed", "acceleration").dropDuplicates(["backend", "voice"])
    return deal(rows, "position", combos).join(F.broadcast(told), ["backend", "voice"])


def positive_requests(spark: SparkSession, config: Config) -> DataFrame:
    """``samples.positives`` requests over all variants, providers and voices in turn."""
    phrases = spark.createDataFrame(list(enumerate(config.phrases)), "variant_pos int, phrase string")
    providers = _providers(spark, config)
    crossed = combinations(phrases, providers)
    told = providers.select("backend", F.explode("voices").alias("voice"), "speed", "acceleration").dropDuplicates(["backend", "voice"])
    rows = deal(spark.range(config.samples.positives).select(F.col("id").alias("position")), "position", crossed).join(F.broadcast(told), ["backend", "voice"])
    name = file_name(F.lit(config.wake_word.replace(" ", "_")), F.col("voice"), F.col("position"))
    return rows.select("position", F.col("phrase").alias("text"), "voice", "backend", "speed", "acceleration", F.concat(F.lit("positives/"), name).alias("path"))


def negative_phrases(spark: SparkSession, config: Config, total: int, vocabulary: tuple[str, ...] = VOCABULARY, seed: int = 42) -> DataFrame:
    """``position, phrase``: custom ones, then confusions and synthetic ones by weight, distinct, filled up from the heavier source first."""
    own = config.negatives
    given = own.custom_phrases or ()
    custom = spark.createDataFrame([(k, p) for k, p in enumerate(given[:total])], "k int, phrase string")
    left, weights = max(0, total - len(given)), [(n, float(w)) for n, w in own.sources]
    share = {r["source"]: r["n"] for r in allocate(spark.createDataFrame(weights, "source string, weight double"), left).collect()}
    source = spark.createDataFrame([(p,) for p in config.phrases], "phrase string")
    chosen = {t: TOPICS[t] for t in own.synthetic.topics or TOPICS if t in TOPICS} or TOPICS
    made = {
        # All of a source's phrases are made once; its share comes first and the rest serves to fill up.
        "confusion": confusions(source, left, own.confusion.min_similarity).select(F.col("rank").alias("k"), F.col("confusion").alias("phrase")),
        "synthetic": synthetic_negatives(spark, list(own.synthetic.word_list or vocabulary), config.wake_word, left, own.synthetic.min_word_count, own.synthetic.max_word_count, own.synthetic.strategy, topics=chosen, seed=seed).select(F.col("position").alias("k"), "phrase"),
    }
    rows = custom.select(F.lit(0).alias("stage"), F.lit(0).alias("order"), "k", "phrase")
    for order, (name, _) in enumerate(sorted(weights, key=lambda x: -x[1]), 1):
        number = F.row_number().over(Window.orderBy("k", "phrase"))
        ranked = made[name].withColumn("k", number)
        rows = rows.unionByName(ranked.select(F.when(F.col("k") <= share.get(name, 0), 1).otherwise(2).alias("stage"), F.lit(order).alias("order"), "k", "phrase"))
    placed = rows.withColumn("position", F.row_number().over(Window.orderBy("stage", "order", "k", "phrase")))
    return M.first_wins(placed.select("position", "phrase"), "position", total)


def _clips(requests: DataFrame, label: int) -> DataFrame:
    """Manifest rows of synthesised requests; failed ones are left out."""
    made = synthesize(execution_order(requests)).where("error is null").select("path", "duration_ms", "sample_rate")
    return requests.join(made, "path").select("path", F.lit(label).alias("label"), "text", "voice", "backend", "duration_ms", "sample_rate")


def build(spark: SparkSession, config: Config, seed: int = 42, shares: tuple[float, float, float] = SPLIT_SHARES) -> Build:
    """The tables from configuration to splits."""
    target = int(config.samples.positives * config.samples.negatives_multiplier)
    positives = _clips(positive_requests(spark, config), 1)
    phrases = negative_phrases(spark, config, target, seed=seed)
    variant = spark.createDataFrame([(0, "")], "variant_pos int, phrase string")
    dealt = _requests(config, phrases, _providers(spark, config), variant)
    named = F.concat(F.lit("negatives/"), F.format_string("negative_%06d.wav", "position"))
    negatives = _clips(dealt.select("position", F.col("phrase").alias("text"), "voice", "backend", "speed", "acceleration", named.alias("path")), 0)
    merged = M.merge(positives, negatives, None, seed).drop("origin")
    return Build(positives, negatives, merged, split_rows(merged, assign_groups(merged, shares, seed)))


def run(spark: SparkSession, config: Config, seed: int = 42) -> Build:
    """Build and write the splits."""
    made = build(spark, config, seed)
    write_manifest(made.splits, f"{config.output.path}/manifest", by_split=True)
    return made


def mine(signals: DataFrame, load: Callable[[], Model], threshold: float = 0.7, window: int = 16000, hop: int = 8000, cooldown_seconds: float = 1.0, rate: int = 16000) -> DataFrame:
    """Clips of windows scored above the threshold, after the cooldown: ``signal_id, clip_name, timestamp, prediction, window_start, window_end, audio``."""
    predictions = score(sliding_windows(signals, window, hop, rate), load)
    hits = predictions.where(F.col("prediction") > threshold)
    kept = select_kept(hits, ["signal_id"], "timestamp", cooldown_seconds, "window_start")
    chosen = hits.join(kept.select("signal_id", "window_start"), ["signal_id", "window_start"])
    cut = chosen.join(signals, "signal_id").withColumn("audio", F.slice("audio", (F.col("window_start") + 1).cast("int"), (F.col("window_end") - F.col("window_start")).cast("int")))
    return clip_names(cut.withColumn("stem", F.col("signal_id").cast("string"))).select("signal_id", "clip_name", "timestamp", "prediction", "window_start", "window_end", "audio")


def mined_manifest(clips: DataFrame, threshold: float, rate: int = 16000) -> DataFrame:
    """Negatives without text, with where they come from as metadata."""
    seconds = F.size("audio") / F.lit(float(rate))
    source = F.create_map(F.lit("source"), F.col("signal_id").cast("string"), F.lit("timestamp"), F.col("timestamp").cast("string"), F.lit("prediction"), F.col("prediction").cast("string"), F.lit("threshold"), F.lit(str(threshold)))
    return clips.select(F.col("clip_name").alias("path"), F.lit(0).alias("label"), F.lit("").alias("text"), (seconds * 1000).cast("int").alias("duration_ms"), F.lit(rate).alias("sample_rate"), source.alias("metadata"))


def append(spark: SparkSession, training: DataFrame, new_path: str, out: str, backup: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """Write training rows and the good, new rows of a file of JSON lines to ``out``; returns what was wrong with the others.

    ``out`` is another folder than the one ``training`` is read from; ``backup`` keeps a dated copy of the old rows
    beside it. With a ``listing(path)`` of files, rows without a file are errors, and more of them than good rows abort
    the whole. Nothing is written if nothing is new.
    """
    good, errors = read_tolerant(spark, new_path)
    if listing is not None:
        missing = M.missing_files(good, listing)
        good = good.join(listing.select("path").distinct(), "path", "left_semi")
        if missing.count() > good.count():
            raise ValueError("more files are missing than there are good rows")
        errors = errors.unionByName(missing.select("line", F.format_string("Line %d: no file %s", "line", "path").alias("message")))
    fresh = M.append_new(training, good, "line").drop("line")
    if fresh.limit(1).count():
        if backup:
            stamp = datetime.datetime.now(datetime.UTC).strftime("%Y%m%d_%H%M%S")
            training.write.mode("error").json(f"{out.rstrip('/')}.{stamp}.backup")
        columns = ["path", "label", "text", "voice", "backend", "duration_ms", "sample_rate"]
        write_manifest(training.select(columns).unionByName(fresh.select(columns)), out)
    return errors
