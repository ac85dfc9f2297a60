"""Augmentation of clips with material from tables: noises and impulse responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import dsp, signal
from larkspan.functions.draws import integer, uniform


def _picked(clips: DataFrame, bank: DataFrame, purpose: str, seed: int) -> DataFrame:
    """Each clip with one row ``__bank`` of a bank ``k, audio`` numbered from 0, by a draw on its path.

    The bank is a library of recordings that a configuration names, a few hundred at most, and is sent to all workers.
    """
    size = bank.agg(F.count("*").alias("__n"))
    numbered = clips.join(F.broadcast(size), F.lit(True)).withColumn("__k", integer(seed, purpose, F.col("path"), F.col("__n")))
    return numbered.join(F.broadcast(bank.select(F.col("k").alias("__k"), F.col("audio").alias("__bank"))), "__k", "left").drop("__n", "__k")


def add_noise(clips: DataFrame, noises: DataFrame, low: float = 0.0, high: float = 20.0, p: float = 1.0, seed: int = 42, compat: bool = False) -> DataFrame:
    """Mix a drawn noise into each ``clips(path, audio, ...)`` at a drawn ratio, with probability ``p``; without noises clips stay as they are."""
    key = F.col("path")
    snr = F.lit(low) + uniform(seed, "noise snr", key) * (high - low)
    mixed = signal.mix_at_snr(F.col("audio"), F.col("__bank"), snr, compat)
    wanted = (uniform(seed, "noise?", key) <= p) & F.col("__bank").isNotNull()
    return _picked(clips, noises, "noise", seed).withColumn("audio", F.when(wanted, mixed).otherwise(F.transform("audio", lambda x: x.cast("float")))).drop("__bank")


def add_reverb(clips: DataFrame, impulses: DataFrame, p: float = 0.5, seed: int = 42) -> DataFrame:
    """Convolve each clip with a drawn impulse response, with probability ``p``."""

    def run(a, impulse, wanted):
        return dsp.reverberate(a, impulse) if wanted and impulse is not None else a.astype("float32")

    chosen = _picked(clips, impulses, "impulse", seed)
    return chosen.withColumn("audio", dsp.over_audio(run)(F.col("audio"), F.col("__bank"), uniform(seed, "reverb?", F.col("path")) <= p)).drop("__bank")
