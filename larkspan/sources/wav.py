"""WAV files of 16-bit samples as tables of signals."""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from larkspan.functions.dsp import resample
from larkspan.shipping import ship

#: Suffixes of files that are searched for noise.
NOISE_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a", ".aac", ".wma")


def encode(audio: np.ndarray, rate: int = 16000) -> bytes:
    """Divide by the peak if that exceeds 1, then write 16-bit samples."""
    a = np.asarray(audio, np.float64)
    top = np.abs(a).max(initial=0.0)
    a = a / top if top > 1 else a
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.round(a * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(mean over channels, rate, channels) of a file of 8-, 16- or 32-bit samples."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        a = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        a = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"samples of {width} bytes can't be read")
    return a.reshape(-1, channels).mean(axis=1) if len(a) else a, rate, channels


def encoded(clips: DataFrame) -> DataFrame:
    """``path, content`` of ``clips(path, audio, sample_rate)``."""
    ship(clips.sparkSession)

    @F.pandas_udf("binary")
    def run(a: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([encode(np.asarray(x if x is not None else [], np.float64), int(r)) for x, r in zip(a, rate, strict=True)])

    return clips.select("path", run("audio", "sample_rate").alias("content"))


def decoded(files: DataFrame, rate: int = 16000) -> DataFrame:
    """``path, audio, sample_rate, metadata`` of ``files(path, content)``, as one channel at ``rate``."""
    ship(files.sparkSession)
    shape = "path string, audio array<float>, sample_rate int, metadata struct<original_sr:int,target_sr:int,duration:double,channels:int,filename:string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                a, own, channels = decode(content)
                a = resample(a, own, rate)
                rows.append((path, a, rate, {"original_sr": own, "target_sr": rate, "duration": len(a) / rate, "channels": channels, "filename": path.rsplit("/", 1)[-1]}))
            yield pd.DataFrame(rows, columns=["path", "audio", "sample_rate", "metadata"])

    return files.select("path", "content").mapInPandas(run, shape)


def read_audio(spark: SparkSession, path: str, rate: int = 16000, recursive: bool = False) -> DataFrame:
    """All WAV files under a path or glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", recursive).load(path)
    return decoded(files, rate)


def list_noise(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files under a folder that may hold noise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "[.]") for s in NOISE_SUFFIXES) + ")$"))


def list_impulses(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, length`` of the WAV and FLAC files in a folder, WAV first, by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.lower("path").rlike("[.](wav|flac)$"))
    return files.withColumn("kind", F.when(F.lower("path").endswith(".wav"), 0).otherwise(1)).orderBy("kind", "path")


class _WavWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows) -> WriterCommitMessage:
        """Each file gets its name once it is whole, so a task that runs again leaves no half of one."""
        for r in rows:
            path = os.path.join(self.folder, r["path"])
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            held = f"{path}.{uuid.uuid4().hex}.part"
            with open(held, "wb") as f:
                f.write(encode(np.asarray(r["audio"] or [], np.float64), r["sample_rate"]))
            os.replace(held, path)
        return WriterCommitMessage()


class WavFiles(DataSource):
    """A sink of WAV files, one per row, under a folder that all executors have mounted."""

    @classmethod
    def name(cls) -> str:
        return "larkspan_wav"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WavWriter(self.options["path"])


def write_audio(clips: DataFrame, folder: str) -> None:
    """Write ``clips(path, audio, sample_rate)`` as files ``folder/path``, in parallel on the executors."""
    ship(clips.sparkSession)
    clips.sparkSession.dataSource.register(WavFiles)
    clips.select("path", "audio", "sample_rate").write.format("larkspan_wav").mode("append").option("path", folder).save()
