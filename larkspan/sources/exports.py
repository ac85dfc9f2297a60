"""Exports for trainers: ragged arrays with offsets and dense matrices, and their checks.

Exports are tables: one row per clip, with its place in the flat data. ``dump_*`` write the binary files that
trainers map into memory; that is one writer's work, row by row, and holds one row at a time.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.windows import running_offsets


def ragged(clips: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Add ``size, start, end`` of each clip's samples within its group."""
    return running_offsets(clips.withColumn("size", F.size("audio").cast("long")), "size", order, by)


def ragged_slices(flat: DataFrame, index: DataFrame) -> DataFrame:
    """The clips again: ``flat(split, data)`` cut by ``index(split, position, start, end, label)``."""
    return index.join(flat, "split").select("split", "position", "label", F.slice("data", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("audio"))


def dense(clips: DataFrame, length: int | None, order: str) -> DataFrame:
    """``position, values, label``: samples padded or cut to ``length``, or padded to the longest."""
    size = F.size("audio")
    rows = clips.withColumn("__size", size)
    if length is None:
        longest = rows.agg(F.max("__size").alias("__target"))
        rows = rows.join(F.broadcast(longest), F.lit(True))
    else:
        rows = rows.withColumn("__target", F.lit(length))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.col("__target") - F.col("__size")))
    return rows.select(F.col(order).alias("position"), F.slice(F.concat(F.transform("audio", lambda x: x.cast("float")), zeros), F.lit(1), F.col("__target")).alias("values"), "label")


def dump_ragged(clips: DataFrame, folder: str, split: str, order: str) -> int:
    """Write ``{split}_data.mmap`` (float32), ``{split}_indices.npy`` (int64, n x 2) and ``{split}_labels.npy`` (int32); returns the number of clips."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    index, labels, at = [], [], 0
    with (top / f"{split}_data.mmap").open("wb") as out:
        for r in clips.select("audio", "label", order).orderBy(order).toLocalIterator():
            a = np.asarray(r["audio"], np.float32)
            out.write(a.tobytes())
            index.append((at, at + len(a)))
            labels.append(r["label"])
            at += len(a)
    np.save(top / f"{split}_indices.npy", np.array(index, np.int64).reshape(-1, 2))
    np.save(top / f"{split}_labels.npy", np.array(labels, np.int32))
    return len(labels)


def load_ragged(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``position, label, audio`` of a ragged export; an empty data file is no clips."""
    top = Path(folder)
    index, labels = np.load(top / f"{split}_indices.npy"), np.load(top / f"{split}_labels.npy")
    data = np.fromfile(top / f"{split}_data.mmap", np.float32)
    if len(index) != len(labels):
        raise ValueError(f"{len(index)} indices but {len(labels)} labels")
    rows = [(k, int(label), data[a:b].tolist()) for k, ((a, b), label) in enumerate(zip(index.tolist(), labels.tolist(), strict=True))]
    return spark.createDataFrame(rows, "position long, label int, audio array<float>")


def dump_dense(matrix: DataFrame, folder: str, split: str) -> tuple[int, ...]:
    """Write ``X_{split}.npy`` (float32) and ``y_{split}.npy`` (int64)."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    rows = [(r["values"], r["label"]) for r in matrix.orderBy("position").toLocalIterator()]
    x = np.array([v for v, _ in rows], np.float32)
    np.save(top / f"X_{split}.npy", x)
    np.save(top / f"y_{split}.npy", np.array([y for _, y in rows], np.int64))
    return x.shape


def load_dense(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``position, values, label`` of a dense export of samples; shapes, lengths and labels that don't fit are an error."""
    top = Path(folder)
    x, y = np.load(top / f"X_{split}.npy"), np.load(top / f"y_{split}.npy")
    if x.ndim < 2:
        raise ValueError(f"X has {x.ndim} dimensions; at least 2 are needed")
    if len(x) != len(y):
        raise ValueError(f"{len(x)} rows but {len(y)} labels")
    if not set(np.unique(y).tolist()) <= {0, 1}:
        raise ValueError("labels other than 0 and 1")
    rows = [(k, v, int(label)) for k, (v, label) in enumerate(zip(x.reshape(len(x), -1).tolist(), y, strict=True))]
    return spark.createDataFrame(rows, "position long, values array<float>, label int")


def dump_features(features: DataFrame, folder: str, split: str, order: str) -> int:
    """Ragged features ``mel(bands x frames), label, seconds``: data, indices (n x 2, in values), labels, durations in milliseconds and shape; returns the number of clips."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    index, labels, durations, at, bands = [], [], [], 0, 40
    with (top / f"{split}_data.mmap").open("wb") as out:
        for r in features.select("mel", "label", "seconds", order).orderBy(order).toLocalIterator():
            m = np.asarray(r["mel"], np.float32)
            bands = len(m) or bands
            out.write(m.tobytes())
            index.append((at, at + m.size))
            labels.append(r["label"])
            durations.append(int(r["seconds"] * 1000))
            at += m.size
    np.save(top / f"{split}_indices.npy", np.array(index, np.int64).reshape(-1, 2))
    np.save(top / f"{split}_labels.npy", np.array(labels, np.int32))
    np.save(top / f"{split}_durations.npy", np.array(durations, np.int64))
    np.save(top / f"{split}_shape.npy", np.array([at // bands, bands], np.int64))
    return len(labels)


def check_ragged(index: DataFrame, data_size: int | None = None) -> DataFrame:
    """``rule, severity, message, n`` for each broken rule of ``index(start, end, label)``, in one pass."""
    rules = [
        ("bounds", "error", "an end before its start", F.col("end") < F.col("start")),
        ("range", "error", "an index beyond the data", (F.col("start") < 0) | (F.col("end") > (data_size if data_size is not None else F.lit(2**62)))),
        ("labels", "error", "a label other than 0 and 1", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        ("empty", "warning", "a clip without samples", F.col("end") == F.col("start")),
    ]
    return _broken(index, rules)


def check_dense(matrix: DataFrame) -> DataFrame:
    """The same for ``matrix(position, values, label)``: widths, numbers and labels, and a note if a class is missing."""
    rules = [
        ("nan", "error", "a value that is no number", F.exists("values", lambda x: F.isnan(x))),
        ("infinity", "error", "an infinite value", F.exists("values", lambda x: F.abs(x) == float("inf"))),
        ("labels", "error", "a label other than 0 and 1", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        ("empty", "error", "a row without values", F.size("values") == 0),
    ]
    whole = [
        ("widths", "error", "rows of different widths", F.greatest(F.lit(0), F.count_distinct(F.size("values")) - 1)),
        ("classes", "warning", "a class without rows", F.lit(2) - F.count_distinct(F.when(F.col("label").isin(0, 1), F.col("label")))),
    ]
    return _broken(matrix, rules, whole)


def _broken(rows: DataFrame, rules: list, whole: list = ()) -> DataFrame:
    counts = rows.agg(*[F.count_if(c).cast("long").alias(f"c{k}") for k, (*_, c) in enumerate(rules)], *[c.cast("long").alias(f"w{k}") for k, (*_, c) in enumerate(whole)])
    said = [F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(m).alias("message"), F.col(f"{p}{k}").alias("n")) for p, own in (("c", rules), ("w", whole)) for k, (r, s, m, _) in enumerate(own)]
    return counts.select(F.explode(F.array(*said)).alias("x")).select("x.*").where("n > 0")
