"""Scoring of windows by a model: any function of a signal, or an ONNX file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from larkspan.shipping import ship

Model = Callable[[np.ndarray], float]
_sessions: dict[bytes, object] = {}


def onnx_model(content: bytes) -> Model:
    """A function from a signal to the mean of the model's first output; one session per worker. The signal goes to the first input as one batch of float32."""
    import onnxruntime

    if content not in _sessions:
        _sessions.clear()
        _sessions[content] = onnxruntime.InferenceSession(content, providers=["CPUExecutionProvider"])
    session = _sessions[content]
    name = session.get_inputs()[0].name
    return lambda a: float(np.mean(session.run(None, {name: np.asarray(a, np.float32)[None]})[0]))


def score(windows: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``signal_id, timestamp, prediction, window_start, window_end`` of ``windows(signal_id, window_start, window_end, timestamp, samples)``; ``load`` makes the model once per task."""
    ship(windows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            out = part[["signal_id", "timestamp"]].copy()
            out["prediction"] = [float(model(np.asarray(a, np.float32))) for a in part["samples"]]
            yield out.assign(window_start=part["window_start"], window_end=part["window_end"])

    kind = dict(windows.dtypes)["signal_id"]
    return windows.mapInPandas(run, f"signal_id {kind}, timestamp double, prediction double, window_start long, window_end long")
