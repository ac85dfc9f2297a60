"""Greedy cooldown and running scores on streams.

The state of a stream is the position of the last kept hit. Frames of one micro-batch are sorted; a frame that
comes in a later batch than its successors is judged by the state then: order across batches is the source's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspan.shipping import ship


def kept_hits(scores: DataFrame, threshold: float, gap: int) -> DataFrame:
    """``stream_id, frame, prediction`` of kept hits, for a streaming ``scores(stream_id, frame, prediction)``."""
    if gap < 1:
        raise ValueError(f"the cooldown must be at least 1, got {gap}")
    ship(scores.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("frame")
        keep = []
        for frame in rows["frame"]:
            keep.append(last is None or frame - last >= gap)
            last = int(frame) if keep[-1] else last
        if last is not None:
            state.update((last,))
        yield rows.loc[keep, ["stream_id", "frame", "prediction"]]

    hits = scores.where(F.col("prediction") > threshold).select("stream_id", "frame", "prediction")
    return hits.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, frame long, prediction double", "last long", "append", GroupStateTimeout.NoTimeout)


def hits_per_window(scores: DataFrame, threshold: float, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``window, stream_id, hits, positives`` by event time ``ts``; rows later than ``late`` are dropped by the watermark."""
    return scores.withWatermark("ts", late).groupBy(F.window("ts", width), "stream_id").agg(F.count_if(F.col("prediction") > threshold).alias("hits"), F.count_if(F.col("ground_truth") == 1).alias("positives"))
