"""Schemas of the data that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("voice", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: What a missing key means when a manifest is read.
MANIFEST_DEFAULTS = {"path": "", "label": 0, "text": "", "duration_ms": 0, "sample_rate": 16000}
DEFAULT_RATE = 16000

AUDIO = T.StructType([T.StructField("path", T.StringType()), T.StructField("audio", T.ArrayType(T.FloatType())), T.StructField("sample_rate", T.IntegerType())])
AUDIO_METADATA = T.StructType([T.StructField("original_sr", T.IntegerType()), T.StructField("target_sr", T.IntegerType()), T.StructField("duration", T.DoubleType()), T.StructField("channels", T.IntegerType()), T.StructField("filename", T.StringType())])
SCORES = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("prediction", T.DoubleType()), T.StructField("ground_truth", T.IntegerType())])
WINDOW_PREDICTION = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("prediction", T.DoubleType()), T.StructField("window_start", T.LongType()), T.StructField("window_end", T.LongType())])
