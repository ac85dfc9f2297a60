from __future__ import annotations

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import manifest
from larkspan.plans import builder, cli, config
from larkspan.schemas import MANIFEST
from larkspan.sources import cache, reports, scoring, synthesis

GOOD = {
    "wake_word": "hey_marvin",
    "samples": {"positives": 12, "negatives_multiplier": 2},
    "tts": {"providers": [{"backend": "kokoro", "voices": ["af_heart", "af_bella"]}, {"backend": "piper", "voices": ["en_US-amy-low"], "speed": 1.2}]},
    "augmentation": {"noise_snr": [-5, 5], "reverb_probability": 0.5, "gain_range": [-40, 0]},
    "output": {"path": "out", "format": ["microwakeword"]},
    "negatives": {"custom_phrases": ["Archer ", "archer", "far away"]},
}


def changed(path, value):
    data = json.loads(json.dumps(GOOD))
    at = data
    for k in path[:-1]:
        at = at.setdefault(k, {}) if isinstance(at, dict) else at[k]
    at[path[-1]] = value
    return data


def test_good_configuration():
    c = config.parse(GOOD)
    assert c.phrases == ("hey marvin",) and c.negatives.custom_phrases == ("Archer", "far away") and len(c.voices) == 3


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (["wake_word"], ""), (["samples", "positives"], 0), (["samples", "negatives_multiplier"], -1), (["samples"], None), (["tts", "providers"], []), (["tts", "providers"], "x"),
        (["tts", "providers", 0, "speed"], 4), (["tts", "providers", 0, "voices"], []), (["tts", "providers", 0, "acceleration"], "migraphx"), (["tts", "providers", 1, "acceleration"], "openvino"),
        (["tts", "providers", 0, "device"], " "), (["augmentation", "noise_snr"], [5, -5]), (["augmentation", "gain_range"], [1]), (["augmentation", "reverb_probability"], 2),
        (["output", "path"], ""), (["output", "format"], ["zip"]), (["output", "format"], []), (["negatives", "custom_phrases"], []), (["negatives", "custom_phrases"], [" "]),
        (["negatives", "confusion"], {"min_similarity": 2}), (["negatives", "synthetic"], {"strategy": "x"}), (["negatives", "synthetic"], {"min_word_count": 5}),
        (["negatives", "synthetic"], {"word_list": []}), (["wake_word_variants"], []), (["wake_word_variants"], [" "]), (["augmentation", "noise_snr"], None),
    ],
)
def test_bad_configurations(path, value):
    with pytest.raises(config.ConfigError):
        config.parse(changed(path, value))


def test_no_source_of_negatives():
    with pytest.raises(config.ConfigError, match="at least one"):
        config.parse(changed(["negatives"], {"confusion": {"enabled": False}, "synthetic": {"enabled": False}}))


def test_build(spark, tmp_path):
    data = changed(["output", "path"], str(tmp_path / "out"))
    made = builder.run(spark, config.parse(data))
    stats = manifest.merge_stats(made.merged).first()
    assert (stats["positives"], stats["negatives"]) == (12, 24)
    assert not manifest.validate(made.merged).count() and not manifest.leak_audit(made.splits).count()
    texts = {r["text"] for r in made.negatives.select("text").collect()}
    assert {"Archer", "far away"} <= texts and len(texts) == 24
    assert {p.name for p in (tmp_path / "out/manifest").iterdir() if p.is_dir()} <= {"split=train", "split=val", "split=test"}


def test_mine_and_append(spark, tmp_path):
    audio = [0.0] * 32000 + [0.9] * 16000 + [0.0] * 32000
    signals = spark.createDataFrame([("s", audio)], "signal_id string, audio array<float>")
    clips = builder.mine(signals, lambda: lambda a: float(np.abs(a).mean()), 0.4)
    assert [(r["clip_name"], r["window_start"]) for r in clips.orderBy("window_start").collect()] == [("s_T1.500.wav", 24000), ("s_T2.500.wav", 40000)]
    mined = builder.mined_manifest(clips, 0.4)
    assert {(r["label"], r["duration_ms"], r["metadata"]["source"]) for r in mined.collect()} == {(0, 1000, "s")}
    (tmp_path / "new.jsonl").write_text('{"path": "a.wav", "label": 0, "duration_ms": 5, "backend": "b"}\n{"path": "t.wav", "label": 0, "duration_ms": 5}\n{"path": "a.wav", "label": 0, "duration_ms": 6}\nbad\n')
    training = spark.createDataFrame([("t.wav", 1, "", "v", None, 7, 16000, {})], MANIFEST)
    errors = builder.append(spark, training, str(tmp_path / "new.jsonl"), str(tmp_path / "merged"))
    assert [r["message"] for r in errors.collect()] == ["Line 4: not JSON"]
    got = spark.read.json(str(tmp_path / "merged")).orderBy("path").collect()
    assert [(r["path"], r["duration_ms"], r["backend"]) for r in got] == [("a.wav", 5, "b"), ("t.wav", 7, None)]
    assert len(list(tmp_path.glob("merged.*.backup"))) == 1
    listing = spark.createDataFrame([("t.wav",)], "path string")
    with pytest.raises(ValueError, match="missing"):
        builder.append(spark, training, str(tmp_path / "new.jsonl"), str(tmp_path / "again"), listing=listing)
    assert not (tmp_path / "again").exists()


def test_synthesis(spark):
    df = spark.createDataFrame([("a", "hi there", "af_heart", "kokoro", 1.0), ("b", "x", "nobody", "kokoro", 1.0), ("c", "x", "v", "nothing", 1.0), ("d", "", "v", "tones", 1.0)], "path string, text string, voice string, backend string, speed double")
    got = {r["path"]: r for r in synthesis.synthesize(df).collect()}
    assert len(got["a"]["audio"]) == 8 * 960 and got["a"]["duration_ms"] == 480 and max(map(abs, got["a"]["audio"])) <= 1
    assert "nobody" in got["b"]["error"] and "nothing" in got["c"]["error"] and got["d"]["audio"] == []
    assert got["a"]["audio"] == synthesis.get("kokoro").synthesize("hi there", "af_heart", 1.0).tolist()
    assert len(synthesis.KOKORO_VOICES) == 28 and len(synthesis.PIPER_VOICES) == 29
    synthesis.register("own", lambda **o: synthesis.Tones())
    assert "own" in synthesis.backends()
    synthesis.unregister("own")
    with pytest.raises(KeyError):
        synthesis.get("own")


def test_cache(spark):
    entries = spark.createDataFrame([("a", 40, 1), ("b", 40, 3), ("c", 40, 2)], "key string, bytes long, last_access long")
    assert sorted(r["key"] for r in cache.keep_recent(entries, 80).collect()) == ["b", "c"]
    again = cache.touch(entries, spark.createDataFrame([("a", 40, 9)], entries.schema))
    assert sorted(r["key"] for r in cache.keep_recent(again, 80).collect()) == ["a", "b"]
    key = spark.range(1).select(cache.cache_key(F.lit("hi"), F.lit("v"), F.lit("b"), F.lit(1.0)).alias("k")).first()["k"]
    import hashlib

    assert key == hashlib.sha256(b"v3\0hi\0v\0b\x001.0\0{}").hexdigest()


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([(0.5, 0.1)], "far double, frr double")
    now = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
    data = json.loads(reports.render(report, "json", {"k": "v"}, str(tmp_path / "x/r.json"), now))
    assert data["far"] == 0.5 and data["metadata"] == {"k": "v"} and (tmp_path / "x/r.json").exists()
    assert reports.render(report, "csv", {"k": "v"}, now=now).splitlines()[:2] == ["key,value", "far,0.5"]
    assert "| frr | 0.1 |" in reports.render(report, "markdown", now=now)
    with pytest.raises(ValueError, match="unknown format"):
        reports.render(report, "xml")


def test_scores_come_from_the_model(spark):
    windows = spark.createDataFrame([(1, 0, 2, 0.0, [1.0, 3.0])], "signal_id long, window_start long, window_end long, timestamp double, samples array<float>")
    assert scoring.score(windows, lambda: lambda a: float(a.sum())).first()["prediction"] == 4.0


def field(number, value):
    """A field of a protocol buffer: a number, or bytes."""
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)
    return size(number << 3) + size(value) if isinstance(value, int) else size(number << 3 | 2) + size(len(value)) + value


def test_onnx_model(spark):
    """A model of one node, the mean of its input, written by hand."""
    pytest.importorskip("onnxruntime")
    shape = field(2, field(1, field(1, 1)) + field(1, field(2, b"n")))
    tensor = lambda name: field(1, name) + field(2, field(1, field(1, 1) + shape))
    out = field(1, b"y") + field(2, field(1, field(1, 1)))
    node = field(1, b"x") + field(2, b"y") + field(4, b"ReduceMean") + field(5, field(1, b"keepdims") + field(3, 0) + field(20, 2))
    model = field(1, 7) + field(7, field(1, node) + field(2, b"g") + field(11, tensor(b"x")) + field(12, out)) + field(8, field(2, 13))
    assert scoring.onnx_model(model)(np.array([1.0, 2.0, 6.0])) == 3.0
    windows = spark.createDataFrame([(1, 0, 2, 0.0, [1.0, 3.0])], "signal_id long, window_start long, window_end long, timestamp double, samples array<float>")
    assert scoring.score(windows, lambda: scoring.onnx_model(model)).first()["prediction"] == 2.0


def test_command_line(tmp_path):
    import yaml

    (tmp_path / "good.yaml").write_text(yaml.safe_dump(GOOD))
    (tmp_path / "bad.yaml").write_text("wake_word: x\n")
    assert cli.main(["validate", str(tmp_path / "good.yaml")]) == 0
    assert cli.main(["validate", str(tmp_path / "bad.yaml")]) == 2
    assert cli.main(["validate", str(tmp_path / "none.yaml")]) == 2


def test_merge_wants_lines_of_json(spark):
    assert cli.main(["merge", "a", "b.csv", "c"]) == 2


def test_streamed_cooldown(spark, tmp_path):
    from larkspan.streaming import cooldown as streaming

    shape = "stream_id long, frame long, prediction double"
    spark.createDataFrame([(1, f, 0.9) for f in (0, 3, 4, 9)] + [(2, 1, 0.1)], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.kept_hits(stream, 0.5, 5).writeStream.format("memory").queryName("kept_hits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(1, f, 0.9) for f in (10, 14)], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        assert sorted(r["frame"] for r in spark.table("kept_hits").collect()) == [0, 9, 14]
    finally:
        query.stop()
