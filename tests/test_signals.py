from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import dsp, signal, transforms
from larkspan.operators import windows
from larkspan.sources import exports, wav


def starts(n, window, hop):
    if n <= window:
        return [0]
    out = list(range(0, n - window + 1, hop))
    return out if out[-1] + window >= n else [*out, n - window]


@pytest.mark.parametrize(("n", "wanted"), [(41000, [0, 8000, 16000, 24000, 25000]), (40000, [0, 8000, 16000, 24000]), (8000, [0]), (0, [0]), (16000, [0])])
def test_window_starts(spark, n, wanted):
    assert starts(n, 16000, 8000) == wanted
    assert spark.range(1).select(windows.window_starts(F.lit(n).cast("long"), 16000, 8000).alias("s")).first()["s"] == wanted


def test_short_signal_is_padded_but_ends_with_the_signal(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "signal_id long, audio array<float>")
    r = windows.sliding_windows(df, 5, 2).first()
    assert (r["window_start"], r["window_end"], r["samples"]) == (0, 3, [1.0, 2.0, 3.0, 0.0, 0.0])
    for bad in ((0, 1, None), (1, 0, None), (1, 1, 0)):
        with pytest.raises(ValueError, match="positive"):
            windows.check_windows(*bad)


def test_compatible_gaps(spark):
    size, chunk, window, hop = 90 * 16000, 30 * 16000, 16000, 8000
    got = spark.range(1).select(windows.gapped_starts(F.lit(size).cast("long"), window, hop, chunk).alias("s")).first()["s"]
    covered = np.zeros(size, bool)
    for s in got:
        covered[s : s + window] = True
    edges = np.flatnonzero(np.diff(covered.astype(int))) + 1
    assert edges.tolist() == [464000, 480000, 944000, 960000]


def apply(spark, audio, transform):
    df = spark.createDataFrame([("k", [float(x) for x in audio])], "key string, audio array<float>")
    return np.array(df.select(transform(F.col("audio"), F.col("key")).alias("a")).first()["a"])


def test_fixed_sizes(spark):
    a = np.arange(1, 6)
    assert apply(spark, a, signal.fixed_size(8)).tolist() == [1, 2, 3, 4, 5, 0, 0, 0]
    assert apply(spark, a, signal.fixed_size(8, "center")).tolist() == [0, 1, 2, 3, 4, 5, 0, 0]
    assert apply(spark, a, signal.fixed_size(3)).tolist() == [1, 2, 3]
    assert apply(spark, a, signal.fixed_size(2, "center")).tolist() == [2, 3]
    assert apply(spark, a, signal.fixed_size(3, "pad_only")).tolist() == [1, 3, 5]
    assert len(apply(spark, a, signal.fixed_size(9, jitter=True))) == 9
    assert apply(spark, [], signal.fixed_size(2)).tolist() == [0, 0]
    with pytest.raises(ValueError, match="unknown mode"):
        signal.fixed_size(3, "other")


def test_snr_is_reached(spark):
    rng = np.random.default_rng(0)
    a, n = rng.normal(0, 0.05, 4000), rng.normal(0, 0.3, 900)
    df = spark.createDataFrame([(a.tolist(), n.tolist())], "a array<double>, n array<double>")
    mixed = np.array(df.select(signal.mix_at_snr(F.col("a"), F.col("n"), F.lit(6.0)).alias("m")).first()["m"])
    assert 10 * np.log10((a**2).mean() / ((mixed - a) ** 2).mean()) == pytest.approx(6.0, abs=0.01)
    assert np.allclose(dsp.mix(a, np.tile(n, 5)[:4000], 6.0), mixed, atol=1e-6)


def test_limits_and_peaks(spark):
    assert apply(spark, [2, -4, 1], lambda a, k: signal.normalise(a)).tolist() == [0.5, -1.0, 0.25]
    assert apply(spark, [0.5], lambda a, k: signal.normalise(a)).tolist() == [0.5]
    assert apply(spark, [2, -4], signal.hard_clip()).tolist() == [1, -1]
    assert np.allclose(apply(spark, [0.3], signal.soft_clip(0.5)), np.tanh(0.6) * 0.5)
    with pytest.raises(ValueError, match="below"):
        signal.hard_clip(1, 0)
    with pytest.raises(ValueError, match="threshold"):
        signal.soft_clip(0)


def test_reverberation_time(spark):
    impulse = [0.0, 1.0, 0.5, 0.002, 0.0005, 0.0]
    df = spark.createDataFrame([(impulse,), ([],), ([0.0, 0.0],)], "a array<double>")
    assert [r["t"] for r in df.select(signal.rt60(F.col("a")).alias("t")).collect()] == [6 / 16000, 0.0, 0.0]


def test_convolution_and_filters():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=100), rng.normal(size=9)
    assert np.allclose(dsp.convolve(a, b), np.convolve(a, b))
    assert np.allclose(dsp.reverberate(a * 0.01, [1.0]), a * 0.01, atol=1e-6)
    assert np.abs(dsp.reverberate(a, b)).max() <= 0.92
    white = rng.normal(size=300)
    slow = np.zeros(300)
    for n in range(300):
        slow[n] = sum(dsp.PINK_B[k] * white[n - k] for k in range(7) if n >= k) - sum(dsp.PINK_A[k] * slow[n - k] for k in range(1, 7) if n >= k)
    assert np.allclose(dsp.pink(white), slow)
    assert dsp.coloured(1000, "brown", dsp.generator(1, "x", "k")).std() == pytest.approx(0.25)


def test_resampling_keeps_a_tone():
    t = np.arange(4800) / 24000
    out = dsp.resample(np.sin(2 * np.pi * 440 * t), 24000, 16000)
    assert len(out) == 3200
    assert np.allclose(out[200:-200], np.sin(2 * np.pi * 440 * np.arange(3200) / 16000)[200:-200], atol=1e-2)


def test_log_mel_shape_and_peak():
    t = np.arange(16000) / 16000
    mel = dsp.log_mel(np.sin(2 * np.pi * 1000 * t))
    assert mel.shape == (40, 34)
    assert mel.max() == 0.0 and mel.min() >= -80
    filters = dsp.mel_filters(16000, 2048, 40, 0, 8000)
    assert abs(int(np.argmax(mel[:, 17])) - int(np.argmax(filters[:, 128]))) <= 1
    assert dsp.log_mel(np.sin(t), **dsp.DENSE_MEL).shape == (96, 101)


def test_trim():
    a = np.concatenate([np.zeros(4096), np.ones(4096), np.zeros(4096)])
    assert 4096 <= len(dsp.trim_silence(a)) <= 8192
    assert len(dsp.trim_silence(np.zeros(10))) == 0


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"transforms": [{"type": "HardClip", "kwargs": {"min_val": -0.5, "max_val": 0.5}}, {"type": "SoftClip", "kwargs": {"threshold": 1.0}}]}')
    assert np.allclose(apply(spark, [1.0], transforms.from_config(tmp_path / "c.json")), np.tanh(0.5))
    with pytest.raises(ValueError, match="unknown transform"):
        transforms.from_config({"transforms": [{"type": "Nothing"}]})
    with pytest.raises(ValueError, match="unknown preset"):
        transforms.preset("none")


def test_wav_round_trip(spark, tmp_path):
    a = np.sin(np.arange(800) / 9) * 0.7
    (tmp_path / "a.wav").write_bytes(wav.encode(a))
    (tmp_path / "b.txt").write_text("")
    got = wav.read_audio(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["metadata"]["channels"] == 1
    assert np.abs(np.array(got[0]["audio"]) - a).max() < 1e-4
    assert len(wav.decode(wav.encode(np.zeros(0)))[0]) == 0
    assert wav.list_noise(spark, str(tmp_path)).count() == 1


def test_wav_sink(spark, tmp_path):
    clips = spark.createDataFrame([(f"d/{k}.wav", [0.1 * k] * 10, 16000) for k in range(5)], "path string, audio array<float>, sample_rate int")
    wav.write_audio(clips.repartition(3), str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r["audio"] for r in wav.read_audio(spark, str(tmp_path / "d")).collect()}
    assert sorted(got) == [f"{k}.wav" for k in range(5)] and np.allclose(got["3.wav"], 0.3, atol=1e-4)


def test_features_and_matrices_on_disk(spark, tmp_path):
    mels = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]], 1, 0.5), (1, [[5.0], [6.0]], 0, 0.25)], "position long, mel array<array<float>>, label int, seconds double")
    assert exports.dump_features(mels, str(tmp_path), "f", "position") == 2
    assert np.load(tmp_path / "f_indices.npy").tolist() == [[0, 4], [4, 6]] and np.load(tmp_path / "f_shape.npy").tolist() == [3, 2] and np.load(tmp_path / "f_durations.npy").tolist() == [500, 250]
    np.save(tmp_path / "X_a.npy", np.zeros((2, 3), np.float32))
    for labels, said in (([0, 1, 1], "labels"), ([0, 5], "other than")):
        np.save(tmp_path / "y_a.npy", np.array(labels))
        with pytest.raises(ValueError, match=said):
            exports.load_dense(spark, str(tmp_path), "a")
    np.save(tmp_path / "y_a.npy", np.array([0, 1]))
    assert exports.load_dense(spark, str(tmp_path), "a").count() == 2


def test_ragged_and_dense_files(spark, tmp_path):
    clips = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [3.0], 0), (2, [], 1)], "position long, audio array<float>, label int")
    assert exports.dump_ragged(clips, str(tmp_path), "train", "position") == 3
    got = exports.load_ragged(spark, str(tmp_path), "train").orderBy("position").collect()
    assert [r["audio"] for r in got] == [[1.0, 2.0], [3.0], []]
    assert exports.dump_dense(exports.dense(clips, None, "position"), str(tmp_path), "train") == (3, 2)
    assert exports.dump_ragged(clips.limit(0), str(tmp_path), "none", "position") == 0
    assert exports.load_ragged(spark, str(tmp_path), "none").count() == 0
    broken = spark.createDataFrame([(0, [float("nan")], 1), (1, [1.0, float("inf")], 3)], "position long, values array<float>, label int")
    assert {r["rule"] for r in exports.check_dense(broken).collect()} == {"nan", "infinity", "labels", "widths", "classes"}
