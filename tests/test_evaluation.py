from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import cooldown, metrics


def greedy(positions, gap):
    kept = []
    for p in sorted(positions):
        if not kept or p - kept[-1] >= gap:
            kept.append(p)
    return kept


def hits(spark, positions, stream=1):
    return spark.createDataFrame([(stream, p, k) for k, p in enumerate(positions)], "s long, p long, k long")


@pytest.mark.parametrize(("positions", "gap", "kept"), [([0, 3, 4, 9, 10, 14], 5, [0, 9, 14]), ([0, 4, 8, 12], 5, [0, 8]), ([7], 3, [7]), ([], 3, [])])
def test_kept_hits(spark, positions, gap, kept):
    df = hits(spark, positions)
    assert sorted(r["p"] for r in cooldown.select_kept(df, ["s"], "p", gap, "k").collect()) == kept
    assert sum(r["kept"] for r in cooldown.count_kept(df, ["s"], "p", gap).collect()) == len(kept)


def test_random_streams_equal_the_loop_in_all_three_forms(spark):
    rng = random.Random(4)
    streams = {s: [rng.randrange(400) for _ in range(rng.randrange(150))] for s in range(12)}
    rows = [(s, p, k) for s, ps in streams.items() for k, p in enumerate(sorted(set(ps)))]
    df = spark.createDataFrame(rows, "s long, p long, k long")
    wanted = sorted((s, p) for s, ps in streams.items() for p in greedy(set(ps), 7))
    for select in (cooldown.select_kept, cooldown.select_kept_streamed):
        assert sorted((r["s"], r["p"]) for r in select(df, ["s"], "p", 7, "k").collect()) == wanted
    counts = {r["s"]: r["kept"] for r in cooldown.count_kept(df, ["s"], "p", 7).collect()}
    assert counts == {s: len(greedy(set(ps), 7)) for s, ps in streams.items() if ps}


@pytest.mark.parametrize(("block", "spread", "gap"), [(1, 400, 7), (2, 60, 9), (3, 5_000, 4), (5, 40, 1)])
def test_hits_carry_over_blocks(spark, monkeypatch, block, spread, gap):
    monkeypatch.setattr(cooldown, "BLOCK", block)
    rng = random.Random(block)
    streams = {s: [rng.randrange(-spread, spread) for _ in range(rng.randrange(1, 160))] for s in (None, 1, 2, 3, 4)} | {5: list(range(100))}
    rows = [(s, p, k) for s, ps in streams.items() for k, p in enumerate(ps)] + [(1, None, 0), (6, None, 0)]
    df = spark.createDataFrame(rows, "s long, p long, k long").repartition(5)
    wanted = sorted(((s or 0, p) for s, ps in streams.items() for p in greedy(set(ps), gap)))
    ties = {(s or 0, p): ps.index(p) for s, ps in streams.items() for p in ps}
    for select in (cooldown.select_kept, cooldown.select_kept_streamed):
        got = select(df, ["s"], "p", gap, "k").collect()
        assert sorted((r["s"] or 0, r["p"]) for r in got) == wanted
        assert all(r["k"] == ties[r["s"] or 0, r["p"]] for r in got)
    assert {r["s"]: r["kept"] for r in cooldown.count_kept(df, ["s"], "p", gap).collect()} == {s: len(greedy(set(ps), gap)) for s, ps in streams.items()}


def test_seconds_and_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (1, 0.5, 1), (1, 1.0, 2), (1, 1.5, 3)], "s long, t double, k long")
    assert sorted(r["t"] for r in cooldown.select_kept(df, ["s"], "t", 1.0, "k").collect()) == [0.0, 1.0]
    assert cooldown.select_kept(df, ["s"], "t", 0, "k").count() == 4
    with pytest.raises(ValueError, match="negative"):
        cooldown.select_kept(df, ["s"], "t", -1, "k")
    with pytest.raises(ValueError, match="at least 1"):
        cooldown.count_kept(df, ["s"], "t", 0)


def scores(spark, rows):
    return spark.createDataFrame(rows, "stream_id long, frame long, prediction double, ground_truth int")


def test_equality_is_neither_detection_nor_miss(spark):
    df = scores(spark, [(1, k, 0.5, 1) for k in range(4)])
    assert metrics.false_accepts(df, 0.5, 1).first()["false_accepts"] == 0
    assert metrics.false_negatives(df, 0.5).first().asDict() == {"stream_id": 1, "positives": 4, "misses": 0}


def test_rates(spark):
    df = scores(spark, [(1, 0, 0.9, 0), (1, 1, 0.1, 1), (1, 80, 0.9, 1), (2, 0, 0.1, 0)])
    assert {r["stream_id"]: r["far"] for r in metrics.false_accepts_per_hour(df, 2.0, 0.5).collect()} == {1: 1.0, 2: 0.0}
    assert {r["stream_id"]: r["frr"] for r in metrics.false_reject_rate(df, 0.5).collect()} == {1: 0.5, 2: 0.0}
    with pytest.raises(ValueError, match="positive"):
        metrics.false_accepts_per_hour(df, 0, 0.5)
    with pytest.raises(ValueError, match="between 0 and 1"):
        metrics.false_reject_rate(df, 1.5)
    with pytest.raises(ValueError, match="at least 2"):
        metrics.sweep(df, 1.0, 1)


def test_sweep_equals_single_thresholds(spark):
    rng = random.Random(1)
    df = scores(spark, [(s, k, round(rng.random(), 2), int(rng.random() < 0.3)) for s in range(3) for k in range(40)]).cache()
    for r in metrics.sweep(df, 1.0, 6, 4).collect():
        far = metrics.false_accepts(df, r["threshold"], 4).agg(F.sum("false_accepts")).first()[0]
        counts = metrics.false_negatives(df, r["threshold"]).agg(F.sum("misses"), F.sum("positives")).first()
        assert (r["far"], r["frr"]) == (far, counts[0] / counts[1])


def test_equal_error_without_crossing_and_without_rows(spark):
    quiet = scores(spark, [(1, 0, 0.0, 0)])
    assert metrics.equal_error(quiet, 1.0, 5).first().asDict() == {"eer": 0.0, "threshold": 0.0}
    assert metrics.roc(metrics.sweep(scores(spark, []), 1.0, 3)).first()["eer"] == 0.0


def test_roc_from_arrays(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 0.0], [0.0, 0.8, 1.0], [0.1, 0.4, 0.9]), (2, [], [], None)], "id int, far array<double>, frr array<double>, thresholds array<double>")
    got = {r["id"]: (r["eer"], r["eer_threshold"]) for r in metrics.roc_from_arrays(df).collect()}
    assert got[1] == (pytest.approx(0.9), 0.4)
    assert got[2] == (0.0, 0.0)
    wrong = spark.createDataFrame([(1, [1.0], [1.0, 2.0], None)], "id int, far array<double>, frr array<double>, thresholds array<double>")
    with pytest.raises(Exception, match="differ in length"):
        metrics.roc_from_arrays(wrong).collect()
