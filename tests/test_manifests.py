from __future__ import annotations

import json

import pytest

from larkspan.operators import assignment, manifest
from larkspan.schemas import MANIFEST
from larkspan.sources import jsonl


def rows(spark, labels, prefix="a", voice="v"):
    return spark.createDataFrame([(f"{prefix}{k}.wav", y, "t", voice, None, 1000, 16000, {}) for k, y in enumerate(labels)], MANIFEST)


def test_merge_ratio_and_errors(spark):
    pos, neg = rows(spark, [1] * 5, "p"), rows(spark, [0] * 20, "n")
    stats = manifest.merge_stats(manifest.merge(pos, neg, 1.5)).first()
    assert (stats["positives"], stats["negatives"]) == (5, 7)
    assert manifest.merge_stats(manifest.merge(pos, neg, 0)).first()["negatives"] == 0
    assert manifest.merge_stats(manifest.merge(pos.limit(0), neg, 1.5)).first()["negatives"] == 20
    with pytest.raises(ValueError, match="p0.wav"):
        manifest.merge(pos, pos)
    with pytest.raises(ValueError, match="empty"):
        manifest.merge(pos.limit(0), neg.limit(0))
    again = [sorted(r["path"] for r in manifest.merge(pos, neg.repartition(n), 1.0, 7).collect()) for n in (1, 5)]
    assert again[0] == again[1]


def test_validation_lists_every_breach(spark):
    df = spark.createDataFrame([("", 2, "", None, None, 0, 0, {}), ("/x", 1, "", None, None, 5, 1, {}), ("ok", 0, "", None, None, 5, 1, {}), (None, None, None, None, None, None, None, None)], MANIFEST)
    assert [r["n"] for r in manifest.validate(df).groupBy("path").count().withColumnRenamed("count", "n").orderBy("path").collect()] == [4, 4, 1]


def test_round_trip_and_sparse_lines(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", 1, "hé", "v", "b", 10, 16000, {}), ("b.wav", 0, "", None, None, 5, 8000, {"k": "v"})], MANIFEST)
    jsonl.write_manifest(df.coalesce(1), str(tmp_path / "m"))
    lines = [json.loads(x) for p in (tmp_path / "m").glob("*.json") for x in p.read_text().splitlines()]
    assert lines[0] == {"path": "a.wav", "label": 1, "text": "hé", "voice": "v", "backend": "b", "duration_ms": 10}
    assert sorted(map(str, jsonl.read_manifest(spark, str(tmp_path / "m")).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="label must be 0 or 1"):
        jsonl.write_manifest(rows(spark, [3]), str(tmp_path / "wrong"))
    assert not (tmp_path / "wrong").exists()


def test_tolerant_reader(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a.wav"}\n\nnot json\n{"label": 1}\n{"path": "b.wav", "label": 7}\n{"path": "c.wav", "label": 1, "duration_ms": 3}\n')
    good, errors = jsonl.read_tolerant(spark, str(tmp_path / "m.jsonl"))
    assert sorted((r["line"], r["path"], r["label"], r["sample_rate"]) for r in good.collect()) == [(1, "a.wav", 0, 16000), (6, "c.wav", 1, 16000)]
    assert sorted(r["message"] for r in errors.collect()) == ["Line 3: not JSON", "Line 4: path is missing", "Line 5: label must be 0 or 1"]


def test_tolerant_reader_numbers_lines_of_split_files(spark, tmp_path):
    import json

    wanted = []
    for name, lines in (("a", 700), ("b", 1), ("c", 400)):
        text = [json.dumps({"path": f"{name}{k}.wav", "label": k % 2}) if k % 5 else "" for k in range(1, lines + 1)]
        (tmp_path / f"{name}.jsonl").write_bytes("\r\n".join(text).encode())
        wanted += [(f"{name}{k}.wav", k) for k in range(1, lines + 1) if k % 5]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, errors = jsonl.read_tolerant(spark, str(tmp_path))
        assert sorted((r["path"], r["line"]) for r in good.collect()) == sorted(wanted)
        assert errors.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_line_fails_the_strict_reader(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "a.wav"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()


def loop_split(groups, train=0.7, val=0.15):
    """Whole groups (speaker, positives, negatives), in order within each kind."""
    total, positive = sum(p + n for _, p, n in groups), sum(p for _, p, _ in groups)
    tp = tn = vals = 0
    out = {}
    for kind in range(3):
        own = [g for g in groups if (0 if g[2] == 0 else 1 if g[1] == 0 else 2) == kind]
        for k, (s, p, n) in enumerate(own):
            if kind == 2:
                now, goal = (tp / (tp + tn) if tp + tn else 0.5), positive / total
                to = "train" if abs(now - goal) > abs(now + p / (p + n) - 2 * goal) else "val" if vals < len(groups) * val else "test"
            else:
                fits = tp + p <= int(total * train) + int(total * val) * 0.3 if kind == 0 else tn + n <= int(total * train) * 1.2
                to = "train" if k % 3 == 0 and fits else "val" if k % 3 == 1 else "test"
            out[s] = to
            vals += to == "val"
            tp, tn = (tp + p, tn + n) if to == "train" else (tp, tn)
    return out


def test_split_equals_the_loop(spark):
    import hashlib
    import random

    rng = random.Random(3)
    groups = [(f"s{k}", *rng.choice([(rng.randrange(1, 9), 0), (0, rng.randrange(1, 9)), (rng.randrange(1, 9), rng.randrange(1, 9))])) for k in range(40)]
    data = [(f"{s}-{y}-{k}.wav", y, "", s, None, 1, 1, {}) for s, p, n in groups for y, m in ((1, p), (0, n)) for k in range(m)]
    got = {r["speaker"]: r["split"] for r in assignment.assign_groups(spark.createDataFrame(data, MANIFEST), seed=9).collect()}
    ordered = sorted(groups, key=lambda g: hashlib.md5(f"9|split|{g[0]}".encode()).hexdigest())
    assert got == loop_split(ordered)


def test_split_checks(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        assignment.assign_groups(rows(spark, [1]), (0.5, 0.1, 0.1))
    assert {r["speaker"] for r in manifest.speaker_counts(rows(spark, [1, 0], voice="")).collect()} == {"unknown"}


def test_allocation(spark):
    table = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "source string, weight double")
    assert {r["source"]: r["n"] for r in assignment.allocate(table, 7).collect()} == {"a": 4, "b": 3}


def test_large_tables_take_the_same_rows_by_ranks(spark):
    from pyspark.sql import functions as F

    from larkspan.operators.prefix import prefix_sums, smallest
    from larkspan.operators.windows import running_offsets
    from larkspan.sources import cache
    from larkspan.tables import Workspace

    ws = Workspace(spark, "test")
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    order = [F.col("k").asc()]
    few, many = ({r["id"] for r in smallest(ws, df, f"s{m}", order, 120, m).collect()} for m in (1000, 5))
    assert few == many and len(few) == 120
    placed = prefix_sums(ws, ws.table(df, "rows"), "placed", order, {"before": "n"}, rows_per_slice=30).orderBy("k").collect()
    total = 0
    for r in placed:
        assert r["before"] == total
        total += r["n"]
    a, b = (sorted(map(str, running_offsets(df, "n", "id", ["g"], large).collect())) for large in (False, True))
    assert a == b
    entries = df.select(F.col("k").alias("key"), (F.col("n") + 1).alias("bytes"), F.floor(F.col("id") / 9).alias("last_access"))
    a, b = (sorted(map(str, cache.keep_recent(entries, 700, m).collect())) for m in (1000, 5))
    assert a == b and a


def test_the_number_of_slices_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    from larkspan.operators import prefix
    from larkspan.tables import Workspace

    monkeypatch.setattr(prefix, "MOST_SLICES", 3)
    ws = Workspace(spark, "test")
    df = ws.table(spark.createDataFrame([(k, k % 5) for k in range(200)], "k long, n long"), "rows")
    placed = prefix.prefix_sums(ws, df, "placed", [F.col("k").asc()], {"before": "n"}, rows_per_slice=10).orderBy("k").collect()
    assert [r["before"] for r in placed] == [sum(i % 5 for i in range(k)) for k in range(200)]
    assert spark.read.parquet(f"{ws.path}/placed").select(prefix.SLICE).distinct().count() <= 3
