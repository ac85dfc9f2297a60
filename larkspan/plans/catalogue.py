"""Registered queries and their SQL: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import dsp, phonetics, phrases, signal, transforms
from larkspan.functions.draws import integer, order_key, uniform
from larkspan.operators import assignment, augmentation, cooldown, manifest, metrics, windows
from larkspan.plans import views
from larkspan.sources import cache, exports, jsonl, scoring, synthesis, wav

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters that queries and their SQL share.
GAP, POINTS, THRESHOLD, SEED = 10, 21, 0.5, 42
RATIO = 0.1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Views in SQL.
SCORES = """scores AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame,
  value / (value + 50.0::DOUBLE) AS prediction, (event_type = 'purchase')::INT AS ground_truth, epoch_us(ts) / 1000000.0::DOUBLE AS seconds, event_id FROM events)"""
MANIFEST = """manifest AS (SELECT 'clips/' || doc_id || '.wav' AS path, quality::INT AS label, text, source AS voice, lang AS backend,
  n_chars::INT AS duration_ms, 16000::INT AS sample_rate, doc_id AS position, toxic::INT AS toxic FROM documents JOIN labels USING (doc_id))"""
AUDIO = "audio AS (SELECT 'clips/' || vec_id || '.wav' AS path, embedding AS audio, (label = 0)::INT AS label, vec_id AS position, label AS class FROM embeddings)"
SIGNALS = """signals AS (SELECT signal_id, list(s ORDER BY vec_id, k) AS audio FROM (
  SELECT (vec_id // 640 * 10 + label)::BIGINT AS signal_id, vec_id, unnest(embedding) AS s, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY signal_id)"""
PHRASES = """phrases AS (SELECT item_id * 1000000 + piece AS position, array_to_string(ws[3 * piece + 1:3 * piece + 3], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(0, (len(ws) + 2) // 3)) AS piece
    FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w <> '') AS ws FROM benchmark)))"""


def U(purpose: str, key: str) -> str:
    """A uniform draw in SQL."""
    return f"(('0x' || substr(md5('{SEED}|{purpose}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def greedy(hits: str, keys: str = "stream_id", at: str = "frame", gap: str = str(GAP)) -> str:
    """Kept positions of a table of hits, by recursion from hit to hit."""
    on = " AND ".join(f"h.{k} = s.{k}" for k in keys.split(", "))
    hk, sk = ", ".join(f"h.{k}" for k in keys.split(", ")), ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""kept AS (SELECT {keys}, min({at}) AS {at} FROM {hits} GROUP BY {keys}
  UNION ALL SELECT {hk}, min(h.{at}) FROM kept s JOIN {hits} h ON {on} AND h.{at} >= s.{at} + {gap} GROUP BY {hk}, s.{at})"""


HIT = f"hit AS (SELECT * FROM scores WHERE prediction > {THRESHOLD}::DOUBLE)"
GRID = f"grid AS (SELECT CASE WHEN i = {POINTS - 1} THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / {POINTS - 1}) END AS threshold FROM range({POINTS}) t(i))"
SWEEP = f"""hits AS (SELECT threshold, stream_id, frame FROM scores JOIN grid ON prediction > threshold),
{greedy("hits", "threshold, stream_id")},
fars AS (SELECT threshold, count(*)::DOUBLE / {views.HOURS}::DOUBLE AS far FROM kept GROUP BY threshold),
pos AS (SELECT prediction FROM scores WHERE ground_truth = 1),
frrs AS (SELECT threshold, coalesce((SELECT count(*) FROM pos WHERE prediction < threshold)::DOUBLE / nullif((SELECT count(*) FROM pos), 0)::DOUBLE, 0.0::DOUBLE) AS frr FROM grid),
sweep AS (SELECT threshold, coalesce(far, 0.0::DOUBLE) AS far, frr FROM frrs LEFT JOIN fars USING (threshold))"""


# Evaluation.


@query(f"WITH RECURSIVE {SCORES}, {HIT}, {greedy('hit')} SELECT stream_id, coalesce(n, 0)::BIGINT AS false_accepts FROM (SELECT DISTINCT stream_id FROM scores) LEFT JOIN (SELECT stream_id, count(*) AS n FROM kept GROUP BY stream_id) USING (stream_id)")
def far_count_by_stream(spark, sf_dir):
    return metrics.false_accepts(views.scores(spark, sf_dir), THRESHOLD, GAP)


@query(f"WITH RECURSIVE {SCORES}, {HIT}, {greedy('hit', gap='75')} SELECT stream_id, coalesce(n, 0)::DOUBLE / {views.HOURS}::DOUBLE AS far FROM (SELECT DISTINCT stream_id FROM scores) LEFT JOIN (SELECT stream_id, count(*) AS n FROM kept GROUP BY stream_id) USING (stream_id)")
def far_per_hour(spark, sf_dir):
    return metrics.false_accepts_per_hour(views.scores(spark, sf_dir), views.HOURS, THRESHOLD)


@query(f"WITH {SCORES} SELECT stream_id, count(*) FILTER (ground_truth = 1) AS positives, count(*) FILTER (ground_truth = 1 AND prediction < {THRESHOLD}::DOUBLE) AS misses FROM scores GROUP BY stream_id")
def false_negative_count(spark, sf_dir):
    return metrics.false_negatives(views.scores(spark, sf_dir), THRESHOLD)


@query(f"WITH {SCORES} SELECT stream_id, coalesce(count(*) FILTER (ground_truth = 1 AND prediction < {THRESHOLD}::DOUBLE)::DOUBLE / nullif(count(*) FILTER (ground_truth = 1), 0)::DOUBLE, 0.0::DOUBLE) AS frr FROM scores GROUP BY stream_id")
def frr_by_stream(spark, sf_dir):
    return metrics.false_reject_rate(views.scores(spark, sf_dir), THRESHOLD)


def _swept(spark, sf_dir):
    return metrics.sweep(views.scores(spark, sf_dir), views.HOURS, POINTS, GAP)


@query(f"WITH RECURSIVE {SCORES}, {GRID}, {SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


@query(f"WITH RECURSIVE {SCORES}, {GRID}, {SWEEP} SELECT threshold, far, frr FROM sweep ORDER BY abs(far - frr), threshold LIMIT 1")
def optimal_threshold(spark, sf_dir):
    return metrics.optimal_threshold(_swept(spark, sf_dir))


@query(f"WITH RECURSIVE {SCORES}, {GRID}, {SWEEP} SELECT (far + frr) / 2 AS eer, threshold AS eer_threshold, (SELECT count(*) FROM sweep) AS points FROM sweep ORDER BY abs(far - frr), threshold LIMIT 1")
def roc_eer(spark, sf_dir):
    return metrics.roc(_swept(spark, sf_dir))


@query(
    f"""WITH {AUDIO}, c AS (SELECT position AS id, list_transform(audio, lambda x: abs(x)::DOUBLE) AS far, list_reverse(list_transform(audio, lambda x: abs(x)::DOUBLE)) AS frr FROM audio),
p AS (SELECT id, unnest(far) AS a, unnest(frr) AS b, unnest(range(len(far))) AS i FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(a - b), i) AS n FROM p)
SELECT id, (a + b) / 2 AS eer, i::DOUBLE AS eer_threshold FROM r WHERE n = 1"""
)
def roc_from_arrays(spark, sf_dir):
    rates = F.transform("audio", lambda x: F.abs(x).cast("double"))
    return metrics.roc_from_arrays(views.audio(spark, sf_dir).select(F.col("position").alias("id"), rates.alias("far"), F.reverse(rates).alias("frr"), F.lit(None).cast("array<double>").alias("thresholds")))


EER = f"""n AS (SELECT *, CASE WHEN max(far) OVER () > 0 THEN far / max(far) OVER () ELSE far END - frr AS d, max(far) OVER () AS top FROM sweep),
l AS (SELECT *, lead(threshold) OVER (ORDER BY threshold) AS t1, lead(d) OVER (ORDER BY threshold) AS d1 FROM n),
x AS (SELECT threshold - d * (t1 - threshold) / (d1 - d) AS cut FROM l WHERE sign(d) <> sign(d1) ORDER BY threshold LIMIT 1),
hit2 AS (SELECT stream_id, frame FROM scores, x WHERE prediction > cut),
{greedy("hit2").replace("kept", "kept2")},
e AS (SELECT cut, ((SELECT count(*) FROM kept2)::DOUBLE / {views.HOURS}::DOUBLE / (SELECT max(top) FROM n) + (SELECT count(*) FROM pos WHERE prediction < cut)::DOUBLE / (SELECT count(*) FROM pos)::DOUBLE) / 2 AS eer FROM x)"""


@query(f"WITH RECURSIVE {SCORES}, {GRID}, {SWEEP}, {EER} SELECT round(eer, 9) AS eer, round(cut, 9) AS threshold FROM e")
def eer_interpolated(spark, sf_dir):
    found = metrics.equal_error(views.scores(spark, sf_dir), views.HOURS, POINTS, GAP)
    return found.select(F.round("eer", 9).alias("eer"), F.round("threshold", 9).alias("threshold"))


@query(
    f"""WITH RECURSIVE {SCORES}, {GRID}, {SWEEP}, {EER}, {HIT}, {greedy("hit").replace("kept", "kept3")}
SELECT (SELECT count(*) FROM kept3)::DOUBLE / {views.HOURS}::DOUBLE AS far, (SELECT count(*) FROM pos WHERE prediction < {THRESHOLD}::DOUBLE)::DOUBLE / (SELECT count(*) FROM pos)::DOUBLE AS frr,
round(eer, 9) AS eer, round(cut, 9) AS optimal_threshold, {views.HOURS}::DOUBLE AS audio_duration_hours, (SELECT count(*) FROM scores) AS total_samples FROM e"""
)
def eval_report(spark, sf_dir):
    made = metrics.report(views.scores(spark, sf_dir), views.HOURS, THRESHOLD, GAP, POINTS)
    return made.withColumns({"eer": F.round("eer", 9), "optimal_threshold": F.round("optimal_threshold", 9)})


# Manifests.

FLAWED = f"""{MANIFEST}, flawed AS (SELECT CASE WHEN position % 11 = 0 THEN '' WHEN position % 13 = 0 THEN '/' || path ELSE path END AS path,
  CASE WHEN position % 17 = 0 THEN 2 ELSE label END AS label, CASE WHEN position % 19 = 0 THEN 0 WHEN position % 23 = 0 THEN -1 ELSE duration_ms END AS duration_ms,
  CASE WHEN position % 29 = 0 THEN 0 ELSE sample_rate END AS sample_rate FROM manifest)"""


@query(
    f"""WITH {FLAWED}, e AS (SELECT path, list_filter([CASE WHEN path = '' THEN 'path is empty' END, CASE WHEN path LIKE '/%' THEN 'path must be relative' END,
  CASE WHEN label NOT IN (0, 1) THEN 'label must be 0 or 1' END, CASE WHEN duration_ms <= 0 THEN 'duration_ms must be positive' END,
  CASE WHEN sample_rate <= 0 THEN 'sample_rate must be positive' END], lambda x: x IS NOT NULL) AS m FROM flawed)
SELECT path, unnest(range(len(m)))::INT AS position, unnest(m) AS message FROM e"""
)
def manifest_validate(spark, sf_dir):
    return manifest.validate(views.flawed_manifest(spark, sf_dir))


@query(f"WITH {FLAWED} SELECT path, coalesce(label IN (0, 1) AND duration_ms >= 0 AND sample_rate > 0, false) AS valid FROM flawed")
def row_invariants(spark, sf_dir):
    return manifest.invariants(views.flawed_manifest(spark, sf_dir))


def _pos_neg(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    return m.where("label = 1"), m.where("label = 0")


@query(f"WITH {MANIFEST} SELECT DISTINCT path FROM manifest WHERE label = 1 AND path IN (SELECT path FROM manifest WHERE toxic = 1)")
def path_collisions(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    return manifest.collisions(m.where("label = 1"), m.where("toxic = 1"))


@query(f"WITH {MANIFEST} SELECT path, label, 0 AS origin FROM manifest WHERE label = 1 UNION ALL SELECT path, label, 1 FROM manifest WHERE toxic = 1")
def manifest_union(spark, sf_dir):
    m = views.manifest(spark, sf_dir).select("path", "label", "toxic")
    return manifest.union(m.where("label = 1"), m.where("toxic = 1")).drop("toxic")


@query(
    f"""WITH {MANIFEST}, n AS (SELECT CASE WHEN position % 3 = 0 THEN 'clips/' || (position // 2) || '.wav' ELSE path END AS path, label, position FROM manifest)
SELECT path, label, position FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position) AS k FROM n WHERE path NOT IN (SELECT path FROM manifest WHERE label = 1)) WHERE k = 1"""
)
def append_new_negatives(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    moved = F.when(F.col("position") % 3 == 0, F.concat(F.lit("clips/"), F.floor(F.col("position") / 2).cast("string"), F.lit(".wav"))).otherwise(F.col("path"))
    return manifest.append_new(m.where("label = 1"), m.select(moved.alias("path"), "label", "position"), "position")


MERGED = f"""{MANIFEST}, negatives AS (SELECT * FROM manifest WHERE label = 0 ORDER BY md5('{SEED}|ratio|' || path), path LIMIT (SELECT floor(count(*) * {RATIO}::DOUBLE)::BIGINT FROM manifest WHERE label = 1)),
merged AS (SELECT *, 0 AS origin FROM manifest WHERE label = 1 UNION ALL SELECT *, 1 FROM negatives)"""


@query(f"WITH {MERGED} SELECT path, label, origin FROM merged")
def merge_ratio(spark, sf_dir):
    return manifest.merge(*_pos_neg(spark, sf_dir), RATIO, SEED).select("path", "label", "origin")


@query(f"WITH {MERGED} SELECT count(*) AS total, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1)::DOUBLE AS actual_ratio FROM merged")
def merge_stats(spark, sf_dir):
    return manifest.merge_stats(manifest.merge(*_pos_neg(spark, sf_dir), RATIO, SEED))


@query(f"WITH {MANIFEST} SELECT path, label, md5('{SEED}|shuffle|' || path) AS order_key FROM manifest")
def seeded_shuffle(spark, sf_dir):
    return manifest.shuffled(views.manifest(spark, sf_dir).select("path", "label"), SEED)


@query(f"WITH {MANIFEST} SELECT coalesce(nullif(voice, ''), 'unknown') AS speaker, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM manifest GROUP BY 1")
def speaker_counts(spark, sf_dir):
    return manifest.speaker_counts(views.manifest(spark, sf_dir))


@query(f"WITH {FLAWED} SELECT label, count(*) AS n, coalesce(label IN (0, 1), false) AS valid FROM flawed GROUP BY label")
def class_distribution(spark, sf_dir):
    return manifest.class_distribution(views.flawed_manifest(spark, sf_dir))


@query(f"WITH {MANIFEST} SELECT path, label FROM manifest WHERE position % 7 = 0")
def missing_files(spark, sf_dir):
    m = views.manifest(spark, sf_dir)
    return manifest.missing_files(m.select("path", "label"), m.where("position % 7 <> 0").select("path"))


@query(
    f"""WITH p AS (SELECT turn + conv_id * 1000 AS position, regexp_extract(text, '^\\s*(\\S+)', 1) || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END AS phrase FROM conversations)
SELECT position, trim(phrase, ' ') AS phrase FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(phrase, ' ')) ORDER BY position) AS k FROM p WHERE trim(phrase, ' ') <> '') WHERE k = 1"""
)
def first_wins_dedup(spark, sf_dir):
    word = F.concat(F.regexp_extract("text", r"^\s*(\S+)", 1), F.when(F.col("turn") % 2 == 0, " ").otherwise(""))
    return manifest.first_wins(views.table(spark, sf_dir, "conversations").select((F.col("turn") + F.col("conv_id") * 1000).alias("position"), word.alias("phrase")), "position")


# Splits.

SHARE = f"""CASE WHEN {U("share", "coalesce(nullif(voice, ''), 'unknown')")} < 0.7::DOUBLE THEN 'train' WHEN {U("share", "coalesce(nullif(voice, ''), 'unknown')")} < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END"""


def _by_kind(m: DataFrame) -> DataFrame:
    """A finer speaker, so that there are pure and mixed groups."""
    return m.withColumn("voice", F.concat_ws("-", "voice", (F.col("position") % 4).cast("string")))


FOLD = f"""{MANIFEST}, g AS (SELECT voice || '-' || (position % 4) AS speaker, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM manifest GROUP BY 1),
k AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN p = 0 THEN 1 ELSE 2 END AS kind FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('{SEED}|split|' || speaker), speaker) - 1 AS k, row_number() OVER (ORDER BY kind, md5('{SEED}|split|' || speaker), speaker) AS i FROM k),
t AS (SELECT sum(p + n)::BIGINT AS every, sum(p)::BIGINT AS allp, count(*) AS groups FROM g),
f AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS speaker, ''::VARCHAR AS split, 0::BIGINT AS tp, 0::BIGINT AS tn, 0::BIGINT AS vals
  UNION ALL SELECT i, speaker, split, tp + CASE WHEN split = 'train' THEN p ELSE 0 END, tn + CASE WHEN split = 'train' THEN n ELSE 0 END, vals + CASE WHEN split = 'val' THEN 1 ELSE 0 END
  FROM (SELECT o.i::BIGINT AS i, o.speaker, o.p, o.n, f.tp, f.tn, f.vals, CASE
    WHEN kind = 2 THEN CASE WHEN abs(CASE WHEN tp + tn > 0 THEN tp::DOUBLE / (tp + tn)::DOUBLE ELSE 0.5::DOUBLE END - allp::DOUBLE / every::DOUBLE)
        > abs(CASE WHEN tp + tn > 0 THEN tp::DOUBLE / (tp + tn)::DOUBLE ELSE 0.5::DOUBLE END + p::DOUBLE / (p + n)::DOUBLE - 2.0::DOUBLE * (allp::DOUBLE / every::DOUBLE)) THEN 'train'
      WHEN vals::DOUBLE < groups * 0.15::DOUBLE THEN 'val' ELSE 'test' END
    WHEN k % 3 = 0 AND CASE WHEN kind = 0 THEN tp + p <= floor(every * 0.7::DOUBLE) + floor(every * 0.15::DOUBLE) * 0.3::DOUBLE ELSE tn + n <= floor(every * 0.7::DOUBLE) * 1.2::DOUBLE END THEN 'train'
    WHEN k % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM f JOIN o ON o.i = f.i + 1 CROSS JOIN t))"""


@query(f"WITH RECURSIVE {FOLD} SELECT speaker, split FROM f WHERE i > 0")
def group_split(spark, sf_dir):
    return assignment.assign_groups(_by_kind(views.manifest(spark, sf_dir)), seed=SEED)


@query(f"WITH RECURSIVE {FOLD} SELECT m.path, m.label, f.split FROM manifest m JOIN f ON f.speaker = m.voice || '-' || (m.position % 4)")
def split_rows(spark, sf_dir):
    m = _by_kind(views.manifest(spark, sf_dir))
    return assignment.split_rows(m, assignment.assign_groups(m, seed=SEED)).select("path", "label", "split")


def _splits(spark, sf_dir):
    return assignment.split_by_share(views.manifest(spark, sf_dir), seed=SEED)


@query(f"WITH {MANIFEST} SELECT path, voice, {SHARE} AS split FROM manifest")
def split_by_share(spark, sf_dir):
    return _splits(spark, sf_dir).select("path", "voice", "split")


@query(f"WITH {MANIFEST}, s AS (SELECT label, {SHARE} AS split FROM manifest) SELECT split, label, count(*) AS n FROM s GROUP BY CUBE (split, label)")
def split_label_cube(spark, sf_dir):
    return manifest.split_cube(_splits(spark, sf_dir))


BROKEN = f"""{MANIFEST}, s AS (SELECT path, voice, position, {SHARE} AS split FROM manifest), b AS (SELECT path, voice, split FROM s WHERE position % 31 <> 0 UNION ALL SELECT path, voice, 'extra' FROM s WHERE position % 37 = 0)"""


def _broken(spark, sf_dir):
    s = _splits(spark, sf_dir).select("path", "voice", "position", "split")
    return s.where("position % 31 <> 0").drop("position").unionByName(s.where("position % 37 = 0").drop("position").withColumn("split", F.lit("extra")))


@query(f"WITH {BROKEN} SELECT path, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT path, split FROM b) GROUP BY path HAVING count(*) > 1")
def split_overlap_audit(spark, sf_dir):
    return manifest.overlap_audit(_broken(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {BROKEN} SELECT voice, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT voice, split FROM b WHERE voice IS NOT NULL) GROUP BY voice HAVING count(*) > 1")
def speaker_leak_audit(spark, sf_dir):
    return manifest.leak_audit(_broken(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {BROKEN}, h AS (SELECT path FROM manifest WHERE position % 41 <> 0) SELECT path, 'missing' AS problem FROM h WHERE path NOT IN (SELECT path FROM b) UNION SELECT path, 'extra' FROM b WHERE path NOT IN (SELECT path FROM h)")
def split_completeness(spark, sf_dir):
    return manifest.completeness_audit(views.manifest(spark, sf_dir).where("position % 41 <> 0"), _broken(spark, sf_dir))


# Crossing and dealing.

PROVIDERS = [(0, "kokoro", ["af_heart", "af_bella", "am_puck"]), (1, "piper", ["en_US-ryan-high", "en_US-amy-low"])]
COMBOS = f"""{PHRASES}, v AS (SELECT * FROM (VALUES {", ".join(f"({p}, '{b}', {k}, '{v}')" for p, b, own in PROVIDERS for k, v in enumerate(own))}) t(pp, backend, vp, voice)),
combos AS (SELECT (row_number() OVER (ORDER BY position, pp, vp) - 1)::BIGINT AS combo, phrase, backend, voice FROM phrases CROSS JOIN v)"""


def _combos(spark, sf_dir):
    providers = spark.createDataFrame(PROVIDERS, "provider_pos int, backend string, voices array<string>")
    return assignment.combinations(views.phrases(spark, sf_dir).withColumnRenamed("position", "variant_pos"), providers)


@query(f"WITH {COMBOS} SELECT * FROM combos")
def provider_voice_cross(spark, sf_dir):
    return _combos(spark, sf_dir)


@query(f"WITH {COMBOS} SELECT doc_id AS position, combo, phrase, backend, voice FROM documents JOIN combos ON combo = (doc_id + 7) % (SELECT count(*) FROM combos)")
def round_robin_assign(spark, sf_dir):
    return assignment.deal(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position")), "position", _combos(spark, sf_dir), 7)


@query(f"WITH {MANIFEST} SELECT backend, 'cpu' AS acceleration, voice, position FROM manifest")
def execution_order(spark, sf_dir):
    return assignment.execution_order(views.manifest(spark, sf_dir).select("backend", F.lit("cpu").alias("acceleration"), "voice", "position"))


@query(
    """WITH s AS (SELECT source, count(*)::DOUBLE AS weight FROM documents GROUP BY source), r AS (SELECT source, 1000.0::DOUBLE * (weight / (SELECT sum(weight) FROM s)) AS raw FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, raw DESC, source) AS k FROM r)
SELECT source, (floor(raw) + CASE WHEN k <= 1000 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END)::BIGINT AS n FROM o"""
)
def source_allocation(spark, sf_dir):
    return assignment.allocate(views.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("weight")), 1000)


@query(f"WITH {AUDIO} SELECT path, (floor({U('noise', 'path')} * 10))::INT AS noise FROM audio")
def clip_noise_pairs(spark, sf_dir):
    return views.audio(spark, sf_dir).select("path", integer(SEED, "noise", F.col("path"), 10).alias("noise"))


# Windows and selection.

WINDOW, HOP = 160, 70
WINDOWS = f"""{SIGNALS}, sized AS (SELECT *, len(audio) AS n FROM signals),
starts AS (SELECT signal_id, n, audio, unnest(CASE WHEN n <= {WINDOW} THEN [0::BIGINT] ELSE list_concat(range(0, n - {WINDOW} + 1, {HOP}),
  CASE WHEN (n - {WINDOW}) % {HOP} > 0 THEN [n - {WINDOW}] ELSE [] END) END) AS window_start FROM sized)"""


def _windows(spark, sf_dir):
    return windows.sliding_windows(views.signals(spark, sf_dir), WINDOW, HOP)


@query(f"WITH {WINDOWS} SELECT signal_id, window_start::BIGINT AS window_start, least(window_start + {WINDOW}, n)::BIGINT AS window_end, window_start / 16000.0::DOUBLE AS timestamp FROM starts")
def sliding_windows(spark, sf_dir):
    return _windows(spark, sf_dir).drop("samples")


ENERGY = f"""{WINDOWS}, energy AS (SELECT signal_id, window_start::BIGINT AS window_start, round(list_sum(list_transform(audio[window_start + 1:window_start + {WINDOW}], lambda x: x::DOUBLE * x::DOUBLE)) / {WINDOW}, 9) AS energy FROM starts)"""


def _energy(spark, sf_dir):
    return _windows(spark, sf_dir).select("signal_id", "window_start", F.round(signal.power(F.col("samples")), 9).alias("energy"))


@query(f"WITH {ENERGY} SELECT * FROM energy")
def window_energy(spark, sf_dir):
    return _energy(spark, sf_dir)


@query(f"WITH {ENERGY}, d AS (SELECT signal_id, (window_start // 200 * 200)::BIGINT AS window_start, energy, window_start AS seq FROM energy) SELECT signal_id, window_start, energy, seq FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, window_start ORDER BY seq) AS k FROM d) WHERE k = 1")
def dedup_windows(spark, sf_dir):
    coarse = (F.floor(F.col("window_start") / 200) * 200).cast("long")
    return windows.first_of_start(_energy(spark, sf_dir).select("signal_id", coarse.alias("window_start"), "energy", F.col("window_start").alias("seq")), "seq")


@query(
    f"""WITH {SIGNALS}, sized AS (SELECT signal_id, len(audio) AS n FROM signals), c AS (SELECT signal_id, n, unnest(range(0, n, 600)) AS pos FROM sized WHERE n > 600 UNION ALL SELECT signal_id, n, 0 FROM sized WHERE n <= 600),
l AS (SELECT *, CASE WHEN n > 600 AND pos + 600 < n THEN 600 - {WINDOW} ELSE least(600, n - pos) END AS len FROM c)
SELECT signal_id, (pos + unnest(CASE WHEN len <= {WINDOW} THEN [0::BIGINT] ELSE list_concat(range(0, len - {WINDOW} + 1, {HOP}), CASE WHEN (len - {WINDOW}) % {HOP} > 0 THEN [len - {WINDOW}] ELSE [] END) END))::BIGINT AS window_start FROM l"""
)
def chunked_windows_compat(spark, sf_dir):
    return views.signals(spark, sf_dir).select("signal_id", F.explode(windows.gapped_starts(F.size("audio").cast("long"), WINDOW, HOP, 600)).alias("window_start"))


@query(f"WITH RECURSIVE {SCORES}, {HIT}, {greedy('hit')} SELECT stream_id, frame, h.event_id FROM kept JOIN hit h USING (stream_id, frame)")
def cooldown_select(spark, sf_dir):
    return cooldown.select_kept(views.scores(spark, sf_dir).where(F.col("prediction") > THRESHOLD), ["stream_id"], "frame", GAP, "event_id")


@query(f"WITH RECURSIVE {SCORES}, {HIT}, {greedy('hit', at='seconds', gap='86400.0::DOUBLE')} SELECT stream_id, min(h.event_id) AS event_id, round(seconds, 6) AS seconds FROM kept JOIN hit h USING (stream_id, seconds) GROUP BY stream_id, seconds")
def cooldown_select_time(spark, sf_dir):
    kept = cooldown.select_kept(views.scores(spark, sf_dir).where(F.col("prediction") > THRESHOLD), ["stream_id"], "seconds", 86400.0, "event_id")
    return kept.withColumn("seconds", F.round("seconds", 6))


@query(f"WITH RECURSIVE {SCORES}, {HIT}, {greedy('hit')} SELECT stream_id, frame, h.event_id FROM kept JOIN hit h USING (stream_id, frame)")
def cooldown_select_streamed(spark, sf_dir):
    return cooldown.select_kept_streamed(views.scores(spark, sf_dir).where(F.col("prediction") > THRESHOLD), ["stream_id"], "frame", GAP, "event_id")


@query(f"WITH {MANIFEST} SELECT path, voice, (sum(duration_ms) OVER w - duration_ms)::BIGINT AS start, (sum(duration_ms) OVER w)::BIGINT AS end FROM manifest WINDOW w AS (PARTITION BY voice ORDER BY position ROWS UNBOUNDED PRECEDING)")
def running_offsets(spark, sf_dir):
    return windows.running_offsets(views.manifest(spark, sf_dir).select("path", "voice", "duration_ms", "position"), "duration_ms", "position", ["voice"]).select("path", "voice", "start", "end")


@query(
    f"""WITH {MANIFEST}, c AS (SELECT position AS window_start, voice AS stem, (duration_ms % 50) / 10.0::DOUBLE AS timestamp FROM manifest), n AS (SELECT *, printf('%s_T%.3f', stem, timestamp) AS base FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY timestamp, window_start) - 1 AS k FROM n) SELECT window_start, base || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.wav' AS clip_name FROM r"""
)
def clip_names(spark, sf_dir):
    clips = views.manifest(spark, sf_dir).select(F.col("position").alias("window_start"), F.col("voice").alias("stem"), (F.col("duration_ms") % 50 / 10.0).alias("timestamp"))
    return windows.clip_names(clips).select("window_start", "clip_name")


# Caches.


@query(f"WITH {MANIFEST} SELECT path, sha256(concat_ws(chr(0), 'v3', text, voice, backend, '1.0', '{{}}')) AS key FROM manifest")
def cache_key(spark, sf_dir):
    return views.manifest(spark, sf_dir).select("path", cache.cache_key(F.col("text"), F.col("voice"), F.col("backend"), F.lit(1.0)).alias("key"))


ENTRIES = f"{MANIFEST}, entries AS (SELECT path AS key, duration_ms::BIGINT AS bytes, position // 3 AS last_access FROM manifest)"


def _entries(spark, sf_dir):
    return views.manifest(spark, sf_dir).select(F.col("path").alias("key"), F.col("duration_ms").cast("long").alias("bytes"), F.floor(F.col("position") / 3).cast("long").alias("last_access"))


@query(f"WITH {ENTRIES} SELECT key, bytes, last_access FROM (SELECT *, sum(bytes) OVER (ORDER BY last_access DESC, key DESC ROWS UNBOUNDED PRECEDING) AS total FROM entries) WHERE total <= 400000")
def cache_lru_keep(spark, sf_dir):
    return cache.keep_recent(_entries(spark, sf_dir), 400_000)


@query(f"WITH {ENTRIES} SELECT count(*) AS entries, sum(bytes)::DOUBLE / (1024.0 * 1024.0)::DOUBLE AS megabytes, min(last_access) AS oldest, max(last_access) AS newest FROM entries")
def cache_stats(spark, sf_dir):
    return cache.stats(_entries(spark, sf_dir))


@query(f"WITH {ENTRIES}, a AS (SELECT * FROM entries UNION ALL SELECT key, bytes, last_access + 1000 FROM entries WHERE last_access % 2 = 0) SELECT key, arg_max(bytes, last_access) AS bytes, max(last_access) AS last_access FROM a GROUP BY key")
def cache_touch(spark, sf_dir):
    own = _entries(spark, sf_dir)
    return cache.touch(own, own.where("last_access % 2 = 0").withColumn("last_access", F.col("last_access") + 1000))


@query(f"WITH {ENTRIES} SELECT key FROM entries WHERE last_access % 2 = 1")
def cache_misses(spark, sf_dir):
    own = _entries(spark, sf_dir)
    return cache.misses(own.select("key"), own.where("last_access % 2 = 0"))


# Signals. Values come one to a row, rounded.


def _values(rows: DataFrame, audio, key: str = "path") -> DataFrame:
    return rows.select(key, audio.alias("__a")).select(key, F.posexplode("__a").alias("i", "__v")).select(key, "i", F.round(F.col("__v").cast("double"), 5).alias("v"))


def _sql_values(made: str, more: str = "") -> str:
    return f"WITH {AUDIO}{more}, m AS (SELECT path, {made} AS a FROM audio) SELECT path, unnest(range(len(a)))::INT AS i, unnest(list_transform(a, lambda x: round(x::FLOAT::DOUBLE, 5))) AS v FROM m"


@query(_sql_values(f"list_transform(audio, lambda x: x::DOUBLE * pow(10.0::DOUBLE, (-45.0::DOUBLE + {U('gain', 'path')} * 45.0::DOUBLE) / 20.0::DOUBLE))"))
def gain(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.adjust_gain(-45.0, 0.0, seed=SEED)(F.col("audio"), F.col("path")))


@query(_sql_values("list_transform(audio, lambda x: greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x::DOUBLE)))"))
def hard_clip(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.hard_clip(-0.1, 0.1)(F.col("audio"), F.col("path")))


@query(_sql_values("list_transform(audio, lambda x: tanh(x::DOUBLE / 0.2::DOUBLE) * 0.2::DOUBLE)"))
def soft_clip(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.soft_clip(0.2)(F.col("audio"), F.col("path")))


@query(_sql_values("list_transform(audio, lambda x, i: x::DOUBLE * CASE WHEN i <= 10 THEN (i - 1) / 9.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN i > len(audio) - 10 THEN (len(audio) - i) / 9.0::DOUBLE ELSE 1.0::DOUBLE END)"))
def gain_transition(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.fade(F.col("audio"), 10))


@query(_sql_values("list_concat(audio, list_transform(range(16), lambda x: 0.0::FLOAT))"))
def pad_or_crop_pads(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.fixed_size(80)(F.col("audio"), F.col("path")))


@query(_sql_values("audio[12:52]"))
def center_crop(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.fixed_size(41, "center")(F.col("audio"), F.col("path")).alias("a"))


@query(_sql_values("list_transform(range(40), lambda i: audio[(i * (63 / 39.0::DOUBLE))::DOUBLE::DECIMAL(18, 9)::BIGINT * 0 + floor(i * (63 / 39.0::DOUBLE))::INT + 1]::DOUBLE + (audio[least(floor(i * (63 / 39.0::DOUBLE))::INT + 1, 63) + 1]::DOUBLE - audio[floor(i * (63 / 39.0::DOUBLE))::INT + 1]::DOUBLE) * (i * (63 / 39.0::DOUBLE) - floor(i * (63 / 39.0::DOUBLE))))").replace("(i * (63 / 39.0::DOUBLE))::DOUBLE::DECIMAL(18, 9)::BIGINT * 0 + ", ""))
def stretch(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.fixed_size(40, "pad_only")(F.col("audio"), F.col("path")))


@query(_sql_values("list_transform(audio, lambda x: CASE WHEN list_max(list_transform(audio, lambda y: abs(y * 4))) > 1 THEN x::DOUBLE * 4 / list_max(list_transform(audio, lambda y: abs(y::DOUBLE * 4))) ELSE x::DOUBLE * 4 END)"))
def peak_normalise(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.normalise(F.transform("audio", lambda x: x.cast("double") * 4)))


@query(
    f"""WITH {AUDIO}, p AS (SELECT a.path, a.audio, b.audio AS noise FROM audio a JOIN audio b ON b.position = a.position - a.position % 5),
w AS (SELECT *, sqrt(list_sum(list_transform(audio, lambda x: x::DOUBLE * x::DOUBLE)) / len(audio) / pow(10.0::DOUBLE, 6.0::DOUBLE / 10) / (list_sum(list_transform(noise, lambda x: x::DOUBLE * x::DOUBLE)) / len(noise))) AS f FROM p),
m AS (SELECT path, list_transform(list_zip(audio, noise), lambda z: z[1]::DOUBLE + z[2]::DOUBLE * f) AS a FROM w),
n AS (SELECT path, a, list_max(list_transform(a, lambda x: abs(x))) AS top FROM m)
SELECT path, unnest(range(len(a)))::INT AS i, unnest(list_transform(a, lambda x: round((CASE WHEN top > 1 THEN x / top ELSE x END)::FLOAT::DOUBLE, 5))) AS v FROM n"""
)
def mix_at_snr(spark, sf_dir):
    a = views.audio(spark, sf_dir).select("path", "audio", "position")
    noise = a.select(F.col("position").alias("noise_at"), F.col("audio").alias("noise")).where("noise_at % 5 = 0")
    pairs = a.withColumn("noise_at", F.col("position") - F.col("position") % 5).join(noise, "noise_at")
    return _values(pairs, signal.mix_at_snr(F.col("audio"), F.col("noise"), F.lit(6.0)))


@query(
    f"""WITH {AUDIO}, s AS (SELECT path, list_transform(audio, lambda x: abs(x::DOUBLE)) AS a FROM audio), t AS (SELECT path, a, list_max(a) AS top FROM s)
SELECT path, round(len(list_filter(a[list_position(a, top):], lambda x: x > top * 0.001::DOUBLE)) * 2 / 16000.0::DOUBLE, 9) AS rt60, round(top, 6) AS peak, round(list_sum(list_transform(a, lambda x: x * x)) / len(a), 9) AS power, (len(a) / 16000.0::DOUBLE * 1000)::DOUBLE::INT AS duration_ms FROM t"""
)
def signal_measures(spark, sf_dir):
    a = F.col("audio")
    return views.audio(spark, sf_dir).select("path", F.round(signal.rt60(a), 9).alias("rt60"), F.round(signal.peak(a), 6).alias("peak"), F.round(signal.power(a), 9).alias("power"), signal.duration_ms(a).alias("duration_ms"))


@query(_sql_values("list_transform(list_zip(audio, list_reverse(audio)), lambda z: (z[1]::DOUBLE + z[2]::DOUBLE) / 2)"))
def mono_mix(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), signal.mono(F.array(F.col("audio"), F.reverse("audio"))))


@query(f"WITH {AUDIO} SELECT path, len(list_filter(audio, lambda x: isnan(x))) > 0 AS has_nan, len(list_filter(audio, lambda x: isinf(x))) > 0 AS has_infinity FROM audio")
def number_checks(spark, sf_dir):
    return views.audio(spark, sf_dir).select("path", signal.has_nan(F.col("audio")).alias("has_nan"), signal.has_infinity(F.col("audio")).alias("has_infinity"))


@query(_sql_values(f"list_transform(audio, lambda x: x::DOUBLE * pow(10.0::DOUBLE, (-20.0::DOUBLE + {U('gain', 'path')} * 20.0::DOUBLE) / 20.0::DOUBLE))"))
def preset_minimal(spark, sf_dir):
    return _values(views.audio(spark, sf_dir), transforms.preset("minimal")(F.col("audio"), F.col("path")))


@query()
def preset_heavy(spark, sf_dir):
    return views.audio(spark, sf_dir).select("path", transforms.preset("heavy")(F.col("audio"), F.col("path")).alias("audio"))


@query()
def coloured_noise(spark, sf_dir):
    made = [dsp.add_coloured_noise(c, 0.0, 10.0, seed=SEED)(F.col("audio"), F.col("path")).alias(c) for c in ("white", "pink", "brown")]
    return views.audio(spark, sf_dir).select("path", *made)


def _bank(spark, sf_dir):
    """Eight recordings, whatever the number of clips."""
    found = views.audio(spark, sf_dir).where("class = 9").orderBy("position").limit(8).select("audio").collect()
    return spark.createDataFrame([(k, r["audio"]) for k, r in enumerate(found)], "k int, audio array<float>")


@query()
def reverb(spark, sf_dir):
    return augmentation.add_reverb(views.audio(spark, sf_dir).select("path", "audio"), _bank(spark, sf_dir), 0.7, SEED)


@query(
    f"""WITH {AUDIO}, bank AS (SELECT (row_number() OVER (ORDER BY position) - 1)::INT AS k, audio AS noise FROM (SELECT * FROM audio WHERE class = 9 ORDER BY position LIMIT 8)),
p AS (SELECT path, audio, noise, {U("noise?", "path")} <= 0.5::DOUBLE AS wanted, 0.0::DOUBLE + {U("noise snr", "path")} * 20.0::DOUBLE AS snr FROM audio JOIN bank ON k = (floor({U("noise", "path")} * 8))::INT),
w AS (SELECT *, sqrt(list_sum(list_transform(audio, lambda x: x::DOUBLE * x::DOUBLE)) / 64 / pow(10.0::DOUBLE, snr / 10) / (list_sum(list_transform(noise, lambda x: x::DOUBLE * x::DOUBLE)) / 64)) AS f FROM p),
m AS (SELECT path, CASE WHEN wanted THEN list_transform(list_zip(audio, noise), lambda z: z[1]::DOUBLE + z[2]::DOUBLE * f) ELSE list_transform(audio, lambda x: x::DOUBLE) END AS a, wanted FROM w),
n AS (SELECT path, a, list_max(list_transform(a, lambda x: abs(x))) AS top, wanted FROM m)
SELECT path, unnest(range(len(a)))::INT AS i, unnest(list_transform(a, lambda x: round((CASE WHEN wanted AND top > 1 THEN x / top ELSE x END)::FLOAT::DOUBLE, 5))) AS v FROM n"""
)
def add_noise(spark, sf_dir):
    made = augmentation.add_noise(views.audio(spark, sf_dir).select("path", "audio"), _bank(spark, sf_dir), 0.0, 20.0, 0.5, SEED)
    return _values(made, F.col("audio"))


@query(f"WITH {AUDIO} SELECT path, list_max(list_transform(audio, lambda x: abs(x))) <= 1 AND position % 3 <> 0 AND position % 7 <> 0 AS valid FROM audio")
def result_invariants(spark, sf_dir):
    position = F.col("position")
    rate = F.when(position % 7 == 0, 0).otherwise(16000)
    duration = F.when(position % 3 == 0, 0.5).otherwise(F.size("audio") / 16000.0)
    return views.audio(spark, sf_dir).select("path", signal.valid_result(F.col("audio"), F.nullif(rate, F.lit(0)), duration).alias("valid"))


@query()
def log_mel(spark, sf_dir):
    mel = dsp.mel_features(**dsp.RAGGED_MEL)
    return views.signals(spark, sf_dir).select("signal_id", mel(F.col("audio")).alias("mel"))


@query()
def log_mel_dense(spark, sf_dir):
    mel = dsp.over_audio(lambda a: [r.tolist() for r in dsp.fit_frames(dsp.log_mel(a, **dsp.DENSE_MEL), 16)], "array<array<float>>")
    return views.signals(spark, sf_dir).select("signal_id", mel(F.col("audio")).alias("mel"))


@query()
def trim_silence(spark, sf_dir):
    return views.signals(spark, sf_dir).select("signal_id", dsp.over_audio(lambda a: dsp.trim_silence(a, 3.0, 64, 16))(F.col("audio")).alias("audio"))


@query()
def resample(spark, sf_dir):
    return views.signals(spark, sf_dir).select("signal_id", dsp.over_audio(lambda a: dsp.resample(a, 24000, 16000))(F.col("audio")).alias("audio"), dsp.over_audio(lambda a: dsp.linear_resample(a, 24000, 16000))(F.col("audio")).alias("linear"))


# Phrases.


def _listed(rows: DataFrame, made) -> DataFrame:
    return rows.select("phrase", made.alias("__v")).distinct().select("phrase", F.explode("__v").alias("variant"))


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ws FROM phrases)
SELECT phrase, unnest(list_distinct(CASE WHEN len(ws) < 2 THEN [phrase] ELSE list_concat([phrase, ws[1] || ', ' || array_to_string(ws[2:], ' '), phrase || ',', phrase || '.', phrase || '!', phrase || '?'],
  CASE WHEN len(ws) >= 3 THEN [ws[1] || ' ' || ws[2] || ', ' || array_to_string(ws[3:], ' ')] ELSE [] END) END)) AS variant FROM w"""
)
def punctuation_variants(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.punctuation_variants(F.col("phrase")))


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, string_split(phrase, '') AS cs, string_split(phrase, ' ') AS ws FROM phrases)
SELECT phrase, unnest(list_distinct([phrase, lower(phrase), upper(phrase), array_to_string(list_transform(ws, lambda x: upper(x[1]) || lower(x[2:])), ' '), upper(phrase[1]) || lower(phrase[2:]),
  array_to_string(list_transform(cs, lambda c, i: CASE WHEN i % 2 = 1 THEN upper(c) ELSE lower(c) END), '')])) AS variant FROM w"""
)
def casing_variants(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.casing_variants(F.col("phrase")))


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase FROM phrases)
SELECT phrase, unnest(list_distinct(CASE WHEN phrase LIKE '% %' THEN [phrase, replace(phrase, ' ', '  '), ' ' || phrase || ' ', ' ' || phrase, phrase || ' ', replace(phrase, ' ', chr(9))] ELSE [phrase] END)) AS variant FROM w"""
)
def spacing_variants(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.spacing_variants(F.col("phrase")))


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, list_filter({list(phrases.LEADING)}, lambda x: x <> string_split(phrase, ' ')[1]) AS a FROM phrases),
v AS (SELECT phrase, phrase AS variant FROM w UNION SELECT phrase, unnest(list_transform(a, lambda x: x || ' ' || phrase)) FROM w UNION SELECT phrase, phrase || ' ' || unnest({list(phrases.TRAILING)}) FROM w
UNION SELECT phrase, x || ' ' || phrase || ' ' || y FROM (SELECT phrase, unnest(a[1:3]) AS x FROM w) CROSS JOIN (SELECT unnest({list(phrases.TRAILING[:3])}) AS y)) SELECT * FROM v"""
)
def affix_variants(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.affix_variants(F.col("phrase")))


def _wake_words(spark, sf_dir):
    """Phrases behind an opening word, so that tables of spoken variants apply."""
    return views.phrases(spark, sf_dir).select(F.concat(F.element_at(phrases.strings(("hey", "okay", "hi", "yo", "for")), (F.col("position") % 5 + 1).cast("int")), F.lit(" "), "phrase").alias("phrase"))


WAKE_WORDS = f"""{PHRASES}, w AS (SELECT DISTINCT ['hey', 'okay', 'hi', 'yo', 'for'][position % 5 + 1] || ' ' || phrase AS phrase FROM phrases),
i AS (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT phrase, string_split(phrase, ' ') AS ws FROM w))"""


def _pairs(table: dict, most: int) -> str:
    """Rows (c, o) of what stands for what."""
    return f"(SELECT * FROM (VALUES {', '.join(f"('{k}', '{o}')" for k, v in table.items() for o in v[:most] if o != k)}) t(c, o))"


def _put(new: str) -> str:
    """The phrase with a new word at k."""
    return f"array_to_string(list_concat(list_concat(ws[1:k - 1], [{new}]), ws[k + 1:]), ' ')"


def _words_replaced(table: dict, most: int) -> str:
    return f"SELECT phrase, {_put('o')} AS variant FROM i JOIN {_pairs(table, most)} ON ws[k] = c"


def _letters_replaced(table: dict) -> str:
    at = "(SELECT *, unnest(range(1, len(ws[k]) + 1)) AS p FROM i WHERE len(ws[k]) >= 2)"
    return f"SELECT phrase, {_put('ws[k][1:p - 1] || o || ws[k][p + 1:]')} AS variant FROM {at} JOIN {_pairs(table, 9)} ON ws[k][p] = c"


def _first_replaced() -> str:
    """Other words for the first one, by the beginnings it has."""
    return f"SELECT phrase, {_put('o')} AS variant FROM i JOIN (SELECT * FROM (VALUES {', '.join(f"('{k}', '{o}')" for k, v in phrases.PREFIXES.items() for o in v[:4])}) t(c, o)) ON starts_with(ws[1], c) WHERE k = 1 AND o <> ws[1]"


def _title(s: str) -> str:
    """Capitals after anything but a letter."""
    return f"array_to_string(list_transform(range(1, len({s}) + 1), lambda j: CASE WHEN j > 1 AND regexp_matches({s}[j - 1], '[A-Za-z]') THEN lower({s}[j]) ELSE upper({s}[j]) END), '')"


@query(f"WITH {WAKE_WORDS} SELECT phrase, phrase AS variant FROM w UNION {_words_replaced(phrases.CONTRACTIONS, 3)}")
def contraction_variants(spark, sf_dir):
    return _listed(_wake_words(spark, sf_dir), phrases.contraction_variants(F.col("phrase")))


@query(
    f"""WITH {WAKE_WORDS}, b AS (SELECT phrase, string_split(phrase, ' ') AS ws, list_filter({list(phrases.LEADING)}, lambda x: x <> string_split(phrase, ' ')[1]) AS first FROM w),
p AS (SELECT phrase, unnest([ws[1] || ', ' || array_to_string(ws[2:], ' '), phrase || ',', phrase || '.', phrase || '!', phrase || '?']) AS v FROM b WHERE len(ws) >= 2
  UNION SELECT phrase, ws[1] || ' ' || ws[2] || ', ' || array_to_string(ws[3:], ' ') FROM b WHERE len(ws) >= 3),
s AS (SELECT phrase, unnest([replace(phrase, ' ', '  '), ' ' || phrase || ' ', ' ' || phrase, phrase || ' ', replace(phrase, ' ', chr(9))]) AS v FROM b WHERE len(ws) >= 2),
l AS (SELECT phrase, unnest(first[1:3]) AS x FROM b),
a AS (SELECT phrase, phrase AS v FROM b UNION SELECT phrase, x || ' ' || phrase FROM (SELECT phrase, unnest(first) AS x FROM b) UNION SELECT phrase, phrase || ' ' || unnest({list(phrases.TRAILING)}) FROM b
  UNION SELECT phrase, x || ' ' || phrase || ' ' || y FROM l CROSS JOIN (SELECT unnest({list(phrases.TRAILING[:3])}) AS y)),
r AS ({_words_replaced(phrases.CONTRACTIONS, 3).replace("variant", "v")}), c AS (SELECT phrase, phrase AS v FROM b UNION SELECT * FROM r),
u AS (SELECT * FROM p UNION SELECT * FROM s UNION SELECT * FROM a UNION SELECT * FROM r
  UNION SELECT phrase, unnest([lower(phrase), upper(phrase), {_title("phrase")}, upper(phrase[1]) || lower(phrase[2:]),
    array_to_string(list_transform(string_split(phrase, ''), lambda x, j: CASE WHEN j % 2 = 1 THEN upper(x) ELSE lower(x) END), '')]) FROM b
  UNION SELECT phrase, unnest([upper(v), lower(v), {_title("v")}]) FROM p UNION SELECT phrase, unnest([upper(v), lower(v)]) FROM s
  UNION SELECT phrase, unnest([upper(v), lower(v), {_title("v")}]) FROM a UNION SELECT phrase, unnest([upper(v), lower(v)]) FROM r
  UNION SELECT phrase, unnest([v || ' ', v || '.', v || '!', v || '?', ' ' || v]) FROM c UNION SELECT phrase, v || unnest(['.', '!', '?', ',']) FROM a
  UNION SELECT phrase, unnest([array_to_string(ws, '   '), upper(array_to_string(ws, '   '))]) FROM b WHERE len(ws) >= 2),
o AS (SELECT phrase, v, coalesce(nullif(list_position([phrase, upper(phrase), {_title("phrase")}, phrase || '!'], v), 0), 5) AS turn FROM u),
n AS (SELECT phrase, v, row_number() OVER (PARTITION BY phrase ORDER BY turn, CASE WHEN turn = 5 THEN md5('{SEED}|variant|' || v) END, v) - 1 AS rank FROM o)
SELECT phrase, rank::INT AS rank, v AS variant FROM n WHERE rank < 50"""
)
def phrase_variants(spark, sf_dir):
    return phrases.generate_variants(_wake_words(spark, sf_dir), 50, SEED)


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ws FROM phrases), e AS (SELECT unnest({list(phrases.ENDINGS)}) AS e),
i AS (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS k FROM w), r AS (SELECT phrase, ws, k, ws[k][1:len(ws[k]) - len(e)] || e AS n FROM i, e WHERE len(ws[k]) >= 3 AND len(ws[k]) > len(e) + 1)
SELECT phrase, array_to_string(list_concat(list_concat(ws[1:k - 1], [n]), ws[k + 1:]), ' ') AS variant FROM r WHERE n <> ws[k]"""
)
def rhyme_substitutions(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.rhymes(F.col("phrase")))


def _substitutions(table: dict, least: int) -> str:
    pairs = ", ".join(f"('{k}', '{o}')" for k, v in table.items() for o in v)
    return f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ws FROM phrases), s AS (SELECT * FROM (VALUES {pairs}) t(c, o)),
i AS (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS k FROM w), j AS (SELECT phrase, ws, k, ws[k] AS x, unnest(range(1, len(ws[k]) + 1)) AS p FROM i WHERE len(ws[k]) >= {least})
SELECT phrase, array_to_string(list_concat(list_concat(ws[1:k - 1], [x[1:p - 1] || o || x[p + 1:]]), ws[k + 1:]), ' ') AS variant FROM j JOIN s ON c = x[p]"""


VOWEL_TABLE = {v: tuple(x for x in phrases.VOWELS if x != v) for v in phrases.VOWELS}


@query(_substitutions(VOWEL_TABLE, 2))
def vowel_substitutions(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.vowel_substitutions(F.col("phrase")))


@query(_substitutions(phrases.CONSONANTS, 2))
def consonant_substitutions(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.consonant_substitutions(F.col("phrase")))


@query(
    f"""WITH {PHRASES}, w AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ws FROM phrases), s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{o}')" for k, v in phrases.CLUSTERS.items() for o in v)}) t(c, o)),
i AS (SELECT phrase, ws, unnest(range(1, len(ws) + 1)) AS k FROM w), j AS (SELECT phrase, ws, k, ws[k] AS x, c, o, instr(ws[k], c) AS p FROM i, s WHERE contains(ws[k], c))
SELECT phrase, array_to_string(list_concat(list_concat(ws[1:k - 1], [x[1:p - 1] || o || x[p + len(c):]]), ws[k + 1:]), ' ') AS variant FROM j"""
)
def cluster_substitutions(spark, sf_dir):
    return _listed(views.phrases(spark, sf_dir), phrases.cluster_substitutions(F.col("phrase")))


@query(f"WITH {WAKE_WORDS} {_words_replaced(phrases.HOMOPHONES, 3)}")
def homophone_substitutions(spark, sf_dir):
    return _listed(_wake_words(spark, sf_dir), phrases.homophones(F.col("phrase")))


@query(f"WITH {WAKE_WORDS} {_first_replaced()}")
def prefix_substitutions(spark, sf_dir):
    return _listed(_wake_words(spark, sf_dir), phrases.prefix_substitutions(F.col("phrase")))


@query(
    f"""WITH {WAKE_WORDS}, v AS ({_words_replaced(phrases.HOMOPHONES, 3)} UNION {_letters_replaced(VOWEL_TABLE)} UNION {_letters_replaced(phrases.CONSONANTS)}
UNION SELECT phrase, {_put('ws[k][1:len(ws[k]) - len(e)] || e')} FROM i, (SELECT unnest({list(phrases.ENDINGS)}) AS e) WHERE len(ws[k]) >= 3 AND len(ws[k]) > len(e) + 1
UNION {_first_replaced()}
UNION SELECT phrase, {_put('ws[k][1:instr(ws[k], c) - 1] || o || ws[k][instr(ws[k], c) + len(c):]')} FROM i JOIN {_pairs(phrases.CLUSTERS, 2)} ON contains(ws[k], c))
SELECT DISTINCT phrase, lower(variant) AS variant FROM v WHERE lower(variant) <> lower(phrase) AND trim(variant) <> ''"""
)
def confusion_candidates(spark, sf_dir):
    return _listed(_wake_words(spark, sf_dir), phrases.confusion_candidates(F.col("phrase")))


@query()
def phonetic_similarity(spark, sf_dir):
    rows = views.phrases(spark, sf_dir)
    return rows.select("position", "phrase", phonetics.similarity(F.col("phrase"), F.array_join(F.reverse(phrases.words(F.col("phrase"))), " ")).alias("similarity"))


@query()
def confusions(spark, sf_dir):
    return phonetics.confusions(_wake_words(spark, sf_dir).distinct(), 10, 0.6)


@query(f"WITH {PHRASES} SELECT position, phrase, len(list_intersect(string_split(phrase, ' '), ['the', 'and'])) > 0 AS found FROM phrases")
def wake_word_filter(spark, sf_dir):
    return views.phrases(spark, sf_dir).select("position", "phrase", phrases.contains_any(F.col("phrase"), "The_and").alias("found"))


@query()
def synthetic_negatives(spark, sf_dir):
    # The vocabulary is an argument of the generator: a list of distinct words.
    words = [r["w"] for r in views.phrases(spark, sf_dir).select(F.explode(phrases.words(F.col("phrase"))).alias("w")).distinct().orderBy("w").collect()]
    made = phrases.synthetic_negatives(spark, words, "the_and", 200, seed=SEED).withColumn("strategy", F.lit("random"))
    for strategy in ("sentence", "topic"):
        made = made.unionByName(phrases.synthetic_negatives(spark, words, "the_and", 100, strategy=strategy, seed=SEED).withColumn("strategy", F.lit(strategy)))
    return made


# Exports and files.


@query(f"WITH {AUDIO} SELECT class, position, label, (64 * (row_number() OVER w - 1))::BIGINT AS start, (64 * row_number() OVER w)::BIGINT AS end FROM audio WINDOW w AS (PARTITION BY class ORDER BY position)")
def ragged_export(spark, sf_dir):
    return exports.ragged(views.audio(spark, sf_dir), "position", ["class"]).select("class", "position", "label", "start", "end")


@query(f"WITH {AUDIO} SELECT position, label, round(list_sum(list_transform(audio, lambda x: x::DOUBLE)), 6) AS total, 64 AS size FROM audio")
def ragged_slices(spark, sf_dir):
    clips = exports.ragged(views.audio(spark, sf_dir).withColumn("split", (F.floor(F.col("position") / 500)).cast("long")), "position", ["split"])
    flat = clips.groupBy("split").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "audio"))), lambda s: s["audio"])).alias("data"))
    total = F.round(F.aggregate("audio", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return exports.ragged_slices(flat, clips.select("split", "position", "start", "end", "label")).select("position", "label", total.alias("total"), F.size("audio").alias("size"))


@query(f"WITH {AUDIO}, m AS (SELECT position, label, list_concat(audio[1:(40 + position % 20)], list_transform(range(greatest(0, 50 - (40 + position % 20))), lambda x: 0.0::FLOAT))[1:50] AS a FROM audio) SELECT position, label, unnest(range(50))::INT AS i, unnest(list_transform(a, lambda x: round(x::DOUBLE, 6))) AS v FROM m")
def dense_matrix(spark, sf_dir):
    clips = views.audio(spark, sf_dir).withColumn("audio", F.slice("audio", F.lit(1), (F.lit(40) + F.col("position") % 20).cast("int")))
    return exports.dense(clips, 50, "position").select("position", "label", F.posexplode("values").alias("i", "__v")).select("position", "label", "i", F.round(F.col("__v").cast("double"), 6).alias("v"))


@query(
    f"""WITH {AUDIO}, c AS (SELECT position AS start, position + class - 3 AS "end", label + (class = 9)::INT * 2 AS label FROM audio), x AS (
SELECT 'bounds' AS rule, 'error' AS severity, 'an end before its start' AS message, count(*) FILTER ("end" < start) AS n FROM c UNION ALL SELECT 'range', 'error', 'an index beyond the data', count(*) FILTER (start < 0 OR "end" > 400) FROM c
UNION ALL SELECT 'labels', 'error', 'a label other than 0 and 1', count(*) FILTER (label NOT IN (0, 1)) FROM c UNION ALL SELECT 'empty', 'warning', 'a clip without samples', count(*) FILTER ("end" = start) FROM c) SELECT * FROM x WHERE n > 0"""
)
def ragged_checks(spark, sf_dir):
    a = views.audio(spark, sf_dir)
    return exports.check_ragged(a.select(F.col("position").alias("start"), (F.col("position") + F.col("class") - 3).alias("end"), (F.col("label") + (F.col("class") == 9).cast("int") * 2).alias("label")), 400)


@query(
    f"""WITH {AUDIO} SELECT 'labels' AS rule, 'error' AS severity, 'a label other than 0 and 1' AS message, count(*) FILTER (class = 9) AS n FROM audio HAVING count(*) FILTER (class = 9) > 0
UNION ALL SELECT 'widths', 'error', 'rows of different widths', 2 FROM audio HAVING count(*) > 0"""
)
def dense_checks(spark, sf_dir):
    a = views.audio(spark, sf_dir)
    return exports.check_dense(a.select("position", F.slice("audio", F.lit(1), (F.lit(60) + F.col("position") % 3).cast("int")).alias("values"), (F.col("label") + (F.col("class") == 9).cast("int") * 2).alias("label")))


@query(f"WITH {AUDIO} SELECT path, 64 AS size, 16000 AS sample_rate, 64 / 16000.0::DOUBLE AS duration, 1 AS channels FROM audio")
def wav_round_trip(spark, sf_dir):
    files = wav.encoded(views.audio(spark, sf_dir).select("path", "audio", "sample_rate"))
    return wav.decoded(files).select("path", F.size("audio").alias("size"), "sample_rate", "metadata.duration", "metadata.channels")


@query(f"WITH {MANIFEST} SELECT path, label, text, voice, backend, duration_ms, sample_rate FROM manifest")
def manifest_round_trip(spark, sf_dir):
    columns = ["path", "label", "text", "voice", "backend", "duration_ms", "sample_rate"]
    lines = jsonl.sparse(views.manifest(spark, sf_dir).select(*columns)).select(F.to_json(F.struct("*")).alias("raw"))
    from larkspan.schemas import MANIFEST as schema
    from larkspan.schemas import MANIFEST_DEFAULTS as defaults

    read = lines.select(F.from_json("raw", schema).alias("m")).select("m.*")
    return read.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()}).select(*columns)


@query()
def synthesis_stub(spark, sf_dir):
    rows = views.phrases(spark, sf_dir)
    voices = phrases.strings(synthesis.KOKORO_VOICES)
    requests = rows.select(F.concat(F.lit("clips/"), F.col("position").cast("string"), F.lit(".wav")).alias("path"), F.col("phrase").alias("text"), F.element_at(voices, (F.col("position") % len(synthesis.KOKORO_VOICES) + 1).cast("int")).alias("voice"), F.lit("kokoro").alias("backend"), F.lit(1.0).alias("speed"))
    return synthesis.synthesize(requests).select("path", F.size("audio").alias("size"), "sample_rate", "duration_ms", "error")


def _rms() -> scoring.Model:
    return lambda a: float(np.sqrt(np.mean(a.astype(np.float64) ** 2)))


@query(f"WITH {WINDOWS} SELECT signal_id, window_start::BIGINT AS window_start, least(window_start + {WINDOW}, n)::BIGINT AS window_end, window_start / 16000.0::DOUBLE AS timestamp, round(sqrt(list_sum(list_transform(audio[window_start + 1:window_start + {WINDOW}], lambda x: x::DOUBLE * x::DOUBLE)) / {WINDOW}), 5) AS prediction FROM starts")
def window_scores(spark, sf_dir):
    return scoring.score(_windows(spark, sf_dir), _rms).withColumn("prediction", F.round("prediction", 5))


@query()
def mined_negatives(spark, sf_dir):
    from larkspan.plans.builder import mine, mined_manifest

    return mined_manifest(mine(views.signals(spark, sf_dir), _rms, 0.12, WINDOW, HOP, 0.02), 0.12).drop("metadata")


@query(f"SELECT doc_id AS key, {U('draw', 'doc_id')} AS u, (floor({U('draw', 'doc_id')} * 7))::INT AS k, md5('{SEED}|draw|' || doc_id) AS order_key FROM documents")
def draws(spark, sf_dir):
    key = F.col("doc_id")
    return views.table(spark, sf_dir, "documents").select(key.alias("key"), uniform(SEED, "draw", key).alias("u"), integer(SEED, "draw", key, 7).alias("k"), order_key(SEED, "draw", key).alias("order_key"))
