"""Operators on documents against brute force, on odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from larkspan.llm import components, decontamination, gray_index, languages, mixing, sharding, simhash, substrings, tokens
from tests.llm.helpers import SCHEMA, corpus, no_docs, odd_docs, odd_rows, words


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)], SCHEMA)


# SimHash.


def slow_print(text, length=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + length]), 42) for i in range(max(1, len(w) - length + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_groups(spark):
    rows = odd_rows()
    got = simhash.near_groups(odd_docs(spark)).collect()
    prints = [slow_print(r[1]) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{p:016x}") for r, p in zip(rows, prints, strict=True))
    groups = slow_groups(prints, 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in set(groups)}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], least[g]) for r, g in zip(rows, groups, strict=True))
    assert simhash.near_groups(no_docs(spark)).count() == 0


@pytest.mark.parametrize(("run_rows", "shared"), [(8192, 1024), (40, 1024), (40, 0), (7, 0)])
def test_links_join_the_same_components_whatever_the_runs_and_blocks(spark, monkeypatch, run_rows, shared):
    monkeypatch.setattr(gray_index, "SHARED", shared)
    rng = random.Random(2)
    bases = [rng.getrandbits(64) for _ in range(25)]
    prints = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in bases for _ in range(14)} | {rng.getrandbits(20) for _ in range(120)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p, p) for p in signed], "node long, print long")
    blocks, leads = gray_index.arrangements(len(prints), 3)
    assert (blocks, len(leads)) == ((4, 4) if shared else (8, 56))
    edges = gray_index.links(df, 3, run_rows)
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    wanted = slow_groups(prints, 3)
    assert Counter(Counter(roots.get(p, p) for p in signed).values()) == Counter(Counter(wanted).values())
    pairs = {}
    for p, g in zip(signed, wanted, strict=True):
        assert pairs.setdefault(g, roots.get(p, p)) == roots.get(p, p)


def test_no_links_of_no_prints(spark):
    assert gray_index.links(spark.createDataFrame([], "node long, print long"), 4).count() == 0


def test_every_search_goes_through_the_index(monkeypatch):
    """However few rows there are."""
    monkeypatch.setattr(gray_index, "GrayIndex", None)
    for n in (1, 2, 500):
        with pytest.raises(TypeError):
            gray_index.stars(np.arange(n, dtype=np.uint64), 4)


def test_work_grows_with_the_rows():
    """Comparisons a row in an arrangement's runs, at two sizes: only leading parts get fuller, and their nodes prune."""
    rng = np.random.default_rng(1)
    work = []
    for n in (1 << 15, 1 << 18):
        prints = np.sort(gray_index.gray_rank(rng.integers(0, 1 << 64, n, dtype=np.uint64)))
        prints = prints ^ (prints >> np.uint64(1))
        done = 0
        for at in range(0, n, gray_index.RUN_ROWS):
            index = gray_index.GrayIndex(prints[at : at + gray_index.RUN_ROWS])
            for _ in index.search(prints[at : at + gray_index.RUN_ROWS], 4, 12):
                pass
            done += index.compared
        work.append(done / n)
    assert work[1] < 2.0 * work[0] and work[1] < 300


def test_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    p = np.unique(np.concatenate([rng.integers(0, 1 << 64, 500, dtype=np.uint64), rng.integers(0, 1 << 12, 300, dtype=np.uint64)]))
    found = set()
    for a, b in gray_index.GrayIndex(p).search(p, 3, block=100):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= 3)), strict=True))
    found = set()
    for a, b in gray_index.GrayIndex(p).search(p, 3, leading=16, block=100):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    apart = p[:, None] ^ p[None]
    assert found == set(zip(*(x.tolist() for x in np.nonzero((np.bitwise_count(apart) <= 3) & (apart >> np.uint64(48) == 0))), strict=True))
    assert sorted(gray_index.gray_rank(np.array([k ^ (k >> 1) for k in range(200)], np.uint64)).tolist()) == list(range(200))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 175)] + [(1000, 1001 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 175: 150, 200: 150, **dict.fromkeys(range(1000, 1051), 1000)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_go_and_others_stay(spark):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(220)) for _ in range(40)]
    near, far = [], []
    for t in base:
        w = t.split()
        near.append(" ".join([*w[:100], "inserted", *w[101:]]))
        far.append(" ".join(x if k % 6 else "other" + x for k, x in enumerate(w)))
    assert min(map(jaccard, base, near)) > 0.9 and max(map(jaccard, base, far)) < 0.4
    kept = {r["doc_id"] for r in simhash.deduplicated(docs_of(spark, base + near + base + far)).collect()}
    assert kept == {*range(40), *range(120, 160)}


@pytest.mark.parametrize("most", [4_000_000, 3000])
def test_copies_with_one_contiguous_change_link_at_the_exact_similarity(spark, most):
    rng = random.Random(11)
    texts = []
    for k in range(240):
        w = words(rng, rng.randrange(60, 400))
        n = len(w)
        cut = rng.randrange(n // 20, n // 4)
        at = rng.randrange(n - cut)
        copy = ([*w, *words(rng, cut)], w[: n - cut], [*w[:at], *words(rng, cut // 2 + 1), *w[at + cut // 2 + 1 :]])[k % 3]
        texts += [" ".join(w), " ".join(copy)]
    # One component of candidates above the limit of 3000 shingles.
    stem = words(rng, 100)
    texts += [" ".join([*stem, *words(rng, 4 + k % 30)]) for k in range(60)]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r["__root"] for r in simhash.similar_groups(docs, most=most).collect()}
    reached = [jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8 for k in range(240)]
    assert 60 < sum(reached) < 200
    assert [got[2 * k] == got[2 * k + 1] for k in range(240)] == reached
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[480 + i], texts[480 + j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    assert 1 < len(set(root)) < 60
    assert len({(a, got[480 + k]) for k, a in enumerate(root)}) == len(set(root)) == len({got[480 + k] for k in range(60)})


def test_candidates_of_near_duplicates_come_through_the_index(spark, monkeypatch):
    rng = random.Random(21)
    texts = [words(rng, 150) for _ in range(6)]
    docs = docs_of(spark, [" ".join(t) for t in texts] + [" ".join([*t, "more"]) for t in texts])
    kinds, whole = [], simhash.links

    def seen(prints, radius):
        kinds.append((radius, {r["node"]: r["print"] for r in prints.where("part = 0").collect()}))
        return whole(prints, radius)

    monkeypatch.setattr(simhash, "links", seen)
    roots = {r["doc_id"]: r["__root"] for r in simhash.similar_groups(docs).collect()}
    assert [roots[k] == roots[6 + k] for k in range(6)] == [True] * 6 and len(set(roots.values())) == 6
    # The first print of each is the fingerprint of op3_simhash, as no shingle is repeated here.
    assert len(kinds) == 1 and kinds[0][0] == 4
    assert set(kinds[0][1].values()) == set(np.array([simhash.fingerprint(" ".join([*t, *more]), 5) for t in texts for more in ([], ["more"])], np.uint64).view(np.int64).tolist())
    monkeypatch.setattr(simhash, "links", lambda prints, radius: whole(prints.limit(0), radius))
    assert len({r["__root"] for r in simhash.similar_groups(docs).collect()}) == 12


def test_links_stay_within_parts(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    rows = [(2 * k + side, side * (k % 2), p ^ (side << 9)) for k, p in enumerate(prints) for side in (0, 1)]
    df = spark.createDataFrame([(n, part, int(np.array(p, np.uint64).view(np.int64))) for n, part, p in rows], "node long, part int, print long")
    assert {tuple(sorted(r)) for r in gray_index.links(df, 4, 7).collect()} == {(2 * k, 2 * k + 1) for k in range(0, 40, 2)}


@pytest.mark.parametrize("n", [100, 300])
def test_close_pairs_are_those_of_any_print(n):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, (n, 3), np.uint64)
    prints[n // 2 :] = prints[: n - n // 2]
    prints[n // 2 :, 1:] ^= rng.integers(0, 1 << 10, (n - n // 2, 2), np.uint64)
    got = [(i, j) for i, others in simhash._close(prints, 4) for j in others.tolist()]
    near = (np.bitwise_count(prints[:, None] ^ prints[None]) <= 4).any(axis=2)
    assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if near[i, j]]


def test_deduplication_keeps_all_columns_of_one_row(spark):
    df = odd_docs(spark)
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids.count(8) == 2 and 2 not in ids and 60 not in ids and 1 in ids
    assert simhash.deduplicated(no_docs(spark)).count() == 0


# Mixing.


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / w > 3 * sizes[s]}
        if not above:
            return out | {s: rest * weight[s] / w for s in open_}
        out |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above


def test_mix(spark):
    rows = odd_rows()
    got = mixing.mix(odd_docs(spark)).collect()
    count = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    wanted = slow_targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted((n, round(t, 6)) for n, t in by_target) == sorted({(sizes[s], round(wanted[s], 6)) for s in sizes})
    for s in sizes:
        same = [x for x in sizes if (sizes[x], round(wanted[x], 6)) == (sizes[s], round(wanted[s], 6))]
        taken = next(sum(v) for k, v in by_target.items() if (k[0], round(k[1], 6)) == (sizes[s], round(wanted[s], 6)))
        assert abs(taken - len(same) * wanted[s]) <= len(same)
    again = mixing.mix(odd_docs(spark).repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_mix_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, "b", 0)], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_rows(spark):
    df = docs_of(spark, corpus(random.Random(1)))
    plan = {r["doc_id"]: r["passes"] for r in mixing.mix(df, cut="document").collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert got == Counter({k: v for k, v in plan.items() if v}) and max(got.values()) <= 3
    odd = odd_docs(spark)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0
    assert mixing.mixed(no_docs(spark)).count() == 0


# Sharding.


def test_curve_is_a_path_through_all_cells(spark):
    from pyspark.sql import functions as F

    cells = spark.range(512).select((F.col("id") % 8).cast("int").alias("x"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), F.floor(F.col("id") / 64).cast("int").alias("z"))
    path = sorted(cells.select("x", "y", "z", sharding.hilbert_index(F.col("x"), F.col("y"), F.col("z"), 3).alias("h")).collect(), key=lambda r: r["h"])
    assert [r["h"] for r in path] == list(range(512))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("shards", [1, 16, 100])
def test_shards(spark, shards):
    rows = odd_rows()
    got = sharding.shard(odd_docs(spark), shards).collect()
    raw = [(r[1] or "").encode() for r in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len(t) + 1, zlib.crc32(t)) for r, t in zip(rows, raw, strict=True))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)


def test_shards_equal_brute_force(spark):
    """Cells, the order along the curve, shards and slots of each row, worked out one by one."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(k, None if k % 17 == 0 else " ".join(words(rng, rng.randrange(60))), rng.choice(["en", "de", "es", None]), rng.choice(["a", "b", "b", "b", "ü", None]), 0) for k in range(333)]
    got = {r["doc_id"]: tuple(r) for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 16).collect()}
    last = lambda v: (v is None, v or "")
    side = 1 << sharding.BITS

    def cell(k):
        values = sorted((r[k] for r in rows), key=last)
        return {v: values.index(v) * side // len(rows) for v in set(values)}

    sources, langs = cell(3), cell(2)
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    length = {i: min(side - 1, int(2 * np.log2(len(t) + 1))) for i, t in raw.items()}
    cells = {i: (sources[s], langs[n], length[i]) for i, _, n, s, _ in rows}
    index = sharding.hilbert_index(F.col("x"), F.col("y"), F.col("z"), sharding.BITS)
    curve = {tuple(r)[:3]: r["h"] for r in spark.createDataFrame(sorted(set(cells.values())), "x int, y int, z int").withColumn("h", index).collect()}
    order = sorted(rows, key=lambda r: (curve[cells[r[0]]], last(r[3]), last(r[2]), len(raw[r[0]]) + 1, r[0]))
    slots = Counter()
    for k, r in enumerate(order):
        shard = k * 16 // len(rows)
        assert got[r[0]] == (r[0], len(raw[r[0]]) + 1, zlib.crc32(raw[r[0]]), curve[cells[r[0]]], shard, slots[shard])
        slots[shard] += 1


def test_ranges_of_metadata_skip_shards(spark):
    """What the order is for: a filter on any of the dimensions rules out most shards by their least and largest values."""
    rng = random.Random(5)
    rows = [(k, "x" * int(2 ** rng.uniform(0, 14)), rng.choice("abcdefgh"), rng.choice("ABCDEFGH"), 0) for k in range(4096)]
    shards = {}
    place = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 64).collect()}
    for r in rows:
        shards.setdefault(place[r[0]], []).append((r[3], r[2], len(r[1])))
    ends = [[(min(c), max(c)) for c in zip(*own, strict=True)] for own in shards.values()]
    read = lambda k, low, high: sum(e[k][0] <= high and low <= e[k][1] for e in ends) / len(ends)
    assert max(read(0, v, v) for v in "ABCDEFGH") < 0.5 and max(read(1, v, v) for v in "abcdefgh") < 0.6 and read(2, 1, 100) < 0.75 and read(2, 8000, 1 << 14) < 0.5
    # Where one dimension alone decides the order, filters on the others read nearly all.
    both = [e for e in ends if e[0][0] <= "C" <= e[0][1] and e[1][0] <= "c" <= e[1][1]]
    assert len(both) < 0.25 * len(ends)


def test_no_shards_of_nothing(spark):
    assert sharding.shard(no_docs(spark)).count() == 0


# Substrings.


def slow_removal(rows, window):
    first = {}
    docs = [(10**18 if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, 10**18), i)
    out = []
    for r, (i, w) in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("depth", "block"), [(1, 1 << 22), (2, 2000), (3, 60_000)])
def test_removal(spark, depth, block):
    rows = odd_rows() + [(100 + k, t, None, None, None) for k, t in enumerate(corpus(random.Random(3)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = substrings.digests(substrings.removed_windows(df, 13, depth, block)).collect()
    assert Counter(map(tuple, got)) == slow_removal(rows, 13)


def test_removal_with_ranges(spark, monkeypatch):
    rows = [(k, t, None, None, None) for k, t in enumerate(corpus(random.Random(9)))]
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 300)
    monkeypatch.setattr(substrings, "CELLS_PER_WINDOW", 1)
    run = substrings.Sketching(13, 5000, 2)
    assert run.range_bits > 3
    got = substrings.digests(substrings.removed_windows(spark.createDataFrame(rows, SCHEMA), 13, 2, 1500)).collect()
    assert Counter(map(tuple, got)) == slow_removal(rows, 13)


def test_windows_are_not_hashed_again_for_removal(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 300)
    rows = [(k, t, None, None, None) for k, t in enumerate(corpus(random.Random(13)))]
    blocks = substrings.pack_blocks(spark.createDataFrame(rows, SCHEMA), 13, 4000).toPandas()
    run = substrings.Sketching(13, int(blocks["windows"].sum()), 2)
    assert len(blocks) > 3 and run.range_bits > 2
    masks = pd.concat([run.merge(own) for _, own in pd.concat(run.sketch([blocks])).groupby("owner")])
    single = [(blocks.iloc[[k]], number) for k, number in enumerate(blocks["block"])]
    asked = pd.concat([run.candidates(own, masks[masks["block"] == number]) for own, number in single])
    # One note a block, and not all with one owner.
    notes = asked[asked["note"].notna()]
    assert notes["block"].is_unique and set(notes["block"]) == set(asked["block"]) and notes["owner"].nunique() > 2
    told = pd.concat([run.smallest(own) for _, own in asked.groupby("owner")])
    monkeypatch.setattr(substrings, "Block", None)
    got = pd.concat([run.remove(own, told[told["block"] == number]) for own, number in single])
    digests = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.itertuples()]
    assert Counter(digests) == slow_removal(rows, 13) and got["n_removed"].sum() > 0


@pytest.mark.parametrize("window", [1, 2, 8, 13])
def test_window_hashes_are_sums_over_words(spark, window):
    own = [f"w{k % 17}" for k in range(60)]
    blob = substrings.pack_blocks(spark.createDataFrame([(1, " ".join(own))], "doc_id long, text string"), window).first()["blob"]
    block = substrings.Block(blob, window)
    hashes = substrings._words.look_up([w.encode() for w in own]).tolist()
    for side, got in enumerate((block.high, block.low)):
        base = int(substrings._BASE[side])
        sums = [sum(hashes[at + k][side] * pow(base, k, 1 << 64) for k in range(window)) % (1 << 64) for at in range(61 - window)]
        assert got.tolist() == substrings._mix(np.array(sums, np.uint64), side + 1).tolist()


def test_removal_of_nothing(spark):
    assert substrings.removed_windows(no_docs(spark)).count() == 0
    assert substrings.removed_windows(odd_docs(spark)).columns == ["doc_id", "n_words", "n_removed", "kept"]
    short = spark.createDataFrame([(1, "a b", None, None, 0), (2, None, None, None, 0)], SCHEMA)
    assert sorted(map(tuple, substrings.removed_windows(short).collect())) == [(1, 2, 0, "a b"), (2, 0, 0, "")]


@pytest.mark.parametrize("total", range(15))
def test_blocks_of_few_words(spark, total):
    own = [f"w{k}" for k in range(total)]
    blob = substrings.pack_blocks(spark.createDataFrame([(1, " ".join(own))], "doc_id long, text string"), 13).first()["blob"]
    block = substrings.Block(blob, 13)
    assert len(block.high) == len(block.low) == max(0, total - 12) and block.counts.tolist() == [total]


# Tokens.

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    path = pytest.importorskip("public_tokenizers").path(FILE)
    from tokenizers import Tokenizer

    return path, Tokenizer.from_file(path)


def test_counts_equal_the_library(spark, library):
    path, own = library
    rows = odd_rows()
    got = tokens.token_counts(odd_docs(spark), path).collect()
    wanted = [(r[0], len((r[1] or "").encode()), len(own.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert Counter(tuple(r)[:3] for r in got) == Counter(wanted)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokens.token_counts(no_docs(spark), path).count() == 0


def test_counts_of_random_texts(library):
    path, own = library
    compiled = tokens.Tokenizer(open(path).read())
    rng = random.Random(8)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'d", "''", " ", "  ", "\n", "\t", " ", "　", "a", "re", "lle", "é", "1", "²", "!", "...", "<|endoftext|>", "日本", "́", "'S", "x" * 70, "ab" * 90, "🙂", "_", "\0", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)] + ["".join(rng.choices(parts, k=3000))]
    assert compiled.counts(texts) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_scan_composes_maps():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 6, (37, 6)).astype(np.uint8)
    state, wanted = 0, []
    for m in maps:
        wanted.append(state)
        state = m[state]
    assert tokens.scan(maps).tolist() == wanted


PIECES = [" tokenization", "aaaaaaaa", "日本語", "x" * 200, " unbelievably", "=" * 33, "ababab", " " * 150, "étranger", "qzjxkvw"]


def test_outputs_along_a_path_sum_to_the_count(library):
    path, own = library
    run = tokens.Tokenizer(open(path).read()).tokens
    for piece in PIECES:
        raw, state, total = piece.encode(), 0, 0
        for k, byte in enumerate(raw):
            step = run.compile_step(state, byte)
            state, total = step >> 16, total + (step & 0xFFFF) - (1 << 15)
            # After each transition the sum is the count of the prefix.
            assert total == len(run.merged(raw[: k + 1]))
        assert total == run.run(raw) == run.count(raw) == len(own.encode(piece, add_special_tokens=False).ids)


def test_the_query_counts_by_transitions(library, monkeypatch):
    path, own = library
    compiled = tokens.Tokenizer(open(path).read())
    monkeypatch.setattr(tokens.TokenTransducer, "merged", None)
    before = len(compiled.tokens.steps)
    assert compiled.counts([" ".join(PIECES)]) == [len(own.encode(" ".join(PIECES), add_special_tokens=False).ids)]
    assert before == 0 and len(compiled.tokens.steps) >= sum(len(set(p)) > 1 for p in PIECES)


def test_pairs_that_stay_are_those_that_merging_leaves(library):
    run = tokens.Tokenizer(open(library[0]).read()).tokens
    rng = random.Random(3)
    every = [t for t, s in run.spelled.items() if len(s) == 1 or run.merged(s) == [t]]
    same = [t for t in every if len(set(run.spelled[t])) == 1][:100]
    for left, right in [(rng.choice(every), rng.choice(every)) for _ in range(20_000)] + list(itertools.product(same, same)):
        assert run.stays(left, right) == (run.merged(run.spelled[left] + run.spelled[right]) == [left, right])


def test_counts_stay_when_states_are_dropped(library, monkeypatch):
    path, own = library
    compiled = tokens.Tokenizer(open(path).read())
    monkeypatch.setattr(tokens, "KEPT_BYTES", 20_000)
    texts = corpus(random.Random(5), 200)
    assert compiled.counts(texts) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


# Languages.


def speech(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


SYLLABLES = {"en": ["the", "ing", "tion", "ough", "wh", "ly"], "de": ["sch", "ein", "ung", "ü", "pf", "keit"], "es": ["ción", "ado", "ñ", "ll", "que", "os"]}


def test_languages(spark):
    rng = random.Random(6)
    rows = [(k, speech(rng, SYLLABLES[lang], rng.randrange(5, 80)), lang, "s", 0) for k in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    half = speech(rng, SYLLABLES["en"], 90) + " " + speech(rng, SYLLABLES["de"], 60)
    rows += [(1000, None, "en", None, 0), (1001, "123 !!", "en", None, 0), (1002, "", None, None, 0), (None, rows[0][1], None, None, 0), (1003, half, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = languages.identify(df.withColumn("score", F.lit("x"))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i]["lang_pred"] == languages.NONE and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == rows[0][2] and by_id[None]["held_out"] is False
    assert [x["lang"] for x in by_id[1003]["languages"]][:2] == ["en", "de"] and 0.45 < by_id[1003]["score"] < 0.75
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(by_id[r[0]]["held_out"] for r in held)
    assert sum(by_id[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    rng = random.Random(6)
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    df = spark.createDataFrame([(k, speech(rng, SYLLABLES["en"], 9), "held" if k in ids else "en", "s", 0) for k in range(200)], SCHEMA)
    assert languages.learn(df).names == ["en"]


def test_languages_of_odd_rows(spark):
    df = odd_docs(spark)
    assert languages.identify(df).count() == len(odd_rows())
    kept = languages.recognised(df)
    assert kept.columns == df.columns
    assert {1, 7, 9, 11, 13} <= {r["doc_id"] for r in kept.collect()} and not {4, 5, 6, 10} & {r["doc_id"] for r in kept.collect()}
    assert languages.identify(no_docs(spark)).count() == 0 and languages.recognised(no_docs(spark)).count() == 0


def test_more_than_five_languages_in_a_text():
    rng = random.Random(2)
    names = [f"l{k}" for k in range(8)]
    texts = {n: " ".join("".join(rng.choices([a + b for a in "abcdefghijklmnopqrstuvwxyz"[3 * k : 3 * k + 3] for b in "aeiou"], k=3)) for _ in range(300)) for k, n in enumerate(names)}
    counts = np.array([np.bincount(languages.trigrams(texts[n]), minlength=languages.BUCKETS) for n in names]).T
    own = counts / counts.sum(axis=0)
    model = languages.Model(names, np.log(0.95 * own + 0.045 * own.mean(axis=1, keepdims=True) + 0.005 / languages.BUCKETS))
    found = languages.infer(model, " ".join(texts[n][:900] for n in names[:7]))
    assert {n for n, _ in found} == set(names[:7]) and all(0.1 < p < 0.2 for _, p in found)


def test_shares_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    probs, counts = rng.random((40, 3)) + 0.01, rng.integers(1, 9, 40)
    pi = [1 / 3] * 3
    for _ in range(30):
        new = [0.0] * 3
        for n, row in zip(counts, probs, strict=True):
            whole = sum(p * x for p, x in zip(pi, row, strict=True))
            for k in range(3):
                new[k] += n * pi[k] * row[k] / whole / counts.sum()
        done = max(abs(a - b) for a, b in zip(new, pi, strict=True)) < 1e-4
        pi = new
        if done:
            break
    found, likelihood = languages.shares(counts, probs, np.full(3, 1 / 3))
    assert np.allclose(found, pi, atol=1e-12)
    assert np.isclose(likelihood, sum(n * np.log(sum(p * x for p, x in zip(pi, row, strict=True))) for n, row in zip(counts, probs, strict=True)))


def test_language_sets_equal_those_of_all_subsets():
    """Of all sets of languages, that of the largest penalised likelihood, each fitted by itself."""
    rng = random.Random(13)
    kinds = list(SYLLABLES)
    counts = np.array([np.bincount(languages.trigrams(speech(rng, SYLLABLES[n], 3000)), minlength=languages.BUCKETS) for n in kinds], float).T
    own = counts / counts.sum(axis=0)
    model = languages.Model(kinds, np.log(0.95 * own + 0.045 * own.mean(axis=1, keepdims=True) + 0.005 / languages.BUCKETS))
    same = 0
    for _ in range(40):
        text = " ".join(speech(rng, SYLLABLES[n], rng.randrange(8, 120)) for n in rng.sample(kinds, rng.randrange(1, 4)))
        buckets, n = np.unique(languages.trigrams(text), return_counts=True)
        probs, total = np.exp(model.logs[buckets]), n.sum()
        penalty = 0.5 * np.log(max(2.0, total / languages.OVERLAP)) + 1.0
        best = max((languages.shares(n, probs[:, list(c)], np.full(len(c), 1 / len(c)), 300)[1] / languages.OVERLAP - penalty * len(c), c) for size in (1, 2, 3) for c in itertools.combinations(range(3), size))
        same += {x for x, _ in languages.infer(model, text)} == {kinds[k] for k in best[1]}
    assert same >= 39


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None, None, 0)], SCHEMA)
    assert [tuple(r)[2:4] for r in languages.identify(df).collect()] == [(languages.NONE, 0.0)]


# Decontamination.

BENCH = "item_id long, text string"


def test_overlaps_with_and_without_substitutions(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(3000)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [pick(rng.randrange(15, 50)) for _ in range(20)] + [pick(5)]
    rows, planted = [], set()
    for k in range(60):
        own = pick(200)
        if k % 3 == 0:
            item = items[k // 3]
            copy = [w.upper() + "," if j % 2 else w for j, w in enumerate(item)]
            if k % 2 and len(copy) > 10:
                copy[len(copy) // 2] = "replaced"
            at = rng.randrange(len(own))
            own[at:at] = copy
            planted.add((k, k // 3))
        rows.append((k, " ".join(own), None, None, 0))
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (None, " ".join(items[2]), None, None, 0), (102, " ".join(items[20]), None, None, 0), (103, " ".join(items[3][:9]), None, None, 0)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(0, " ".join(items[0])), (98, None), (99, "")], BENCH)
    df = spark.createDataFrame(rows, SCHEMA)
    for tokens_per_block in (2_000_000, 60):
        got = decontamination.contaminations(df, bench, block_tokens=tokens_per_block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == planted | {(None, 2), (102, 20)}
        assert len(got) == len(planted) + 2
    for r in got:
        assert r["span"] >= min(13, len(items[r["item_id"]])) and r["agreeing"] >= 0.75 * r["span"]
    kept = {r["doc_id"] for r in decontamination.decontaminated(df, bench, block_tokens=60).collect()}
    assert kept == {r[0] for r in rows} - {k for k, _ in planted} - {None, 102}


def test_contamination_of_odd_rows(spark):
    df, bench = odd_docs(spark), spark.createDataFrame([(1, odd_rows()[0][1])], BENCH)
    assert {r["doc_id"] for r in decontamination.contaminations(df, bench).collect()} == {1, 2, 3, None, 60}
    assert decontamination.contaminations(df, bench).where("doc_id = 60").count() == 3
    clean = decontamination.decontaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == len(odd_rows()) - 7
    none = spark.createDataFrame([], BENCH)
    assert decontamination.contaminations(df, none).count() == 0 and decontamination.decontaminated(df, none).count() == len(odd_rows())
    assert decontamination.contaminations(no_docs(spark), bench).count() == 0 and decontamination.decontaminated(no_docs(spark), bench).count() == 0


def test_items_with_one_template_are_compared_in_turns(monkeypatch):
    rng = random.Random(3)
    template = words(rng, 12)
    rows = [(k, [*template, *words(rng, 20)]) for k in range(60)]
    block = decontamination.seeds(rows)
    texts = [" ".join([*words(rng, 15), *template] * 8), " ".join([*words(rng, 9), *rows[7][1], *template, *rows[31][1][4:]]), None, ""]
    whole = decontamination.overlaps(block, texts)
    assert {(t, k) for t, k, *_ in whole} >= {(1, 7), (1, 31)}
    for most in (1, 50, 1000):
        monkeypatch.setattr(decontamination, "HITS", most)
        assert decontamination.overlaps(block, texts) == whole


def test_any_run_that_reaches_the_limits_counts():
    rng = np.random.default_rng(6)
    for n in (13, 14, 15, 20, 40):
        for _ in range(300):
            item = np.arange(1, n + 1)
            copy = np.where(rng.random(n) < rng.choice([0.1, 0.25, 0.5]), 0, item)
            before = int(rng.integers(0, 5))
            text = np.concatenate([np.zeros(before, np.int64), copy, np.zeros(3, np.int64)])[int(rng.integers(0, 3)) :]
            shift = before - (before + n + 3 - len(text))
            low, high = max(0, -shift), min(n, len(text) - shift)
            same = [item[i] == text[i + shift] for i in range(low, high)]
            wanted = any(4 * sum(same[i:j]) >= 3 * (j - i) for i in range(len(same)) for j in range(i + 13, len(same) + 1))
            got = decontamination.qualifying_overlap(item, text, shift, 13, 0.75)
            assert (got is not None) == wanted
            if got:
                assert got[1] >= 13 and 4 * got[2] >= 3 * got[1] and got[2] == sum(same[got[0] - low : got[0] - low + got[1]])


def test_a_substitution_near_an_end_does_not_hide_an_item():
    rng = random.Random(8)
    item = words(rng, 15)
    block = decontamination.seeds([(7, item)])
    for at in range(15):
        copy = [*words(rng, 9), *item[:at], "replaced", *item[at + 1 :], *words(rng, 9)]
        assert [(t, k) for t, k, *_ in decontamination.overlaps(block, [" ".join(copy)])] == [(0, 0)], at


def test_masks_ignore_their_gaps():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 14, dtype=np.uint64)
    for mask in decontamination.MASKS + decontamination.SHORT_MASKS:
        b = a[: len(mask)].copy()
        b[[k for k, c in enumerate(mask) if c == "0"]] = 5
        assert decontamination.masked(b, mask)[0] == decontamination.masked(a[: len(mask)], mask)[0]
        assert mask.count("1") == (6 if mask in decontamination.MASKS else 3)


@pytest.mark.parametrize("length", range(4, 26))
def test_masks_meet_every_placement_of_differences(length):
    """Runs of 13 to 25 tokens, and whole items of 4 to 12: each with as many differences as the limits allow."""
    masks = decontamination.MASKS if length >= decontamination.SPAN else decontamination.SHORT_MASKS
    differences = length - -(-3 * length // 4)
    placed = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(length), differences)], np.int64)
    for mask in masks:
        own = sum(1 << k for k, c in enumerate(mask) if c == "1")
        for shift in range(length - len(mask) + 1):
            placed = placed[(placed & (own << shift)) != 0]
    assert not len(placed)


@pytest.mark.parametrize("length", [6, 9, 13, 16, 40])
def test_every_placement_is_found_by_brute_force(length):
    rng = random.Random(length)
    item = [f"w{k}" for k in range(length)]
    block = decontamination.seeds([(7, item)])
    least = min(13, length)
    every = list(itertools.combinations(range(least), least - -(-3 * least // 4)))
    for start in {0, length - least}:
        texts = []
        for places in every:
            copy = list(item[start : start + least])
            for k in places:
                copy[k] = "other"
            texts.append(" ".join(["before"] * rng.randrange(3) + copy + ["after"] * rng.randrange(3)))
        assert {t for t, *_ in decontamination.overlaps(block, texts)} == set(range(len(texts)))
    # And what stays below the limits isn't.
    far = [" ".join("other" if k in places else w for k, w in enumerate(item[:least])) for places in itertools.islice(itertools.combinations(range(least), least // 4 + 1), 200)]
    assert decontamination.overlaps(block, far) == []


def test_contaminations_equal_brute_force(spark):
    """All pairs of texts, items and shifts, all runs."""
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(25)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 5, 8, 12, 13, 17, 22, 30)]
    texts = []
    for _ in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
        copy = [w if rng.random() > rng.choice([0.0, 0.15, 0.25, 0.3]) else rng.choice(vocabulary) for w in rng.choice(items)]
        texts.append(own[:9] + copy[rng.randrange(3) :] + own[9:])
    wanted = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            least = min(13, len(item))
            for shift in range(-len(item) + 1, len(text)):
                same = [item[k] == text[k + shift] for k in range(max(0, -shift), min(len(item), len(text) - shift))]
                if any(4 * sum(same[a:b]) >= 3 * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1)):
                    wanted.add((t, i))
    docs = docs_of(spark, [" ".join(t) for t in texts])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], BENCH)
    for block in (40, 10_000):
        got = decontamination.contaminations(docs, bench, block_tokens=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == wanted and len(got) == len(wanted)
        clean = {r["doc_id"] for r in decontamination.decontaminated(docs, bench, block_tokens=block).collect()}
        assert clean == set(range(len(texts))) - {t for t, _ in wanted}
