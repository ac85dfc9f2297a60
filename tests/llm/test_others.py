"""Archives, secrets, neighbours, the pipeline, and the registered queries."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import neighbours, queries, secret_scan, warc
from tests.compare import by_duckdb, by_spark
from tests.llm.helpers import CLASH, SCHEMA, no_docs, odd_docs, odd_rows

PAGES = "page_id long, url string, html string"


# Archives.


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\nWARC/1.0\n</p>", b"", b"plain\n\n\nfiledesc://x 0 0 0 5\n", b"HTTP/1.0 404 Not\n\nbody"]
    data = warc.write_arc("x.arc", version, [(f"http://h/{k}", "1.2.3.4", "20200102030405", "text/html", b) for k, b in enumerate(bodies)])
    for raw in (data, gzip.compress(data)):
        got = list(warc.read_arc("x.arc", raw))
        assert [r.body for r in got] == bodies
        assert [r.fields["url"] for r in got] == [f"http://h/{k}" for k in range(4)]
    assert got[0].date == "2020-01-02T03:04:05Z" and len({r.identifier for r in got}) == 4
    assert got[3].http() == (b"HTTP/1.0 404 Not\n\n", b"body") and got[2].http() is None


@pytest.mark.parametrize(("digits", "date"), [("20200102", "2020-01-02T00:00:00Z"), ("202001020304", "2020-01-02T03:04:00Z"), ("", "1970-01-01T00:00:00Z"), ("20209902", "1970-01-01T00:00:00Z"), ("2020", "2020-01-01T00:00:00Z")])
def test_short_dates(digits, date):
    assert warc.ArcRecord("a", 0, {"date": digits}, b"").date == date


def test_broken_arc():
    good = warc.write_arc("x.arc", 1, [("http://h/", "1.2.3.4", "2020", "text/html", b"abc")])
    for bad, said in ((good[:-3], "beyond"), (b"http://x 0 0 t 3\nabc", "description"), (good.replace(b"1 0 larkspan", b"7 0 larkspan"), "version"), (good.replace(b"text/html 3", b"text/html x"), "length")):
        with pytest.raises(warc.ArcError, match=said):
            list(warc.read_arc("x", bad))
    assert list(warc.read_arc("x", b"")) == []


def test_warc_records_are_checked():
    record = warc.ArcRecord("a", 3, {"url": "http://h/", "ip": "1.2.3.4", "date": "2020", "type": "text/html"}, b"HTTP/1.1 200 OK\r\n\r\nhello")
    whole = warc.to_warc(record) + b"\r\n\r\n"
    revisit = warc.to_warc(record, ("<urn:uuid:1>", "http://g/", "2019-01-01T00:00:00Z")) + b"\r\n\r\n"
    dns = warc.to_warc(warc.ArcRecord("a", 9, {"url": "dns:h", "type": "text/dns"}, b"h 1.2.3.4")) + b"\r\n\r\n"
    other = warc.to_warc(warc.ArcRecord("a", 9, {"url": "ftp://h", "type": "text/plain"}, b"x")) + b"\r\n\r\n"
    for data in (whole + revisit + dns + other, gzip.compress(whole) + gzip.compress(revisit + dns) + gzip.compress(other)):
        got = list(warc.read_warc("f", data))
        assert [r.headers["warc-type"] for r in got] == ["response", "revisit", "response", "resource"]
    assert got[0].payload == b"hello" and got[1].payload == b"" and got[1].headers["warc-refers-to"] == "<urn:uuid:1>"
    assert got[0].headers["warc-payload-digest"] == got[1].headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    for bad, said in ((whole.replace(b"hello", b"hallo"), "digest"), (whole[:-8], "beyond"), (b"WARC/1.0\r\nA: b", "end of headers"), (b"nothing\r\n\r\n", "in place"), (gzip.compress(whole)[:-9], "gzip member")):
        with pytest.raises(warc.WarcError, match=said):
            list(warc.read_warc("f", bad))
    assert list(warc.read_warc("f", b"")) == []


def test_pages(spark):
    long = "x" * 120
    rows = [(5, "u", long), (3, "http://a b/ü\n", long), (3, "v", long), (9, None, long), (None, "n", long), (1, "u", "small"), (2, "u", "small"), (4, None, None), (6, "", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "ü🙂" * 3000), (None, None, None), (10, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("extra") for c in CLASH})
    got = warc.pages_through_warc(df).collect()
    wanted = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None) if len(raw) >= 100 else None
        again = first is not None and i != first
        wanted.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert Counter(map(tuple, got)) == Counter(wanted)
    assert warc.pages_through_warc(spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_ids_with_other_bodies_of_one_length(spark):
    """Two partitions whose records agree in all but their bodies: no body may be taken for another's."""
    a, b = "a" * 120, "b" * 120
    df = spark.sparkContext.parallelize([(0, "x", a), (1, "u", a), (1, "u", b)], 3).toDF(PAGES)
    got = Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.pages_through_warc(df).collect())
    da, db = (hashlib.sha256(x.encode()).hexdigest() for x in (a, b))
    assert got == Counter([(0, da, "response", None), (1, da, "revisit", 0), (1, db, "response", None)])


def test_files_have_a_member_a_record_and_end_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(rng.choices("abcdef <>", k=rng.randrange(4000)))) for k in range(300)] + [(300, "http://h/long", rng.randbytes(9_000_000).hex())]
    arcs = warc.pages_as_arc(spark.createDataFrame(rows, PAGES).coalesce(2), 50_000)
    for size in (40_000, 1 << 30):
        folder = f"{tmp_path}/{size}"
        warc.convert(arcs, folder, file_bytes=size)
        found, files = set(), sorted(p for p in (tmp_path / str(size)).iterdir() if p.name.endswith(".warc.gz"))
        for p in files:
            rest = p.read_bytes()
            records = list(warc.read_warc(p.name, rest))
            assert len(rest) <= size or len(records) == 1
            members = []
            while rest:
                one = zlib.decompressobj(31)
                members.append(one.decompress(rest))
                rest = one.unused_data
            assert len([m for m in members if m]) == len(records) and all(m.startswith(b"WARC/1.1\r\n") for m in members if m)
            found |= {int(r.http_headers["x-page-id"]) for r in records}
        assert found == set(range(301)) and (len(files) > 5) == (size == 40_000)


# Secrets.


@pytest.fixture(scope="module")
def scanner(spark):
    return secret_scan.train(secret_scan.labelled_findings(spark))


def test_findings(spark, scanner):
    token, key = hashlib.sha1(b"t").hexdigest(), "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6"
    texts = [
        f'words token = "{token}" more', f"commit {token} was made", f"use {key} here", "password: changeme_changeme_1 now", "see 4401553578478930 there", "a verylongwordwithoutanydigits b", "id 123e4567-e89b-12d3-a456-426614174000 x", None, "", f'token = "{token}"' * 3,
    ]
    df = spark.createDataFrame([(k, t, None, "src1" if k else None, 0) for k, t in enumerate(texts)], SCHEMA).withColumns({c: F.lit("extra") for c in CLASH})
    got = secret_scan.scan_documents(df, scanner).collect()
    found = {(r["doc_id"], r["candidate"]): r["is_secret"] for r in got}
    assert found[0, token] and found[2, key] and found[9, token]
    assert not found[1, token] and not found[3, "changeme_changeme_1"] and not found[4, "4401553578478930"] and not found[6, "123e4567-e89b-12d3-a456-426614174000"]
    assert not any(i in (5, 7, 8) for i, _ in found) and sum(r["doc_id"] == 9 for r in got) == 3
    assert all(texts[r["doc_id"]][r["start"] - 1 :].startswith(r["candidate"]) and 0 <= r["score"] <= 1 for r in got)
    assert secret_scan.scan_documents(no_docs(spark), scanner).count() == 0
    assert secret_scan.scan_documents(odd_docs(spark), scanner).columns == ["doc_id", "start", "candidate", "score", "is_secret"]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums_in_blocks(spark, n):
    blocks = secret_scan.in_blocks(F.col("x"))
    before = secret_scan.running_sums(F.transform(blocks, secret_scan.total))
    whole = F.flatten(F.transform(blocks, lambda own, k: secret_scan.running_sums(own, F.element_at(before, k + 1) - secret_scan.total(own))))
    numbers = [k * 7 % 13 for k in range(n)]
    assert spark.createDataFrame([(numbers,)], "x array<long>").select(whole).first()[0] == np.cumsum(numbers).tolist()


def test_findings_of_a_very_long_text(spark, scanner):
    """Offsets come in time in proportion to the text, and each candidate lies where its offset says."""
    text = " ".join(f"commit {k:040x} {'ü' * (k % 3)}und" for k in range(30_000))
    got = secret_scan.candidates(spark.createDataFrame([(1, text, "src")], "doc_id long, text string, path string")).orderBy("start").collect()
    assert len(got) == 30_000
    assert all(text[r["start"] - 1 : r["start"] + 39] == r["candidate"] == f"{k:040x}" and text[: r["start"] - 1].endswith(r["before"]) for k, r in enumerate(got))


def test_held_out_findings(spark, scanner):
    other = secret_scan.labelled_findings(spark, 20_000).exceptAll(secret_scan.labelled_findings(spark))
    from pyspark.ml.feature import VectorAssembler

    scored = scanner.forest.transform(VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="__features").transform(secret_scan.features(other)))
    right = scored.agg(F.avg((F.col("label") == F.col("__prediction")).cast("double"))).first()[0]
    assert right > 0.95


def written_forms():
    """(text, the secret in it or None, form): written by hand, with values from a generator of its own."""
    rng = random.Random(77)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    typed = lambda: "".join(rng.choices("abcdefgh", k=4)) + rng.choice("@!#$") + "".join(rng.choices("ABCDEFG", k=3)) + rng.choice("!%*") + str(rng.randrange(10, 9999))
    out = []
    for _ in range(6):
        for value in (hexes(40), mixed(32), typed()):
            out += [
                (f"run with\nTOKEN={value}\nand go", value, "unquoted"), (f"export DB_PASSWORD={value} && ./start", value, "unquoted"), (f"aws_secret_access_key={value}\nregion=eu", value, "unquoted"), (f"the api_key={value}", value, "unquoted"),
                (f'conn.password = "{value}";', value, "quoted"), (f"client_secret='{value}',", value, "quoted"), (f'aws_secret_access_key = "{value}"', value, "quoted"), (f'{{"auth_token": "{value}", "id": 7}}', value, "quoted"),
                (f"db:\n  host: x\n  password: {value}\n", value, "yaml"), (f"  apiKey: {value}\n  retries: 3", value, "yaml"),
            ]
        value = mixed(36)
        out += [(f"https://api.site.io/v1?user=3&access_token={value}&page=2", value, "url"), (f"GET /cb?token={value} HTTP/1.1", value, "url"), (f"Authorization: Bearer {value}\nAccept: */*", value, "header"), (f"X-Auth-Token: {value}\n", value, "header")]
        akia, gh = "AKIA" + mixed(16).upper(), "ghp_" + mixed(36)
        out += [(f"aws_access_key_id={akia}", akia, "prefix"), (f"use {akia} for it", akia, "prefix"), (f"git clone https://{gh}@github.site/x", gh, "prefix"), (f"GH = {gh}", gh, "prefix")]
        out += [
            (f"fixed in commit {hexes(40)} today", None, "hash"), (f"sha256: {hexes(64)}", None, "hash"), (f"etag={hexes(32)}", None, "hash"), (f"md5sum {hexes(32)} file.iso", None, "hash"), (f"uuid {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)} x", None, "hash"),
            ("password: changeme", None, "placeholder"), ('token = "your-token-here"', None, "placeholder"), ("API_KEY=xxxxxxxxxxxxxxxx", None, "placeholder"), ("secret: ${VAULT_SECRET}", None, "placeholder"), ("api_key = os.environ['KEY']", None, "code"), ("token = get_session_token()", None, "code"), ("password = request.form.password", None, "code"),
            ("password: required", None, "word"), ("the token: optional", None, "word"), ("auth: enabled", None, "word"), ("see documentation/reference/manual_2.html", None, "path"), (f"call +49 {rng.randrange(10**15, 10**16)} now", None, "number"), ("verlängerungsverwaltungstätigkeit", None, "word"), ("getUserSessionManagerFactory(", None, "code"),
        ]
    return out


def test_forms_that_people_write(spark, scanner):
    forms = written_forms()
    df = spark.createDataFrame([(k, t, None, "src1", 0) for k, (t, _, _) in enumerate(forms)], SCHEMA)
    said = {}
    for r in secret_scan.scan_documents(df, scanner).where("is_secret").collect():
        said.setdefault(r["doc_id"], set()).add(r["candidate"])
    hit, wanted, wrong = Counter(), Counter(), Counter()
    for k, (_, value, form) in enumerate(forms):
        wanted[form] += value is not None
        hit[form] += value in said.get(k, ())
        wrong[form] += len(said.get(k, set()) - {value})
    assert all(hit[f] >= 0.9 * n for f, n in wanted.items()), (hit, wanted, wrong)
    assert sum(hit.values()) >= 0.9 * (sum(hit.values()) + sum(wrong.values())), (hit, wanted, wrong)


def test_secrets_of_the_tables_are_found_and_nothing_else(spark, scanner, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    planted = set()
    for r in docs.where("text is not null").collect():
        planted |= {(r["doc_id"], m.start(1) + 1, m.group(1)) for m in re.finditer(r'(?i)token\s*=\s*"([0-9a-f]{40})"', r["text"])}
    got = {(r["doc_id"], r["start"], r["candidate"]) for r in secret_scan.scan_documents(docs, scanner).where("is_secret").collect()}
    assert planted and got == planted


def test_scan_has_no_python(spark, scanner):
    plan = secret_scan.scan_documents(odd_docs(spark), scanner)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Neighbours.

VECTORS = "vec_id long, embedding array<float>, label int"


def slow_search(rows, every, most):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            scored = sorted((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:most]]
    return out


def test_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(k, (rng.choice(centres) + 0.4 * rng.normal(size=24) if k % 2 else rng.normal(size=24) * rng.uniform(0.2, 2)).astype(np.float32).tolist()) for k in range(1500)]
    rows += [(1500 + k, rows[20][1]) for k in range(300)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({c: F.lit("extra") for c in CLASH})
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = slow_search(rows, 20, 20)
    assert set(got) == set(wanted)
    x = dict(rows)
    hit = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == float((np.array(x[q], np.float64) * np.array(x[i], np.float64)).sum()) and i != q
        hit += len({i for _, i, _ in found} & {i for i, _ in wanted[q]})
    assert hit / (20 * len(wanted)) >= 0.9
    assert [i for _, i, _ in got[20]] == [i for i, _ in wanted[20]]


def test_small_parts_and_groups_give_the_same(spark, monkeypatch):
    """Parts change how early a query stops, so what all of them find is a superset of the whole's reach: with all boxes in reach, they agree."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(size=8).astype(np.float32).tolist(), 0) for k in range(400)], VECTORS)
    monkeypatch.setattr(neighbours, "_factor", lambda *_: 1e6)
    whole = sorted(map(tuple, neighbours.search(df, 5, 10).collect()))
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 7)
    monkeypatch.setattr(neighbours, "plan", lambda *_: (3, 2, 16))
    assert sorted(map(tuple, neighbours.search(df, 5, 10).collect())) == whole


def test_queries_with_too_few_candidates_are_scanned(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(300)]
    monkeypatch.setattr(neighbours, "_factor", lambda *_: 0.0)
    monkeypatch.setattr(neighbours, "plan", lambda *_: (12, 2, 1000))
    got = {}
    for r in neighbours.search(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), 10, 15).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in found] for q, found in slow_search(rows, 10, 15).items()}


def test_probes_are_all_boxes_within_reach_in_order():
    rng = np.random.default_rng(7)
    p, start, limit = rng.normal(size=(9, 3)), rng.uniform(0, 1, 9), rng.uniform(0.5, 9, 9)
    query, box, score = neighbours.probes(p, start, limit)
    every = np.array(np.meshgrid(*[np.arange(-6, 7)] * 3)).reshape(3, -1).T
    for k in range(9):
        scores = start[k] + neighbours.box_score(np.repeat(p[k : k + 1], len(every), axis=0), every)
        near = scores <= limit[k]
        mine = query == k
        assert set(box[mine].tolist()) == set(neighbours.packed(every[near]).tolist()) and (np.diff(score[mine]) >= 0).all()
        if mine.any():
            # The first is the query's own box.
            assert box[mine][0] == neighbours.packed(neighbours.cells(p[k : k + 1]))[0] and score[mine][0] == start[k]


def test_only_visited_buckets_are_fetched():
    """In clustered vectors a query fetches few of them and finds its neighbours."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 32)) for c in centres])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids, norm = np.arange(len(x)), float(np.sqrt((x * x).sum(axis=1).max()))
    hashes = neighbours.Hashes(32, norm, 6, 1)
    region = neighbours.cells(hashes.vectors(x, 0))[:, 0]
    fetched = every = met = asks = 0
    for cell in np.unique(region):
        buckets = neighbours.Buckets(hashes, 0, ids[region == cell], x[region == cell])
        asked = np.flatnonzero(region == cell)[::50]
        asks += len(asked)
        for k, found, _ in buckets.search(ids[asked], x[asked], np.full(len(asked), 4.0), 6.0, 20):
            exact = np.argsort(-(x[region == cell] @ x[asked[k]]), kind="stable")
            met += len(set(found) & set(ids[region == cell][exact][:21].tolist()))
        fetched, every = fetched + buckets.fetched, every + len(asked) * len(buckets.ids)
    assert fetched < 0.3 * every and met > 0.8 * 20 * asks


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=n).astype(np.float32).tolist()) for n, low, high in ((3, 0, 50), (2, 100, 130), (7, 200, 204), (5, 220, 221)) for k in range(low, high)]
    got = {}
    for r in neighbours.search(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for size in (2, 3, 7):
        wanted = slow_search([(i, v) for i, v in rows if len(v) == size], 20, 20)
        assert {q: len(f) for q, f in got.items() if q in wanted} == {q: len(f) for q, f in wanted.items()}
        assert sum(len(set(got[q]) & {i for i, _ in f}) for q, f in wanted.items()) >= 0.9 * sum(map(len, wanted.values()))
    assert set(got) == {0, 20, 40, 100, 120, 200}


def test_odd_vectors(spark):
    good = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (40, [0.0, 1.0])]
    bad = [(None, [1.0, 1.0]), (60, None), (4, [0.0, 0.0]), (5, [1.0, None]), (80, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], VECTORS)
    got = sorted(map(tuple, neighbours.search(df).collect()))
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.5), (20, 4, 40, 0.0), (40, 1, 3, 0.5), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 20, 0.0)]
    assert neighbours.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert neighbours.search(spark.createDataFrame([(20, [1.0], 0)], VECTORS)).count() == 0
    assert neighbours.search(spark.createDataFrame([(21, [1.0], 0), (22, [2.0], 0)], VECTORS)).count() == 0


def test_large_norms_don_t_hide_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=16) * (50 if k % 97 == 0 else 1)).astype(np.float32).tolist()) for k in range(1200)]
    got = neighbours.search(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    wanted = slow_search(rows, 20, 20)
    assert sum(r["vec_id"] in {i for i, _ in wanted[r["query_id"]]} for r in got) / sum(map(len, wanted.values())) >= 0.9


# Pipeline and queries.


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    documents = spark.read.parquet(f"{small}/documents.parquet")
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == documents.columns
            # What is kept is unchanged.
            assert docs.exceptAll(documents).count() == 0 if k < 3 else docs.distinct().exceptAll(documents).count() == 0
    assert by_spark(corpus_pipeline.run(spark, small)) == by_spark(docs)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_stages_take_odd_rows(spark, small, make):
    import corpus_pipeline

    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() <= 3 * len(odd_rows())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = by_spark(queries.QUERIES[name](spark, small))
    if name in queries.ORACLE_SQL:
        assert got == by_duckdb(queries.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", ["op2_mixing", "op4_hilbert_shards", "op7_secrets"])
def test_native_plans(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_random_ids_do_not_matter_to_archives():
    rng = random.Random(0)
    names = {warc.ArcRecord("a", rng.randrange(10), {"url": "u"}, b"").identifier for _ in range(200)}
    assert len(names) == 10
