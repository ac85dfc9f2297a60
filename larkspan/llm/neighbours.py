"""Nearest vectors by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by Gaussian projections, cut into cells of one width; a bucket is a vector of
cells. Functions are as many as it takes for a bucket to hold several vectors at the table's size. A query visits its
own bucket first, then perturbed ones in the order of estimated success: by the squared distance from the query's
projections to the bucket's box, function by function. Only the vectors of visited buckets are fetched and ranked
by the exact measure; candidates of all tables are merged.

Inner products become distances by one more component: with M the largest norm, sqrt(M^2 - |x|^2) for
vectors, 0 for queries, which are scaled to norm M. A vector at distance d lies in a box at about d^2 times a chi-square
number, so a query stops at boxes farther than ``factor`` times the squared distance of its worst kept neighbour so far.
The factor is set from a bounded sample of queries, whose exact neighbours over all rows are found once: the least one
that reaches ``TARGET`` of those neighbours. So recall holds at any size and for any data, queries in dense surroundings
stop early, and the number of probes follows the data. A query for which less than the wanted number is found is
answered by an exact scan.

Buckets are dealt to tasks by region (table and cells of the first few functions, the more the more rows). A query
goes to its own region first; what it finds there bounds the other regions that it goes to. Regions with many
vectors are cut at random into parts, and queries into groups; each pair of part and group is a task's
work, so no task holds an unbounded bucket and none is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.shipping import ship
from larkspan.tables import Workspace, lookup

TABLES = 2
#: Width of a cell in units of the largest norm: a projection's standard deviation is one such unit.
WIDTH = 1.5
#: Bits that a function tells about a vector at that width, and vectors that a bucket would hold if they were even.
BITS, OCCUPANCY = 1.46, 64
#: Functions of a table, at least and at most, and of a region, at most.
LEAST_FUNCTIONS, MOST_FUNCTIONS, MOST_COARSE = 2, 20, 10
#: Queries whose exact neighbours set the factor.
SAMPLE = 96
#: Share of the sample's neighbours that must lie in visited buckets.
TARGET = 0.94
#: Rows of a part of a region, at least and at most, and of a group of queries.
LEAST_PART, MOST_PART, GROUP_ROWS = 1_024, 16_384, 4_096
#: Cells are numbered from -32 to 31, which is beyond any projection at this width.
_CELL_BITS, _CELL_MOST = 6, 31
#: Buckets that a query visits before it looks at its worst neighbour again; doubles from step to step.
_FIRST = 8


@dataclass
class Hashes:
    """The tables' projections for vectors of ``size`` components and largest norm ``norm``; the first ``coarse`` functions tell the region."""

    size: int
    norm: float
    functions: int
    coarse: int
    seed: int = 42

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.lines = rng.standard_normal((TABLES, self.size + 1, self.functions)) / self.norm
        self.shift = rng.uniform(0, WIDTH, (TABLES, self.functions))

    def vectors(self, x: np.ndarray, table: int) -> np.ndarray:
        """Projections of vectors."""
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return x @ self.lines[table, :-1] + rest[:, None] * self.lines[table, -1] + self.shift[table]

    def queries(self, q: np.ndarray, table: int) -> np.ndarray:
        """Projections of queries."""
        scaled = q * (self.norm / np.sqrt((q * q).sum(axis=1)))[:, None]
        return scaled @ self.lines[table, :-1] + self.shift[table]

    def away(self, q: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Squared distance, in squares of the norm, at which vectors with these products lie from their queries."""
        return np.maximum(1e-3, 2.0 - 2.0 * product / (np.sqrt((q * q).sum(axis=1)) * self.norm))


def cells(projections: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(projections / WIDTH), -_CELL_MOST - 1, _CELL_MOST).astype(np.int64)


def packed(boxes: np.ndarray) -> np.ndarray:
    """A number for each vector of up to ten cells."""
    out = np.zeros(len(boxes), np.int64)
    for k in range(boxes.shape[1]):
        out |= (boxes[:, k] + _CELL_MOST + 1) << (_CELL_BITS * k)
    return out


def box_score(projections: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distance from each row of projections to the same row's box."""
    gap = np.maximum(0.0, np.maximum(boxes * WIDTH - projections, projections - boxes * WIDTH - WIDTH))
    return (gap * gap).sum(axis=1)


def probes(projections: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, packed box, score) of each box whose score, on top of ``start``, is within the query's limit, in order of query and score.

    Boxes are perturbed one function after the other, and a perturbation that exceeds the limit is left with all that
    would come of it: work follows the boxes that are visited, not those that exist.
    """
    query, score, box = np.arange(len(projections)), start.astype(np.float64), np.zeros(len(projections), np.int64)
    open_ = score <= limit
    query, score, box = query[open_], score[open_], box[open_]
    for k in range(projections.shape[1]):
        own, room = projections[query, k], np.sqrt(np.maximum(0.0, limit[query] - score))
        low = np.maximum(np.floor((own - room) / WIDTH), -_CELL_MOST - 1).astype(np.int64)
        high = np.minimum(np.floor((own + room) / WIDTH), _CELL_MOST).astype(np.int64)
        many = np.maximum(0, high - low + 1)
        row = np.repeat(np.arange(len(query)), many)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
        gap = np.maximum(0.0, np.maximum(cell * WIDTH - own[row], own[row] - cell * WIDTH - WIDTH))
        total = score[row] + gap * gap
        near = total <= limit[query[row]]
        row, cell = row[near], cell[near]
        query, score, box = query[row], total[near], box[row] | ((cell + _CELL_MOST + 1) << (_CELL_BITS * k))
    order = np.lexsort((box, score, query))
    return query[order], box[order], score[order]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, in double precision; equal rows give equal numbers whatever stands around them."""
    return (x * q).sum(axis=1)


class Buckets:
    """The vectors of a part of a region, by bucket."""

    def __init__(self, hashes: Hashes, table: int, ids: np.ndarray, x: np.ndarray) -> None:
        self.hashes, self.table = hashes, table
        box = packed(cells(hashes.vectors(x, table))[:, hashes.coarse :])
        order = np.argsort(box, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.boxes, self.starts = np.unique(box[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))
        #: Vectors that searches have fetched.
        self.fetched = 0

    def search(self, names: np.ndarray, q: np.ndarray, worst: np.ndarray, factor: float, most: int) -> Iterator[tuple[int, list[int], list[float]]]:
        """(query, ids, scores) of the ``most`` nearest vectors in visited buckets. ``worst``: the squared distance of the worst neighbour that is known of each query."""
        hashes, coarse = self.hashes, self.hashes.coarse
        own = hashes.queries(q, self.table)
        region = cells(hashes.vectors(self.x[:1], self.table))[:, :coarse]
        start = box_score(own[:, :coarse], region)
        query, box, score = probes(own[:, coarse:], start, factor * worst)
        # Boxes without vectors drop out.
        place = np.minimum(np.searchsorted(self.boxes, box), len(self.boxes) - 1)
        real = self.boxes[place] == box
        query, place, score = query[real], place[real], score[real]
        cuts = np.searchsorted(query, np.arange(len(q) + 1))
        for k in range(len(q)):
            at, end, step = cuts[k], cuts[k + 1], _FIRST
            best_ids, best, reach = np.zeros(0, np.int64), np.zeros(0), factor * worst[k]
            while at < end and score[at] <= reach:
                to = min(end, at + step)
                visited = place[at:to][score[at:to] <= reach]
                many = self.ends[visited] - self.starts[visited]
                rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[visited], many)
                rows = rows[self.ids[rows] != names[k]]
                self.fetched += len(rows)
                ids, found = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, products(q[k], self.x[rows])])
                if len(found) > 4 * most:
                    # All that could be among the nearest, ties included.
                    last = np.partition(found, len(found) - most)[len(found) - most]
                    ids, found = ids[found >= last], found[found >= last]
                order = np.lexsort((ids, -found))[:most]
                best_ids, best = ids[order], found[order]
                if len(best) == most:
                    reach = min(reach, factor * float(hashes.away(q[k : k + 1], best[-1:])[0]))
                at, step = to, 2 * step
            # What lies farther than the worst known neighbour isn't among the nearest; ties stay.
            near = hashes.away(np.repeat(q[k : k + 1], len(best), axis=0), best) <= worst[k] * (1 + 1e-9) + 1e-9
            if near.any():
                yield k, best_ids[near].tolist(), best[near].tolist()


def nearest(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, most: int) -> tuple[list[int], list[float]]:
    """The ``most`` nearest rows of a query by exact product, ties to smaller ids. ``rough``: products to rounding, -inf for rows to leave out."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > most:
        last = np.partition(rough, len(rough) - most)[len(rough) - most]
        at = np.flatnonzero(rough >= last - 1e-9 * max(1.0, abs(last)) if np.isfinite(last) else np.isfinite(rough))
    else:
        at = np.flatnonzero(np.isfinite(rough))
    exact = products(q, x[at])
    order = np.lexsort((ids[at], -exact))[:most]
    return ids[at][order].tolist(), exact[order].tolist()


_FOUND = "query_id long, ids array<long>, scores array<double>"


def _scan(queries: tuple[np.ndarray, np.ndarray], most: int):
    """For a bounded block of queries, the nearest rows of each partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = queries
        held: tuple[np.ndarray, np.ndarray] | None = None
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            x, own = np.array(part["vector"].tolist(), np.float64), part["vec_id"].to_numpy(np.int64)
            held = (own, x)
            rough = vectors @ x.T
            for k in range(len(ids)):
                more_ids, more = nearest(vectors[k], int(ids[k]), held[1], held[0], rough[k], most)
                old_ids, old = best.get(k, ([], []))
                pairs = sorted(zip([-s for s in [*old, *more]], [*old_ids, *more_ids], strict=True))[:most]
                best[k] = ([i for _, i in pairs], [-s for s, _ in pairs])
        if best:
            yield pd.DataFrame({"query_id": [int(ids[k]) for k in best], "ids": [best[k][0] for k in best], "scores": [best[k][1] for k in best]})

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """``query_id, best``: the nearest over all rows of ``found``; ``best`` holds (negative score, id) in order.

    Each table gives a vector at most once, so the ``most`` nearest are among a query's first ``TABLES`` x ``most``
    rows. Those are picked before and after the shuffle; nothing longer is collected, however many tasks answer.
    """
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", (-F.col("p.scores")).alias("away"), F.col("p.ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("away", "vec_id")
    first = pairs.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= TABLES * most)
    return first.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("away", "vec_id")))), 1, most).alias("best"))


def clean(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (double) of the rows that take part.

    Null ids and vectors, null or non-finite components and zero vectors take no part. Rows with one id count
    once, with the smallest vector.
    """
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(good)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _factor(rows: DataFrame, queries: DataFrame, hashes: Hashes, most: int, sample: int, target: float) -> float:
    """The least factor with which ``target`` of a sample's exact neighbours are found in some table."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    block = (np.array([r["vec_id"] for r in picked], np.int64), np.array([r["vector"] for r in picked], np.float64))
    best = _merged(rows.mapInPandas(_scan(block, most), _FOUND), most)
    wanted = best.select("query_id", F.col("best")[F.size("best") - 1]["away"].alias("last"), F.explode("best.vec_id").alias("vec_id"))
    # Sample x most rows at most.
    pairs = rows.join(F.broadcast(wanted), "vec_id").select("query_id", "vector", "last").collect()
    place = {int(i): k for k, i in enumerate(block[0])}
    at = np.array([place[r["query_id"]] for r in pairs], np.int64)
    x = np.array([r["vector"] for r in pairs], np.float64).reshape(-1, hashes.size)
    if not len(x):
        return 0.0
    worst = hashes.away(block[1][at], np.array([-r["last"] for r in pairs]))
    score = np.min([box_score(hashes.queries(block[1], t)[at], cells(hashes.vectors(x, t))) for t in range(TABLES)], axis=0)
    return float(np.quantile(score / worst, target, method="higher")) * (1 + 1e-9) + 1e-9


def plan(rows: int, partitions: int) -> tuple[int, int, int]:
    """(functions, functions of a region, rows of a part) for a table's size."""
    functions = min(MOST_FUNCTIONS, max(LEAST_FUNCTIONS, round(math.log2(max(1.0, rows / OCCUPANCY)) / BITS)))
    part = min(MOST_PART, max(LEAST_PART, rows * TABLES // (4 * max(1, partitions))))
    coarse = math.ceil(math.log2(max(1.0, rows / part)) / BITS / 1.25)
    return functions, min(MOST_COARSE, functions - 1, max(1, coarse)), part


_SHAPE = "query_id long, rank int, vec_id long, score double"
_REGION = "table int, region long"


def search(vectors: DataFrame, every: int = 20, most: int = 20, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``most`` nearest rows by inner product that were found for each query.

    ``vectors``: ``vec_id, embedding``. Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own that have as many components, as no other has a product with it. ``score`` is the
    exact inner product in double precision; ties go to the smaller id. ``clean`` says which rows take part and
    that repeated ids count once. If there are no more candidates than ``most``, all are returned. Vectors of each
    length are searched one length after the other. Other columns don't matter. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    ws = Workspace(spark, "neighbours")
    rows = ws.table(clean(vectors), "vectors")
    asked = F.count(F.when(F.col("vec_id") % every == 0, 1))
    norm = F.max(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"), asked.alias("asked"), norm.alias("norm")).where("asked > 0 and rows > 1").orderBy("size").collect()
    found = [_search(ws, rows.where(F.size("vector") == r["size"]), r["size"], r["rows"], math.sqrt(r["norm"]), every, most, sample, target) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SHAPE)


def _arrays(part: pd.DataFrame, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    return part[ids].to_numpy(np.int64), np.array(part[vectors].tolist(), np.float64)


def _search(ws: Workspace, rows: DataFrame, size: int, total: int, norm: float, every: int, most: int, sample: int, target: float) -> DataFrame:
    """``search`` among vectors of one length."""
    spark = ws.spark
    functions, coarse, part_rows = plan(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashes = Hashes(size, norm, functions, coarse)
    queries = rows.where(F.col("vec_id") % every == 0)
    factor = _factor(rows, queries, hashes, most, sample, target)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _arrays(part, "vec_id", "vector")[1]
            for table in range(TABLES):
                region = packed(cells(hashes.vectors(x, table))[:, :coarse])
                yield pd.DataFrame({"table": table, "region": region, "vec_id": part["vec_id"], "vector": part["vector"]})

    dealt = ws.table(rows.mapInPandas(deal, f"{_REGION}, vec_id long, vector array<double>"), f"dealt-{size}")
    counts = ws.table(dealt.groupBy("table", "region").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")), f"regions-{size}")

    def route(home: bool):
        """Queries with their regions: the one that they lie in, or the others within their reach."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), 256):
                    own = part.iloc[at : at + 256]
                    q, worst = _arrays(own, "vec_id", "vector")[1], own["worst"].to_numpy(np.float64)
                    for table in range(TABLES):
                        p = hashes.queries(q, table)[:, :coarse]
                        mine = packed(cells(p))
                        if home:
                            k, region = np.arange(len(q)), mine
                        else:
                            k, region, _ = probes(p, np.zeros(len(q)), factor * worst)
                            k, region = k[region != mine[k]], region[region != mine[k]]
                        yield pd.DataFrame({"table": table, "region": region, "query_id": own["vec_id"].to_numpy()[k], "query": own["vector"].to_numpy()[k], "worst": worst[k]})

        return run

    def probe(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "ids": [], "scores": []}
        if len(own) and len(asked):
            buckets = Buckets(hashes, int(own["table"].iloc[0]), *_arrays(own, "vec_id", "vector"))
            names, q = _arrays(asked, "query_id", "query")
            worst = asked["worst"].to_numpy(np.float64)
            for at in range(0, len(q), 64):
                for k, ids, scores in buckets.search(names[at : at + 64], q[at : at + 64], worst[at : at + 64], factor, most):
                    out["query_id"].append(int(names[at + k]))
                    out["ids"].append(ids)
                    out["scores"].append(scores)
        return pd.DataFrame(out, dtype=object).astype({"query_id": "int64"})

    def visit(asked: DataFrame, home: bool, name: str) -> DataFrame:
        """The nearest in the regions that queries are routed to."""
        on = ["table", "region"]
        # Regions without vectors drop out here.
        routed = asked.mapInPandas(route(home), f"{_REGION}, query_id long, query array<double>, worst double").join(lookup(counts), on)
        routed = ws.table(routed, f"routed-{name}")
        groups = ws.table(routed.groupBy(*on).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"), F.first("parts").alias("parts")), f"groups-{name}")
        part, group = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")
        left = dealt.join(lookup(groups), on).select(*on, "vec_id", "vector", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
        right = routed.join(lookup(groups.drop("parts")), on).select(*on, "query_id", "query", "worst", group.alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        keys = [*on, "part", "group"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: probe(a, b), _FOUND)
        return ws.table(_merged(found, most), f"found-{name}")

    # No distance in units of the norm exceeds 2.
    first = visit(queries.withColumn("worst", F.lit(4.0)), True, f"home-{size}")
    last = F.when(F.size("best") >= most, -F.col("best")[most - 1]["away"])
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))
    worst = F.coalesce(F.greatest(F.lit(1e-3), 2.0 - 2.0 * F.col("last") / (length * norm)), F.lit(4.0))
    known = queries.join(first.select(F.col("query_id").alias("vec_id"), last.alias("last")), "vec_id", "left").select("vec_id", "vector", worst.alias("worst"))
    second = visit(known, False, f"others-{size}")
    both = first.unionByName(second).groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, most).alias("best"))
    best = ws.table(both, f"found-{size}")
    enough = min(most, total - 1)
    full = best.where(F.size("best") >= enough)
    short = queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    rest, paths = short.toLocalIterator(), []
    while block := list(itertools.islice(rest, 1024)):
        scanned = (np.array([r["vec_id"] for r in block], np.int64), np.array([r["vector"] for r in block], np.float64))
        paths.append(f"{ws.path}/scanned-{size}/{len(paths)}")
        _merged(rows.mapInPandas(_scan(scanned, most), _FOUND), most).write.parquet(paths[-1])
    if paths:
        full = full.unionByName(spark.read.schema(best.schema).parquet(*paths))
    return full.select("query_id", F.posexplode("best").alias("__k", "__p")).select("query_id", (F.col("__k") + 1).cast("int").alias("rank"), F.col("__p.vec_id").alias("vec_id"), (-F.col("__p.away")).alias("score"))
