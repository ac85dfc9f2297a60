"""Gray-order hierarchical index over 64-bit fingerprints, for all pairs within a small Hamming distance.

Fingerprints are sorted by the rank of their bits in the reflected Gray code, in which neighbours
differ in few bits. Runs of neighbours form leaves, runs of leaves form nodes. The bits that all
members of a node share are factored into the node as a mask and a pattern, without those that its
parent holds already. A search goes from the top and adds up the differences to each node's pattern;
a group whose sum exceeds the radius is left without looking at its members.

Differences in the leading bits prune most, as these are what neighbours in the order share. Therefore the order is
taken several times with the bits rearranged: cut into blocks, two fingerprints that differ in at most r bits agree
on all but r blocks, so in one arrangement they agree on the whole leading part. There a search may demand it: a
difference in the leading part alone exceeds the radius.

Each arrangement is range-partitioned by Gray rank into runs of a bounded number of rows, which are the index's
upper nodes; a task indexes a run and searches it. Fingerprints with one leading part lie side by side, so a run
has to be searched from another run only if that part goes on there; such pairs of runs are matched by their masks and
patterns first.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.prefix import MOST_SLICES
from larkspan.tables import Workspace

FAN = 16
#: Rows of an upper node.
RUN_ROWS = 8_192
#: Fingerprints that share a leading part, on average, at most: more of them are cut into more blocks.
SHARED = 1_024
MOST_BLOCKS = 8
#: Rows of a range of the order.
SLICE_ROWS = 50_000
_ALL = 0xFFFFFFFFFFFFFFFF


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    out = prints.astype(np.uint64).copy()
    for by in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(by)
    return out


class GrayIndex:
    """Levels of (mask, pattern) over Gray-sorted fingerprints, top level first. ``order`` sorts the input."""

    def __init__(self, prints: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(prints), kind="stable")
        self.prints = prints[self.order]
        levels, ones, zeros = [], self.prints, ~self.prints
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            levels.append((ones | zeros, ones))
        self.levels = []
        for k in range(len(levels) - 1, -1, -1):
            mask, pattern = levels[k]
            above = levels[k + 1][0][np.arange(len(mask)) // FAN] if k + 1 < len(levels) else np.zeros(len(mask), np.uint64)
            self.levels.append((mask & ~above, pattern & ~above))
        above = levels[0][0][np.arange(len(self.prints)) // FAN] if levels else np.zeros(len(self.prints), np.uint64)
        self.levels.append((~above, self.prints & ~above))
        #: Nodes and members whose bits searches have compared.
        self.compared = 0

    def search(self, queries: np.ndarray, radius: int, leading: int = 0, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of query, index of input) within the radius and without a difference in the ``leading`` bits, for a block of queries at a time."""
        equal = np.uint64((_ALL << (64 - leading)) & _ALL)
        for at in range(0, len(queries), block):
            own = queries[at : at + block]
            size = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(own)), size), np.tile(np.arange(size), len(own))
            sums = np.zeros(len(q), np.uint8)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = child < len(mask)
                    q, sums, node = np.repeat(q, FAN)[inside], np.repeat(sums, FAN)[inside], child[inside]
                self.compared += len(q)
                apart = (own[q] ^ pattern[node]) & mask[node]
                sums = sums + np.bitwise_count(apart)
                near = (sums <= radius) & ((apart & equal) == 0)
                q, node, sums = q[near], node[near], sums[near]
            yield q + at, self.order[node]


def stars(prints: np.ndarray, radius: int, leading: int = 0, among: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint the smallest index that it reaches by links, found through the index. With ``among``, only links between those marked and those not."""
    root = np.arange(len(prints))
    indexed = root if among is None else np.flatnonzero(among)
    asking = root if among is None else np.flatnonzero(~among)
    # At most 2 ** 22 pairs at a time, however many copies there are.
    found = GrayIndex(prints[indexed]).search(prints[asking], radius, leading, max(64, min(2048, (1 << 22) // max(1, len(indexed)))))
    for a, b in found:
        a, b = asking[a], indexed[b]
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    return root


def _edges(part: pd.DataFrame, radius: int, leading: int) -> pd.DataFrame:
    """Edges within a run, or between two."""
    across = part["first"].iloc[0] != part["second"].iloc[0]
    among = (part["run"] == part["first"]).to_numpy() if across else None
    root = stars(part["print"].to_numpy(np.int64).view(np.uint64), radius, leading, among)
    nodes, linked = part["node"].to_numpy(np.int64), root != np.arange(len(root))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})


def arrangements(rows: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """(blocks, the blocks that lead in each arrangement) for a number of fingerprints: the fewest blocks for which leading parts are shared by few."""
    for blocks in range(radius + 1, max(radius + 1, MOST_BLOCKS) + 1):
        if rows <= SHARED << (64 * (blocks - radius) // blocks):
            break
    return blocks, list(itertools.combinations(range(blocks), blocks - radius))


def _arranged(blocks: int, leading: tuple[int, ...]) -> tuple[Column, int]:
    """The fingerprint with the bits of some blocks in front, and how many bits those are."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    order = [*leading, *[k for k in range(blocks) if k not in leading]]
    out, at = F.lit(0).cast("long"), 64
    for k in order:
        low, width = bounds[k], bounds[k + 1] - bounds[k]
        at -= width
        out = out.bitwiseOR(F.expr(f"shiftleft(shiftrightunsigned(shiftleft(print, {64 - low - width}), {64 - width}), {at})"))
    return out, sum(bounds[k + 1] - bounds[k] for k in leading)


def links(prints: DataFrame, radius: int, run_rows: int | None = None) -> DataFrame:
    """Edges ``a, b`` that join the same components as all pairs within the radius would.

    ``prints``, a written table or rows worked out of one alike each time: ``node long, print long``, neither null; a node may have
    several rows. With a column ``part int``, from 0, only rows of the same part link, and all parts are searched at once. At most
    one edge a row comes out of a run or a pair of runs, so a group of many near copies doesn't make all its pairs. No
    rows give no edges.
    """
    ws = Workspace(prints.sparkSession, "links")
    run_rows = run_rows or RUN_ROWS
    prints = prints if "part" in prints.columns else prints.withColumn("part", F.lit(0))
    most, total = prints.groupBy("part").count().agg(F.max("count"), F.sum("count")).first()
    blocks, leads = arrangements(most or 0, radius)
    arranged = [_arranged(blocks, lead) for lead in leads]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(64 - width).alias("rest"), bits.alias("print")) for k, (bits, width) in enumerate(arranged)])
    rows = prints.select("node", "part", F.explode(each).alias("__p")).select("node", (F.col("part") * len(leads) + F.col("__p.kind")).alias("kind"), "__p.rest", "__p.print")
    rank = F.col("print")
    for by in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, by))
    order = [F.col("kind").asc(), rank.asc(), F.col("node").asc()]
    slices = max(1, min(MOST_SLICES, -(-(total or 0) * len(leads) // SLICE_ROWS)))
    # A row's number starts anew, far above, in each range of the order, so no run lies in two; numbers are written with the rows.
    placed = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("run", F.monotonically_increasing_id())
    placed = placed.select("node", "kind", "rest", "print", F.expr("shiftrightunsigned(print, rest)").alias("lead"), F.expr(f"run div {run_rows}L").alias("run"))
    runs = ws.table(placed, "runs")
    # Leading parts that go on in another run; there, a node per run: bits that are one, and bits that are zero, in all its rows.
    across = ws.table(runs.groupBy("kind", "lead").agg(F.min("run").alias("low"), F.max("run").alias("high")).where("low < high").select("kind", "lead"), "across")
    shared = ws.table(runs.join(across, ["kind", "lead"], "left_semi"), "shared")
    nodes = shared.groupBy("kind", "lead", "run").agg(F.expr("bit_and(print)").alias("ones"), F.expr("bit_and(~print)").alias("zeros"))
    left, right = nodes.alias("l"), nodes.alias("r")
    same = (F.col("l.kind") == F.col("r.kind")) & (F.col("l.lead") == F.col("r.lead")) & (F.col("l.run") < F.col("r.run"))
    apart = F.expr("bit_count((l.ones & r.zeros) | (l.zeros & r.ones))")
    pairs = left.join(right, same & (apart <= radius)).select("l.kind", "l.lead", F.col("l.run").alias("first"), F.col("r.run").alias("second"))
    sides = ws.table(pairs.select("kind", "lead", "first", "second", F.explode(F.array("first", "second")).alias("run")), "sides")
    columns = ["kind", "first", "second", "lead", "run", "node", "print", "rest"]
    between = shared.join(sides, ["kind", "lead", "run"]).select(columns)
    within = runs.withColumns({"first": F.col("run"), "second": F.col("run"), "lead": F.lit(None).cast("long")}).select(columns)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        return _edges(part, radius, 64 - int(part["rest"].iloc[0]))

    out = within.unionByName(between).groupBy("kind", "first", "second", "lead").applyInPandas(search, "a long, b long")
    return ws.table(out.distinct(), "edges")
