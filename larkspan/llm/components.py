"""Connected components of a graph given as edges, for graphs that fit on no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.tables import Workspace


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges(a long, b long)``; the root is the smallest node of its component.

    Alternating large-star and small-star steps: a node ties its larger neighbours, then itself and its
    smaller ones, to its smallest neighbour, until every edge ends at a root. The number of edges never
    grows, rounds are logarithmic in practice, and each one is written to the shared folder. Minima are
    aggregated before the shuffle, so a node with very many neighbours is one row per task there.
    Loops and repeated edges are allowed, null ends aren't. No edges give no rows.
    """
    ws = Workspace(edges.sparkSession, "components")
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, seen = ws.table(pairs, "0"), None
    for k in range(1, rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined: a join of two tables may split a node with very many neighbours.
        least = ws.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{k}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = ws.table(large, f"{k}-edges")
        least = ws.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{k}-small")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where("a <> b").distinct()
        pairs = ws.table(small, str(k))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (str(k - 1), f"{k}-large", f"{k}-edges", f"{k}-small"):
            ws.drop(old)
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
