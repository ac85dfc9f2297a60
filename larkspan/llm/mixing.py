"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by source and key. Distributed prefix sums of
their word counts give each document its place in its source; each source is cut at its exact
budget, after as many whole passes as the budget holds.

Only built-in column functions run here, and no step sees all rows in one task: prefix sums go
through ``prefix_sums``, also over the table of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import row_key, word_count
from larkspan.operators.prefix import prefix_sums
from larkspan.tables import Workspace, lookup

WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words.
MOST_PASSES = 3


def random_key(doc_id: Column, seed: int) -> Column:
    """A 60-bit number that depends on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(ws: Workspace, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, share: float = 1.0) -> DataFrame:
    """One row per source: ``source, source_size, target, source_at`` from rows of ``source, size``.

    Sources in code point order, null last, take the weights in turn. Together they share ``share``
    times all words by weight; a target stops at ``most`` times its source's words and the excess is
    shared again by weight among the rest. That ends at the water level ``w``: target = min(weight x w,
    cap). With sources by rising cap/weight, w is the largest (total - caps before) / (weights from
    here on). ``source_at`` is the number of words in earlier sources.
    """
    by_source = ws.table(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("__one", F.lit(1).cast("long")), "sources")
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = prefix_sums(ws, by_source, "sources_by_name", [F.col("source").asc_nulls_last()], {"__rank": "__one", "source_at": "source_size"})
    ranked = ranked.withColumn("__weight", turn).withColumn("__cap", F.col("source_size") * F.lit(most).cast("long"))
    ranked = ranked.withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    levels = prefix_sums(ws, ws.table(ranked, "sources_with_caps"), "sources_by_cap", [F.col("__ratio").asc(), F.col("__rank").asc()], {"__caps": "__cap", "__weights": "__weight"})
    levels = ws.table(levels, "sources_levels")
    total, weight = levels.agg(F.sum("source_size"), F.sum("__weight")).first()
    total, weight = (total or 0) * share, weight or 0
    level = levels.agg(F.max((F.lit(float(total)) - F.col("__caps")) / (F.lit(weight) - F.col("__weights")))).first()[0] or 0.0
    return levels.select("source", "source_size", "source_at", F.least(F.col("__cap").cast("double"), F.col("__weight") * F.lit(float(level))).alias("target"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, share: float = 1.0, cut: str = "words") -> DataFrame:
    """Plan the mix of ``docs(doc_id, text, source)``: ``doc_id, size, source_size, target, taken, passes, __k1, __k2``.

    ``cut='words'`` ends a source within a document, at the whole part of its target; ``taken`` is then
    exact. ``cut='document'`` takes a document's last pass whole if at least half of it fits, else not.
    ``passes`` counts whole passes over the document. ``__k1, __k2`` identify the row of ``docs``.

    Null text or text without words has size 0 and takes nothing; with ``cut='document'`` it passes as
    often as its neighbours in the order. Null source is a source of its own, last in order. Null ids
    share one key. Rows with the same id and source follow one another in the order of their row hash;
    exact repeats are interchangeable, so the multiset of results is the same in each run. Other columns
    don't matter but for that hash. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    k1, k2 = row_key(docs)
    sizes = ws.table(docs.select("doc_id", "source", word_count("text").alias("size"), random_key(F.col("doc_id"), seed).alias("__key"), k1.alias("__k1"), k2.alias("__k2")), "sizes")
    order = [F.col("source").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("__key", "doc_id", "__k1", "__k2")]]
    placed = prefix_sums(ws, sizes, "placed", order, {"__at": "size"})
    targets = source_targets(ws, sizes, weights, most, share).withColumnRenamed("source", "__source")
    joined = placed.join(lookup(targets), F.col("source").eqNullSafe(F.col("__source")))
    start = F.col("__at") - F.col("source_at")
    out = joined.withColumn("__whole", F.floor("target").cast("long")).withColumn("__full", F.expr("if(source_size > 0, __whole div source_size, 0L)"))
    out = out.withColumn("__rest", F.col("__whole") - F.col("__full") * F.col("source_size"))
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__rest") - start))
    more = (F.col("__rest") > start) & (2 * inside >= F.col("size"))
    passes = F.col("__full") + F.when(more, 1).otherwise(0)
    taken = F.col("__full") * F.col("size") + inside if cut == "words" else passes * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), passes.cast("long").alias("passes"), "__k1", "__k2")


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, cut between documents; rows that it doesn't take go.

    Exact repeats of a row are pooled: their passes are added and given out as copies of one of them.
    """
    columns = docs.columns
    k1, k2 = row_key(docs)
    plan = mix(docs, seed, cut="document").groupBy(F.col("__k1").alias("__p1"), F.col("__k2").alias("__p2")).agg(F.sum("passes").cast("int").alias("__passes"))
    keyed = docs.withColumns({"__d1": k1, "__d2": k2}).dropDuplicates(["__d1", "__d2"])
    taken = keyed.join(plan.where("__passes > 0"), (F.col("__d1") == F.col("__p1")) & (F.col("__d2") == F.col("__p2")))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__passes")))).select(*[F.col(f"`{c}`") for c in columns])
