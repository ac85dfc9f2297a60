"""Sharding by a Hilbert curve.

Metadata dimensions are quantised to a few bits each, rows are sorted by their cell's index on a
Hilbert curve, and the sorted rows are cut into runs. Neighbouring cells follow one another, so each
run covers a small range in every dimension and the files' column statistics prune by any of them.

Only built-in column functions run here. Ranks come from distributed prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.prefix import prefix_sums
from larkspan.tables import Workspace, lookup

DIMENSIONS = 3
BITS = 5
#: Fixed values of the curve in three dimensions, by the position 0 to 7 of a subcube on its parent's path.
#: Corner at which the path enters the subcube, and the axis along which the subcube's own path runs.
ENTRY = (0, 0, 0, 3, 3, 6, 6, 5)
AXIS = (0, 1, 1, 2, 2, 1, 1, 0)


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index on the curve of the cell (x, y, z), each from 0 to 2^bits - 1.

    One fold over the bits from the highest: the three bits at a level name a subcube; turned into the
    frame of the parent (entry corner ``e``, axis ``d``) and Gray-decoded they give its position.
    """

    def left(v: Column, by: Column) -> Column:
        return F.when(by % 3 == 0, v).when(by % 3 == 1, v.bitwiseAND(F.lit(3)) * 2 + F.floor(v / 4)).otherwise(v.bitwiseAND(F.lit(1)) * 4 + F.floor(v / 2)).cast("int")

    def bit(v: Column, level: Column) -> Column:
        return F.call_function("shiftright", v.cast("int"), level).bitwiseAND(F.lit(1))

    def step(state: Column, level: Column) -> Column:
        corner = bit(x, level) + bit(y, level) * 2 + bit(z, level) * 4
        turned = left(corner.bitwiseXOR(state["e"]), F.lit(6) - (state["d"] + 1))
        place = turned.bitwiseXOR(F.call_function("shiftright", turned, F.lit(1))).bitwiseXOR(F.call_function("shiftright", turned, F.lit(2)))
        at = (place + 1).cast("int")
        entry = F.element_at(F.array(*map(F.lit, ENTRY)), at)
        axis = F.element_at(F.array(*map(F.lit, AXIS)), at)
        return F.struct(
            (state["h"] * 8 + place).cast("int").alias("h"),
            state["e"].bitwiseXOR(left(entry, state["d"] + 1)).cast("int").alias("e"),
            ((state["d"] + axis + 1) % 3).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda s: s["h"])


def depth_cells(ws: Workspace, rows: DataFrame, column: str, bits: int) -> DataFrame:
    """``(__value, __cell)`` for each value of a column: cells of about equal numbers of rows, in the order of values, null last."""
    counts = ws.table(rows.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__rows")), f"counts_{column}")
    total = counts.agg(F.sum("__rows")).first()[0] or 1
    placed = prefix_sums(ws, counts, f"order_{column}", [F.col("__value").asc_nulls_last()], {"__before": "__rows"})
    return placed.select("__value", F.floor(F.col("__before") * (1 << bits) / F.lit(total)).cast("int").alias("__cell"))


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, hilbert, shard, slot`` for each row of ``docs(doc_id, text, lang, source)``.

    Dimensions: source and language in cells of equal depth, and the text's bytes in cells of half a
    power of two. Runs are cut by rows: shard sizes differ by one row at most. ``slot`` counts from 0
    within the shard along the curve. Rows of a cell follow in the order of source, language, bytes, id
    and checksum, so equal texts of one source lie together.

    Null text counts as empty (size 1, checksum 0); null source and language come last in their order;
    null ids come last in theirs. Rows that agree in all of these are interchangeable. Other columns
    don't matter. With fewer rows than shards, some shards are empty; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = ws.table(docs.select("doc_id", F.col("source").alias("__source"), F.col("lang").alias("__lang"), (F.octet_length(payload) + 1).cast("long").alias("size"), F.crc32(payload).cast("long").alias("text_crc32")), "rows")
    total = rows.count()
    out = rows
    for column in ("__source", "__lang"):
        cells = depth_cells(ws, rows, column, bits)
        out = out.join(lookup(cells), F.col(column).eqNullSafe(F.col("__value"))).drop("__value").withColumnRenamed("__cell", f"{column}_cell")
    length = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size")) * 2)).cast("int")
    out = ws.table(out.withColumn("hilbert", hilbert_index(F.col("__source_cell"), F.col("__lang_cell"), length, bits)).drop("__source_cell", "__lang_cell").withColumn("__one", F.lit(1).cast("long")), "curve")
    order = [F.col("hilbert").asc(), *[F.col(c).asc_nulls_last() for c in ("__source", "__lang", "size", "doc_id", "text_crc32")]]
    ranked = prefix_sums(ws, out, "ranked", order, {"__rank": "__one"})
    # Integer arithmetic: rank x shards stays below 2^63, and both quotients are exact.
    number = F.expr(f"__rank * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(__shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("__shard", number).select("doc_id", "size", "text_crc32", "hilbert", F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - first).cast("long").alias("slot"))
