"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of tokens: some places count, the others are ignored, so a hash of the
counting places survives substitutions at the rest. Masked hashes of benchmark items are joined with
those of documents; around each hit the two texts are compared token by token without shifts, and
any run that reaches the limits counts.

The masks lose no overlap at the default limits. A run of 26 tokens or more that agrees enough has a half of 13
or more that does, so runs of 13 to 25 tokens decide; for each of these lengths and each placement of as many differences
as the limits allow, some mask at some shift meets agreeing tokens only. Items below 13 tokens have masks of
their own, with which the same holds for whole items of 4 tokens or more; tests go through all placements.

The benchmark is taken in blocks of a bounded number of tokens. A block's hashes are sent to all workers,
documents stream past them, and no document moves between tasks. A larger benchmark is more blocks, one
after the other: what one finds is written before the next is sent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.shared import row_key
from larkspan.tables import Workspace, lookup

#: Masks of weight 6 for items of SPAN tokens or more; ones count.
MASKS = ("111111", "11101011", "11101101", "1100100111", "1011000111", "111000101001", "11110000000101")
#: Masks of weight 3 for shorter items.
SHORT_MASKS = ("111", "1011", "1101")
#: Tokens that an overlap must span (all tokens of a shorter item), and the share of them that must agree.
SPAN, IDENTITY = 13, 0.75
#: Tokens of the benchmark that are sent to workers at a time.
BLOCK_TOKENS = 500_000
#: Texts of about so many characters are matched at a time.
BATCH = 1 << 21
#: Hits that are held at a time, about. Items that share a template give many; they are compared in turns.
HITS = 1 << 19
_TOKEN = re.compile(r"\w+")
_WIDEST = max(map(len, MASKS + SHORT_MASKS))
_LEAST = min(map(len, SHORT_MASKS))
_FACTOR = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(_WIDEST)]


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _TOKEN.findall((text or "").lower())


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash of each run of tokens."""
    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out += hashes[k : k + n] * np.uint64(_FACTOR[k])
    return out ^ (out >> np.uint64(32))


@dataclass
class Seeds:
    """A block of the benchmark: its items' tokens, numbered from 1, and its masked hashes."""

    items: list[object]
    numbers: dict[str, int]
    hashes: np.ndarray
    sequences: list[np.ndarray]
    #: (mask, sorted hashes, their items, their places, which high bits of a hash occur) by mask.
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    short: dict[tuple[int, ...], list[int]]


def seeds(rows: list[tuple[object, list[str]]], span: int = SPAN) -> Seeds:
    """Build from (item id, tokens). Items shorter than the shortest mask are matched whole."""
    numbers: dict[str, int] = {}
    sequences = [np.array([numbers.setdefault(t, len(numbers) + 1) for t in own], np.int32) for _, own in rows]
    hashes = np.array([0, *[xxhash.xxh64_intdigest(t.encode()) | 1 for t in numbers]], np.uint64)
    tables = []
    for masks, long in ((MASKS, True), (SHORT_MASKS, False)):
        own = [k for k, s in enumerate(sequences) if (len(s) >= span) == long and len(s) >= _LEAST]
        for mask in masks if own else ():
            found = [masked(hashes[sequences[k]], mask) for k in own]
            keys = np.concatenate(found)
            item = np.concatenate([np.full(len(h), k, np.int32) for h, k in zip(found, own, strict=True)])
            at = np.concatenate([np.arange(len(h), dtype=np.int32) for h in found])
            order = np.argsort(keys, kind="stable")
            # About one place in sixteen is taken, within 64 KB and 4 MB.
            bits = min(22, max(16, len(keys).bit_length() + 4))
            sieve = np.zeros(1 << bits, bool)
            sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            tables.append((mask, keys[order], item[order], at[order], sieve))
    short: dict[tuple[int, ...], list[int]] = {}
    for k, s in enumerate(sequences):
        if 0 < len(s) < _LEAST:
            short.setdefault(tuple(s.tolist()), []).append(k)
    return Seeds([i for i, _ in rows], numbers, hashes, sequences, tables, short)


def best_overlap(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in a, span, agreeing) of the best run of a against b[shift:], where an agreement gains 1 and a difference loses 2."""
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    same = a[low:high] == b[low + shift : high + shift]
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    gain = sums - np.minimum.accumulate(sums)
    end = int(np.argmax(gain))
    start = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1])
    return low + start, end - start, int(same[start:end].sum())


def qualifying_overlap(a: np.ndarray, b: np.ndarray, shift: int, least: int, identity: float) -> tuple[int, int, int] | None:
    """(start in a, span, agreeing) of a run of a against b[shift:] that spans ``least`` and agrees in ``identity`` of it: that of ``best_overlap`` if it does, otherwise the longest, the first of several; None if no run does."""
    start, length, agree = best_overlap(a, b, shift)
    if length >= least and agree >= identity * length:
        return start, length, agree
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    if high - low < max(1, least):
        return None
    same = a[low:high] == b[low + shift : high + shift]
    # A run agrees enough if this sum doesn't fall over it. The margin is for sums of fractions.
    sums = np.concatenate([[0.0], np.cumsum(same - identity)])
    lowest = np.minimum.accumulate(sums)
    begin = np.searchsorted(-lowest, -(sums + 1e-9), "left")
    spans = np.arange(len(sums)) - begin
    end = int(np.argmax(spans))
    if spans[end] < max(1, least):
        return None
    first = int(begin[end])
    return low + first, end - first, int(same[first:end].sum())


def _turns(entries: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of places with ``most`` entries or fewer together, or of one place, whose entries the block bounds."""
    ends, at = np.cumsum(entries), 0
    while at < len(entries):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def overlaps(block: Seeds, texts: list[str | None], span: int = SPAN, identity: float = IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start in the text, span, agreeing) of the best overlap of each text and item that reaches the limits."""
    get = block.numbers.get
    own = [np.array([get(t, 0) for t in tokens(x)], np.int64) for x in texts]
    # A break between texts that no run of a mask crosses unnoticed: number 0 is in no item.
    gap = np.zeros(_WIDEST, np.int64)
    joined = np.concatenate([x for o in own for x in (o, gap)] or [gap])
    starts = np.cumsum([0] + [len(o) + len(gap) for o in own])
    hashes = block.hashes[joined]
    known = np.concatenate([[0], np.cumsum(joined > 0)])
    hits: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def compare() -> None:
        for text, k, shift in hits:
            sequence = block.sequences[k]
            found = qualifying_overlap(sequence, own[text], shift, min(span, len(sequence)), identity)
            if found:
                start, length, agree = found
                best[text, k] = max(best.get((text, k), (0, 0, 0)), (agree, length, -(start + shift)))
        hits.clear()

    for mask, keys, item, at, sieve in block.tables:
        found = masked(hashes, mask)
        places = np.flatnonzero(sieve[(found >> np.uint64(65 - len(sieve).bit_length())).astype(np.int64)])
        places = places[known[places + len(mask)] - known[places] >= mask.count("1")]
        left, right = np.searchsorted(keys, found[places], "left"), np.searchsorted(keys, found[places], "right")
        for a, b in _turns(right - left, HITS):
            many = right[a:b] - left[a:b]
            place = np.repeat(places[a:b], many)
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left[a:b], many)
            text = np.searchsorted(starts, place, "right") - 1
            shift = place - starts[text] - at[entry]
            # One comparison for each text, item and shift, however many seeds hit.
            hits |= set(zip(text.tolist(), item[entry].tolist(), shift.tolist(), strict=True))
            if len(hits) > HITS:
                compare()
    compare()
    for sequence, items in block.short.items():
        size = len(sequence)
        for text, o in enumerate(own):
            runs = [i for i in np.flatnonzero(o[: len(o) - size + 1] == sequence[0]).tolist() if tuple(o[i : i + size].tolist()) == sequence] if len(o) >= size else []
            for k in items if runs else []:
                best[text, k] = (size, size, -runs[0])
    return [(t, k, -s, n, a) for (t, k), (a, n, s) in sorted(best.items())]


def _blocks(benchmark: DataFrame, span: int, block_tokens: int) -> Iterator[Seeds]:
    """The benchmark's distinct items in blocks. Rows stream to the driver; one block is held at a time."""
    rows, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        own = tokens(r["text"])
        if rows and size + len(own) > block_tokens:
            yield seeds(rows, span)
            rows, size = [], 0
        if own:
            rows.append((r["item_id"], own))
            size += len(own)
    if rows:
        yield seeds(rows, span)


def _in_batches(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


_FOUND = "doc_id long, item_id long, start int, span int, agreeing int"


def contaminations(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, identity: float = IDENTITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, item_id, start, span, agreeing`` for each row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` that overlap.

    An overlap counts if it spans ``span`` tokens or the whole item, if that is shorter, and ``identity`` of its
    tokens agree. ``start`` is the overlap's first token in the document. Tokens are lower-case runs of word
    characters. At the default limits no overlap is missed; at laxer ones some may be.

    Null and empty texts overlap with nothing, on either side. Repeated items with one id count once; items
    of equal text but different ids each count. Repeated documents and null ids each keep their rows.
    Texts are whole, however long; of equally good overlaps the first in the text is named. Other columns
    don't matter. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def found_by(sent):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                ids, texts, found = part["doc_id"].astype("Int64"), part["text"].tolist(), []
                for at, batch in _in_batches(texts):
                    found += [(at + t, sent.value.items[k], s, n, a) for t, k, s, n, a in overlaps(sent.value, batch, span, identity)]
                table = pd.DataFrame(found, columns=["at", "item_id", "start", "span", "agreeing"])
                table["doc_id"] = ids.iloc[table.pop("at")].reset_index(drop=True)
                yield table.astype({"item_id": "Int64"})[["doc_id", "item_id", "start", "span", "agreeing"]]

        return rows.mapInPandas(run, _FOUND)

    parts = _by_blocks(spark, benchmark, span, block_tokens, found_by, "contaminations")
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FOUND)


def _by_blocks(spark: SparkSession, benchmark: DataFrame, span: int, block_tokens: int, found_by: Callable, name: str) -> list[DataFrame]:
    """What ``found_by`` (a broadcast block) returns for each block. One block's result stays a plan; of several, each is written before the next block is sent, so that one broadcast is held at a time."""
    ws = Workspace(spark, name)
    blocks, out = _blocks(benchmark, span, block_tokens), []
    block = next(blocks, None)
    while block is not None:
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)
        found = found_by(sent)
        if out or block is not None:
            found = ws.table(found, str(len(out)))
            sent.destroy()
        out.append(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, identity: float = IDENTITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows that ``contaminations`` finds. All columns are kept and no row of theirs moves.

    Rows with null or empty text stay. Repeated rows go or stay together. With an empty benchmark all rows stay;
    an empty table gives no rows. Columns of any name pass through.
    """
    spark = docs.sparkSession
    k1, k2 = row_key(docs)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), "text")

    def hit(sent, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for at, own in _in_batches(texts):
            for t, *_ in overlaps(sent.value, own, span, identity):
                out[at + t] = True
        return out

    def found_by(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(hit(sent, batch.column("text").to_pylist()))).select(["k1", "k2"])

        return keyed.mapInArrow(run, "k1 long, k2 long")

    parts = _by_blocks(spark, benchmark, span, block_tokens, found_by, "decontaminated")
    if not parts:
        return docs
    found = Workspace(spark, "contaminated").table(reduce(DataFrame.unionByName, parts).distinct(), "rows")
    marked = docs.withColumns({"__d1": k1, "__d2": k2})
    clean = marked.join(lookup(found), (F.col("__d1") == F.col("k1")) & (F.col("__d2") == F.col("k2")), "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
