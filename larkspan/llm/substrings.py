"""Removal of repeated word windows, with a count-min prefilter.

Texts are packed into blocks of a few megabytes, written once. Then three passes over the blocks:

1. Each block sketches its windows: counters, of which only the non-zero ones are sent, as sorted and
   compressed cell numbers, to the task that owns their range of cells. There the blocks' sketches are
   merged; a window's count is the least of its counters and never below the truth. Each block gets
   back one bit per cell it sent: whether the merged count is above one.
2. Windows whose counters are all above one go, by 128-bit hash and with the smallest id in the block, to
   the task that owns their range of hashes. It finds the exact smallest id and answers each block. The
   windows' places in the block go along and come back with the answer.
3. Each block marks the words under windows that start in a document with a smaller id; no window is
   hashed again.

A window that is in two documents is above one in every counter, so none is lost; what the sketch lets
through in error ends in pass 2. What a block sends for a window is one entry, however often it occurs
there, so a window in a third of all documents is one entry per block. Widths and numbers of ranges
follow the number of windows, so tasks hold about as much at any size.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.tables import Workspace

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Windows for which a merging task is responsible, about.
RANGE_WINDOWS = 1 << 20
#: Counters per window in each row of the sketch, at least.
CELLS_PER_WINDOW = 16
_NONE = np.iinfo(np.int64).max
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Words whose hashes a worker keeps, at most.
_KEPT_WORDS = 400_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Numbers words as they come and keeps their 128-bit hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes += xxhash.xxh3_128_digest(word)
        return number

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """n x 2 hashes."""
        if len(self) > _KEPT_WORDS:
            self.clear()
            self.hashes = bytearray()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)[numbers]


_words = _Words()
_squeeze = zstandard.ZstdCompressor(level=1)


def _pack(array: np.ndarray) -> bytes:
    """Bytes in planes, which compress better: the high bytes of small numbers are all alike."""
    raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize) if len(array) else np.zeros((0, 1), np.uint8)
    return _squeeze.compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Texts:
    """Documents of a block: ids (null as the largest number) and words."""

    def __init__(self, blob: bytes) -> None:
        self.ids, self.missing, sizes, texts = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        ends = np.cumsum(sizes)
        self.words = [texts[b - n : b].split() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])


class Block(Texts):
    """A block with hashes of its documents' windows."""

    def __init__(self, blob: bytes, window: int) -> None:
        super().__init__(blob)
        hashes = _words.look_up([w for own in self.words for w in own])
        total = len(hashes)
        per_doc = np.maximum(0, self.counts - window + 1)
        self.window_doc = np.repeat(np.arange(len(self.words)), per_doc)
        first = np.cumsum(per_doc) - per_doc
        self.window_at = np.arange(len(self.window_doc)) - first[self.window_doc] + self.starts[self.window_doc]
        n = max(0, total - window + 1)
        out = np.zeros((2, n), np.uint64)
        for side, base in enumerate(_BASE):
            # Sums over 1, 2, 4 ... words, each from two of the last; a window is put together of those in its length.
            run, length, done = np.ascontiguousarray(hashes[:, side]), 1, 0
            while length <= window:
                if window & length:
                    out[side] += run[done : done + n] * np.uint64(pow(int(base), done, 1 << 64))
                    done += length
                run = run[:-length] + run[length:] * np.uint64(pow(int(base), length, 1 << 64))
                length *= 2
        self.high, self.low = _mix(out[0][self.window_at], 1), _mix(out[1][self.window_at], 2)

    def cells(self, row: int, bits: int) -> np.ndarray:
        """The windows' cells in a row of the sketch."""
        return _mix(self.high ^ (self.low >> np.uint64(7)), 3 + row) >> np.uint64(64 - bits)


def pack_blocks(docs: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, windows, blob`` from ``docs(doc_id, text)``. Block numbers hold once the table is written."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pd.DataFrame:
            nonlocal number, held, size
            ids, texts = zip(*held, strict=True)
            missing = np.array([i is None for i in ids])
            data = pickle.dumps((np.array([_NONE if i is None else i for i in ids], np.int64), missing, np.array([len(t) for t in texts], np.int64), b"".join(texts)))
            windows = sum(max(0, len(t.split()) - window + 1) for t in texts)
            out = pd.DataFrame({"block": [number], "windows": [windows], "blob": [zstandard.ZstdCompressor(level=3).compress(data)]})
            number, held, size = number + 1, [], 0
            return out

        for part in parts:
            for i, text in zip(part["doc_id"].astype("Int64").tolist(), part["text"], strict=True):
                raw = (text or "").encode()
                if held and size + len(raw) > block_bytes:
                    yield flush()
                held.append((None if i is pd.NA else i, raw))
                size += len(raw)
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "block long, windows long, blob binary")


def _distinct_sorted(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting: quicker here than by a hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the numbers are among others, which are sorted. A sieve of their low bits spares most of the searches."""
    if not len(among):
        return np.zeros(len(values), bool)
    sieve = np.zeros(1 << 21, bool)
    sieve[(among & np.uint64((1 << 21) - 1)).astype(np.int64)] = True
    out = sieve[(values & np.uint64((1 << 21) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    own = values[at]
    out[at] = among[np.minimum(np.searchsorted(among, own), len(among) - 1)] == own
    return out


def _split(values: np.ndarray, bits: int, range_bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) for the ranges of sorted ``bits``-bit numbers that have any."""
    owner = (values >> np.uint64(bits - range_bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.zeros(1, np.int64)
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Sketching:
    """The passes' functions for one width and depth."""

    def __init__(self, window: int, windows: int, depth: int) -> None:
        self.window, self.depth = window, depth
        self.bits = max(16, math.ceil(math.log2(max(1, windows) * CELLS_PER_WINDOW)))
        self.range_bits = max(0, math.ceil(math.log2(max(1, windows) / RANGE_WINDOWS)))

    def sketch(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's own sketch, by owner of the cells."""
        for part in parts:
            for number, blob in zip(part["block"], part["blob"], strict=True):
                block, rows = Block(blob, self.window), []
                for row in range(self.depth):
                    cells, counts = np.unique(block.cells(row, self.bits), return_counts=True)
                    for owner, a, b in _split(cells, self.bits, self.range_bits):
                        steps = np.diff(cells[a:b], prepend=np.uint64(owner << (self.bits - self.range_bits)))
                        kind = np.uint32 if self.bits - self.range_bits <= 32 else np.uint64
                        rows.append((row << self.range_bits | owner, number, _pack(steps.astype(kind)), np.packbits(counts[a:b] > 1).tobytes()))
                yield pd.DataFrame(rows, columns=["owner", "block", "cells", "more"])

    def merge(self, part: pd.DataFrame) -> pd.DataFrame:
        """Add the sketches of one range of cells; per block a bit for each cell it sent."""
        width = self.bits - self.range_bits
        kind = np.uint32 if width <= 32 else np.uint64
        counts = np.zeros(1 << width, np.uint8)
        sent = []
        for data, more in zip(part["cells"], part["more"], strict=True):
            cells = np.cumsum(_unpack(data, kind).astype(np.int64))
            add = 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(cells))
            counts[cells] = np.minimum(counts[cells] + add, 2)
            sent.append(cells)
        return pd.DataFrame({"block": part["block"], "owner": part["owner"], "data": [np.packbits(counts[cells] > 1).tobytes() for cells in sent]})

    def _repeated(self, block: Block, answers: pd.DataFrame) -> np.ndarray:
        """Windows of a block whose counters are all above one."""
        found = dict(zip(answers["owner"], answers["data"], strict=True))
        keep = np.ones(len(block.high), bool)
        for row in range(self.depth):
            own = block.cells(row, self.bits)
            cells = _distinct_sorted(own)
            bits = [np.unpackbits(np.frombuffer(found[row << self.range_bits | owner], np.uint8), count=b - a) for owner, a, b in _split(cells, self.bits, self.range_bits)]
            above = cells[np.concatenate(bits).astype(bool)] if bits else cells
            keep &= _is_in(own, above)
        return np.flatnonzero(keep)

    def _distinct(self, block: Block, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the windows, the smallest id of each, and each window's place among them."""
        high, low = block.high[windows], block.low[windows]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(order) else np.zeros(0, bool)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        ids = block.ids[block.window_doc[windows]][order]
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        return high[new], low[new], least, place

    def candidates(self, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A block's windows that the sketch lets through, by owner of the hash; with one owner's, where all of them start and which hash each has."""
        rows = []
        for number, blob in zip(blocks["block"], blocks["blob"], strict=True):
            block = Block(blob, self.window)
            windows = self._repeated(block, answers)
            high, low, least, place = self._distinct(block, windows)
            note = pickle.dumps((_pack(np.diff(block.window_at[windows], prepend=0).astype(np.uint32)), _pack(place.astype(np.uint32))))
            split = _split(high, 64, self.range_bits)
            # Blocks choose by hash, so that no owner gets the notes of all.
            chosen = xxhash.xxh3_64_intdigest(str(number)) % max(1, len(split))
            for k, (owner, a, b) in enumerate(split):
                rows.append((owner, number, high[a:b].tobytes() + low[a:b].tobytes(), _pack(least[a:b]), note if k == chosen else None))
        return pd.DataFrame(rows, columns=["owner", "block", "hashes", "least", "note"])

    def smallest(self, part: pd.DataFrame) -> pd.DataFrame:
        """The smallest id of each hash over all blocks."""
        pairs = [np.frombuffer(h, np.uint64).reshape(2, -1) for h in part["hashes"]]
        own = [_unpack(x, np.int64) for x in part["least"]]
        high, low, ids = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), np.concatenate(own)
        order = np.lexsort((low, high))
        new = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
        out = np.empty(len(ids), np.int64)
        out[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in own])
        data = [_pack(out[e - len(x) : e]) for e, x in zip(ends, own, strict=True)]
        return pd.DataFrame({"block": part["block"], "owner": part["owner"], "data": data, "note": part["note"]})

    def remove(self, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A row for each document of a block."""
        rows = []
        for blob in blocks["blob"]:
            block = Texts(blob)
            steps = np.zeros(len(block.words) and int(block.starts[-1]) + 1, np.int64)
            if len(answers):
                told = answers.sort_values("owner")
                at, place = pickle.loads(told["note"].dropna().iloc[0])
                at, place = np.cumsum(_unpack(at, np.uint32), dtype=np.int64), _unpack(place, np.uint32)
                least = np.concatenate([_unpack(x, np.int64) for x in told["data"]])
                at = at[least[place] < np.repeat(block.ids, block.counts)[at]]
                # Windows start at different words each.
                steps[at] += 1
                steps[at + self.window] -= 1
            gone = np.cumsum(steps) > 0
            for k, words in enumerate(block.words):
                mark = gone[block.starts[k] : block.starts[k + 1]]
                removed = int(mark.sum())
                kept = [w for w, m in zip(words, mark.tolist(), strict=True) if not m] if removed else words
                rows.append((None if block.missing[k] else int(block.ids[k]), len(words), removed, b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})


def removed_windows(docs: DataFrame, window: int = 13, depth: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs(doc_id, text)``; ``kept``: the kept words, joined by spaces.

    A word goes if a window of ``window`` words of its document covers it that also starts in a document
    with a smaller id. Words are runs of other than ASCII white space, unchanged; windows are judged on
    the whole input. Equality of windows is equality of 128-bit hashes.

    Null and empty texts have no words; texts shorter than a window lose none. Null ids are larger than
    any other: such rows lose what any row with an id has, and keep what only they share. Rows with the
    same id never take from one another. Other columns don't matter. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    blocks = ws.table(pack_blocks(docs, window, block_bytes), "blocks", codec="uncompressed")
    total = blocks.agg(F.sum("windows")).first()[0] or 0
    run = Sketching(window, total, depth)
    shape = "block long, owner int, data binary"
    sent = blocks.select("block", "blob").mapInPandas(run.sketch, "owner int, block long, cells binary, more binary")
    masks = ws.table(sent.groupBy("owner").applyInPandas(lambda part: run.merge(part), shape), "masks", codec="uncompressed")
    by_block = blocks.select("block", "blob").groupBy("block")
    asked = by_block.cogroup(masks.groupBy("block")).applyInPandas(lambda a, b: run.candidates(a, b), "owner int, block long, hashes binary, least binary, note binary")
    least = ws.table(asked.groupBy("owner").applyInPandas(lambda part: run.smallest(part), f"{shape}, note binary"), "least", codec="uncompressed")
    return by_block.cogroup(least.groupBy("block")).applyInPandas(lambda a, b: run.remove(a, b), "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    """The kept words' SHA-256 in place of the words."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
