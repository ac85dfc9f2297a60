"""SimHash fingerprints and near-duplicate groups.

A fingerprint's bit is one if it is set in more than half the hashes of a document's features. Distinct
fingerprints are linked through the Gray-order index; components of links are groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.components import components
from larkspan.llm.gray_index import GrayIndex, links
from larkspan.llm.shared import row_key
from larkspan.operators.prefix import prefix_sums
from larkspan.tables import Workspace, lookup

#: Hashes whose bits are counted at a time.
_CHUNK = 1 << 14


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For n x words hashes the words whose bits are set in more than half of the n."""
    words = hashes.shape[1]
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8 * words), axis=1)
        # Sums of up to 255 rows fit a byte, which adds much faster than wider numbers.
        for low in range(0, len(bits), 255):
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def shingle_hashes(words: list[bytes], length: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``length`` words joined by spaces, repeats included; of all words if there are fewer; none of no words."""
    joined = b" ".join(words)
    if len(words) <= length:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -length]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[length - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - length + 1)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """64-bit SimHash of a text's shingles; 0 for null text and text without words."""
    hashes = shingle_hashes((text or "").encode().lower().split(), shingle_words)
    return int(_majority(hashes[:, None])[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``doc_id, print long`` for each row of ``docs(doc_id, text)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            prints = np.fromiter((fingerprint(t, shingle_words) for t in part["text"]), np.uint64, len(part))
            yield pd.DataFrame({"doc_id": part["doc_id"], "print": prints.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, print long")


def near_groups(docs: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest id
    that a row reaches by links, its own included. Texts are whole; A-Z is lower-cased and words are
    runs of other than ASCII white space.

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Null
    ids never are the smallest unless a group has no other; its ``component_id`` is null then. Repeated
    rows each keep a row. Other columns don't matter. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.table(fingerprints(docs, shingle_words), "prints")
    classes = ws.table(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    edges = links(classes.select(F.col("print").alias("node"), "print"), radius)
    reach = components(edges).withColumnRenamed("node", "print")
    rooted = classes.join(reach, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.table(rooted.join(least, "root").select("print", "component_id"), "named")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes((text or "").encode().lower().split(), shingle_words))


def set_prints(shingles: np.ndarray, count: int, least: int = 9) -> np.ndarray:
    """The SimHash fingerprint of a set and ``count`` prints of six bits from each of ``least`` least hashes under mixes of their own; none of no shingles.

    Prints of two sets differ in no bit for each least hash that the sets share and in each second bit for others, on average.
    """
    if not len(shingles):
        return np.zeros(0, np.int64)
    # The hashes are mixed well already, so an odd factor of its own gives each kind its order.
    factors = np.random.default_rng(42).integers(0, 1 << 64, (count * least, 1), np.uint64) | np.uint64(1)
    low = np.min([(shingles[at : at + 1024] * factors).min(axis=1) for at in range(0, len(shingles), 1024)], axis=0)
    six = (low >> np.uint64(20) & np.uint64(63)).reshape(count, least)
    # Spread over the word, so that each leading part holds its share of them.
    out = np.bitwise_or.reduce(six << (np.arange(least, dtype=np.uint64) * np.uint64(64 // least)), axis=1)
    return np.concatenate([_majority(shingles[:, None]), out]).view(np.int64)


def _close(prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """A set and others after it that have one of their prints (sets x prints) within the radius; each such pair once."""
    if len(prints) <= 128:
        close = (np.bitwise_count(prints[:, None] ^ prints[None]) <= radius).any(axis=2)
        for i in range(len(prints) - 1):
            yield i, i + 1 + np.flatnonzero(close[i, i + 1 :])
        return
    for k in range(prints.shape[1]):
        own = np.ascontiguousarray(prints[:, k])
        for a, b in GrayIndex(own).search(own, radius, block=max(64, min(2048, (1 << 22) // len(own)))):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]).tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low < high:
                    i, others = int(a[low]), b[low:high]
                    others = others[others > i]
                    # A pair that is close by an earlier print was told there.
                    yield i, others[~(np.bitwise_count(prints[others, :k] ^ prints[i, :k]) <= radius).any(axis=1)]


def linked(sets: list[np.ndarray], prints: np.ndarray, similarity: float, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of one that stands for all it reaches by links: pairs that have one of their ``prints`` (sets x prints) within the radius and whose exact Jaccard similarity is reached. With ``side``, only pairs of different sides."""
    root, sizes, changed = np.arange(len(sets)), np.array([len(x) for x in sets], np.int64), True
    for i, others in _close(prints, radius):
        # A group of copies is one component after its first member.
        if changed and (root == root[0]).all():
            break
        changed = False
        others = others[root[others] != root[i]]
        if side is not None:
            others = others[side[others] != side[i]]
        # A set below ``similarity`` of another's size can't reach it.
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * (1 - 1e-9) * np.maximum(sizes[others], sizes[i])]
        for j in others.tolist():
            if root[i] == root[j]:
                continue
            x, y = sets[i], sets[j]
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if common >= similarity * (len(x) + len(y) - common) * (1 - 1e-12):
                root[root == root[j]] = root[i]
                changed = True
    return root


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, count: int = 14, radius: int = 4, most: int = 4_000_000) -> DataFrame:
    """``__k1, __k2, doc_id, __root`` for each row of ``docs(doc_id, text)``: groups at an exact Jaccard similarity of word shingles.

    Candidates are pairs that the Gray-order index finds within ``radius`` bits by one of their prints: the SimHash fingerprint of
    the shingles, and ``count`` prints of nine least hashes each, as near copies at 0.8 differ in about 10 bits of the fingerprint.
    A pair at 0.8 is missed with a computed probability of 2 in 10,000, whatever kind of edit made it. Every
    candidate is decided by the exact similarity of the sets, in the task of its component of candidates; components
    above ``most`` shingles are cut into runs by size and compared pairwise. Rows with one set of shingles form one
    class. Empty tables, nulls and repeats are as in ``near_groups``.
    """
    ws = Workspace(docs.sparkSession, "similar")
    k1, k2 = row_key(docs)
    texts = docs.select(k1.alias("__k1"), k2.alias("__k2"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = [shingle_set(t, shingle_words) for t in part["text"]]
            node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pd.DataFrame({"__k1": part["__k1"], "__k2": part["__k2"], "doc_id": part["doc_id"], "node": node, "weight": [len(s) + count for s in sets], "prints": [set_prints(s, count) for s in sets]})

    def edges_of(part: pd.DataFrame, side: np.ndarray | None = None) -> pd.DataFrame:
        fresh = ~part["node"].duplicated().to_numpy()
        nodes, sets = part["node"].to_numpy(np.int64)[fresh], [shingle_set(t, shingle_words) for t in part["text"][fresh]]
        root = linked(sets, np.array([set_prints(s, count) for s in sets]).view(np.uint64), similarity, radius, None if side is None else side[fresh])
        apart = root != np.arange(len(root))
        return pd.DataFrame({"a": nodes[apart], "b": nodes[root[apart]]})

    def within(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Partitions are sorted: one component at a time, whichever batches it came in.
        held: list[pd.DataFrame] = []
        for part in parts:
            roots = part["root"].to_numpy()
            cuts = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = part.iloc[a:b]
                if held and len(own) and held[0]["root"].iloc[0] != own["root"].iloc[0]:
                    yield edges_of(pd.concat(held, ignore_index=True))
                    held = []
                held.append(own) if len(own) else None
        if held:
            yield edges_of(pd.concat(held, ignore_index=True))

    def between(part: pd.DataFrame) -> pd.DataFrame:
        same = part["first"].iloc[0] == part["second"].iloc[0]
        return edges_of(part, None if same else part["run"].to_numpy())

    signed = ws.table(texts.mapInPandas(sign, "__k1 long, __k2 long, doc_id long, node long, weight long, prints array<long>"), "signed")
    one = F.min(F.struct("__k1", "__k2")).alias("one")
    classes = ws.table(signed.groupBy("node").agg(one, F.first("weight").alias("weight"), F.first("prints").alias("prints")), "classes")
    found = links(classes.select("node", F.posexplode("prints").alias("part", "print")), radius)
    # Candidates of one another: a class outside of these has no text that moves.
    near = classes.join(components(found), "node").select("node", "root", "weight", F.col("one.__k1").alias("__k1"), F.col("one.__k2").alias("__k2"))
    near = ws.table(near, "near")
    large = ws.table(near.groupBy("root").agg(F.sum("weight").alias("all")).where(F.col("all") > most).select("root"), "large")
    split = large.limit(1).count() > 0
    own = texts.drop("doc_id")
    small = lookup(near.join(large, "root", "left_anti") if split else near)
    edges = own.join(small, ["__k1", "__k2"]).select("root", "node", "text").repartition("root").sortWithinPartitions("root", "node").mapInPandas(within, "a long, b long")
    if split:
        placed = prefix_sums(ws, ws.table(near.join(large, "root", "left_semi"), "many"), "placed", [F.col(c).asc() for c in ("root", "weight", "node")], {"__at": "weight"})
        runs = ws.table(placed.withColumn("run", F.expr(f"__at div {max(1, most // 2)}L")).drop("__at"), "runs")
        ends = runs.groupBy("root", "run").agg(F.min(F.col("weight") - count).alias("low"), F.max(F.col("weight") - count).alias("high"))
        left, right = ends.alias("l"), ends.alias("r")
        meet = (F.col("l.root") == F.col("r.root")) & (F.col("l.run") <= F.col("r.run")) & (F.col("l.high") >= F.col("r.low") * (similarity - 1e-9))
        pairs = left.join(right, meet).select("l.root", F.col("l.run").alias("first"), F.col("r.run").alias("second"))
        sides = pairs.select("root", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("run"))
        told = own.join(runs, ["__k1", "__k2"]).select("root", "run", "node", "text").join(sides, ["root", "run"])
        edges = edges.unionByName(told.groupBy("root", "first", "second").applyInPandas(between, "a long, b long"))
    reach = components(ws.table(edges.distinct(), "edges"))
    return signed.join(reach, "node", "left").select("__k1", "__k2", "doc_id", F.coalesce("root", "node").alias("__root"))


def deduplicated(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: that with the smallest id (null last), then the smallest row hash. All columns are kept."""
    ws = Workspace(docs.sparkSession, "deduplicated")
    groups = similar_groups(docs, shingle_words, similarity)
    # The minimum is aggregated before the shuffle, so a large group is one row per task there.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")).alias("b")
    kept = ws.table(groups.groupBy("__root").agg(best).select(F.col("b.__k1").alias("__p1"), F.col("b.__k2").alias("__p2")), "kept")
    k1, k2 = row_key(docs)
    keyed = docs.withColumns({"__d1": k1, "__d2": k2})
    found = keyed.join(kept, (F.col("__d1") == F.col("__p1")) & (F.col("__d2") == F.col("__p2")), "left_semi")
    return found.dropDuplicates(["__d1", "__d2"]).select(*[F.col(f"`{c}`") for c in docs.columns])
