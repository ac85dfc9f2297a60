"""Language identification by mixture inference.

A document is taken as a mixture of languages: each of its letter trigrams comes from language l with
probability share(l) x p(trigram | l). Expectation-maximisation finds the shares for a set of languages;
the set grows by one language at a time as long as the likelihood, less a penalty per language, gains.

p(trigram | l) is learned from labelled documents, from a sample of at most about ``per_language``
documents of each language, chosen by a hash of the id. Trigrams are hashed to ``BUCKETS`` buckets, so the
model is languages x BUCKETS numbers whatever the corpus's size; it is the only thing that is sent to
all workers.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.shipping import ship

BUCKETS = 1 << 16
#: Documents of each language that are learned from, at most (about: a hash decides for each document).
PER_LANGUAGE = 4000
#: The prediction for a text without a letter, and where no language was learned.
NONE = "und"
#: Neighbouring trigrams share letters, so a text of n trigrams counts as n / OVERLAP independent ones.
OVERLAP = 3.0

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter's, or 0 if it is no letter."""
    if not _letters:
        out = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each run of three characters with a letter in its middle; other than letters count as one blank. Empty if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[points]
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    letters = np.concatenate([[0], letters[keep], [0]]).astype(np.uint64)
    middle = np.flatnonzero(letters[1:-1]) + 1
    key = (letters[middle - 1] << np.uint64(42)) | (letters[middle] << np.uint64(21)) | letters[middle + 1]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(48)).astype(np.uint16)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Languages in code point order, and log p(bucket | language) as BUCKETS x languages."""

    names: list[str]
    logs: np.ndarray


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` whose ids aren't held out and whose lang isn't null."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": held[at]})

    sample = labelled.where(draw < share[F.col("lang")]).select("lang", "text")
    # At most languages x BUCKETS rows reach the driver.
    found = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique(), key=lambda s: s.encode())
    counts = np.zeros((BUCKETS, len(names)))
    for k, name in enumerate(names):
        own = found[found["lang"] == name]
        counts[own["bucket"].to_numpy(), k] = own["n"]
    # A twentieth of the mass goes to the average of all languages and, of that, a part to unseen buckets.
    own = counts / np.maximum(1, counts.sum(axis=0))
    common = own.mean(axis=1, keepdims=True)
    return Model(names, np.log(0.95 * own + 0.045 * common + 0.005 / BUCKETS))


def shares(counts: np.ndarray, probs: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture shares by expectation-maximisation and their log-likelihood; ``probs``: buckets x languages, scaled per row."""
    total, pi = counts.sum(), start
    for _ in range(rounds):
        mixed = probs @ pi
        new = pi * (probs.T @ (counts / mixed)) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(counts @ np.log(probs @ pi))


def infer(model: Model, text: str | None) -> list[tuple[str, float]]:
    """Languages of a text and their shares, largest first; none if it has no letter or nothing was learned."""
    grams = trigrams(text)
    if not len(grams) or not model.names:
        return []
    buckets, counts = np.unique(grams, return_counts=True)
    logs = model.logs[buckets]
    alone = counts @ logs
    best = int(np.argmax(alone))
    chosen, pi = [best], np.ones(1)
    if len(model.names) > 1:
        # Relative to the best language, which keeps numbers in range: it has probability one in each row.
        probs = np.exp(np.clip(logs - logs[:, [best]], -40, 40))
        total, have = counts.sum(), 0.0
        penalty = 0.5 * np.log(max(2.0, total / OVERLAP)) + 1.0
        while len(chosen) < len(model.names):
            # The likelihood is concave in the shares, so its slope towards a language bounds what that can gain.
            slope = probs.T @ (counts / (probs[:, chosen] @ pi)) - total
            slope[chosen] = -np.inf
            more = int(np.argmax(slope))
            if slope[more] / OVERLAP <= penalty:
                break
            trial, gained = shares(counts, probs[:, [*chosen, more]], np.append(pi * 0.9, 0.1))
            if (gained - have) / OVERLAP <= penalty:
                break
            chosen, pi, have = [*chosen, more], trial, gained
    found = sorted(zip(pi.tolist(), chosen, strict=True), key=lambda x: (-x[0], x[1]))
    return [(model.names[k], min(1.0, max(0.0, p))) for p, k in found]


_SHAPE = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def _predict(model: Model, text: str | None) -> tuple[str, float, list[dict]]:
    found = infer(model, text)
    return (*(found[0] if found else (NONE, 0.0)), [{"lang": n, "share": p} for n, p in found])


def identify(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` for each row of ``docs(doc_id, text, lang)``.

    The model is learned from ``docs`` unless one is given. ``score`` is the share of ``lang_pred``; ties go
    to the language that comes first in code point order. Texts are whole.

    Null and empty texts and those without a letter get ``und`` with score 0 and no languages, as do all if
    no document has a language to learn from. Null languages aren't learned from; null ids aren't held out.
    Repeated rows are learned from and predicted each. Other columns don't matter. An empty table gives
    no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, per_language))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [_predict(sent.value, t) for t in part["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score", "languages"])
            yield pd.concat([part[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id long, held_out boolean, {_SHAPE}")


def recognised(docs: DataFrame, least_share: float = 1 / 3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose main language has less than ``least_share``. All columns are kept; no row moves."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [p != NONE and s >= least_share for p, s, _ in (_predict(sent.value, t) for t in batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
