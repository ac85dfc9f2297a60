from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "target", "taken", "passes", "shard", "slot", "hilbert", "print", "node", "root", "block", "value", "fingerprint", "component_id", "held_out", "lang_pred", "score", "item_id", "start", "span", "n_words", "kept", "path", "label", "before", "after", "candidate", "vector", "query_id", "rank", "digest"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, odd characters, repeated rows, ids and texts, and a very long text."""
    rng = random.Random(7)
    plain = " ".join(words(rng, 60))
    near = plain.replace(plain.split()[30], "changed", 1)
    rows = [
        (1, plain, "en", "a", 10), (2, plain, "en", "b", 10), (3, near, "en", "a", 10), (4, None, "en", "a", None), (5, "", "de", "b", 0), (6, " \n\t ", None, None, 0),
        (7, "x", None, "a", 1), (None, plain, "en", None, 3), (None, None, None, None, None), (8, "one two three", "fr", "c", 5), (8, "one two three", "fr", "c", 5), (8, "other text here", "fr", "c", 5),
        (9, "ünï çödé 日本 🙂 <|endoftext|> it's  don't", "en", "c", 9), (10, "123 456 !!! ...", "en", "c", 9), (11, " ".join(words(rng, 30_000)), "en", "d", 1), (12, "a\x00b\x1cc d", "en", "d", 1), (13, "y" * 50_000, "en", "d", 1),
    ]
    rows += [(20 + k, " ".join(words(rng, 20 + k)), ["en", "de"][k % 2], f"s{k % 5}", k) for k in range(30)]
    return rows + [(60, plain, "en", "a", 10)] * 3


def odd_docs(spark, clash: bool = True):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("extra") for c in CLASH})
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(rng: random.Random, n: int = 120):
    """Texts with exact copies, near copies and shared passages."""
    shared = " ".join(words(rng, 25))
    out = []
    for k in range(n):
        own = words(rng, rng.randrange(1, 120))
        if k % 4 == 1 and out:
            own = rng.choice(out).split()
            if k % 8 == 1 and len(own) > 3:
                own[rng.randrange(len(own))] = "edited"
        if k % 5 == 2:
            own = [*own, *shared.split()]
        out.append(" ".join(own))
    return out
