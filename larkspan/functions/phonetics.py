"""Phonetic codes and similarity of phrases, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspan.shipping import ship


def metaphone(word: str) -> str:
    """The published Metaphone code of a word (Philips, 1990); other characters than letters are dropped."""
    w = "".join(c for c in word.lower() if "a" <= c <= "z")
    if w[:2] in ("kn", "gn", "pn", "ae", "wr"):
        w = w[1:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out, i, n = [], 0, len(w)
    vowels = "aeiou"
    while i < n:
        c, after, prev = w[i], w[i + 1 : i + 2], w[i - 1] if i else ""
        if c == prev and c != "c":
            i += 1
            continue
        step = 1
        if c in vowels:
            if i == 0:
                out.append(c.upper())
        elif c == "b":
            if not (prev == "m" and i == n - 1):
                out.append("B")
        elif c == "c":
            if after and after in "iey":
                if w[i : i + 3] == "cia":
                    out.append("X")
                elif prev != "s":
                    out.append("S")
            elif after == "h":
                out.append("K" if prev == "s" or (i == 0 and w[2:3] and w[2] not in vowels) else "X")
                step = 2
            else:
                out.append("K")
        elif c == "d":
            if after == "g" and w[i + 2 : i + 3] and w[i + 2] in "iey":
                out.append("J")
                step = 2
            else:
                out.append("T")
        elif c == "g":
            ahead = w[i + 2 : i + 3]
            if after == "h" and not (i + 2 == n or ahead in vowels):
                pass
            elif after == "n" and (i + 2 == n or w[i + 2 :] == "ed"):
                pass
            elif after and after in "iey" and prev != "g":
                out.append("J")
            elif after == "h":
                out.append("K" if i == 0 else "" if i + 2 == n else "K")
                step = 2
            else:
                out.append("K")
        elif c == "h":
            if (not prev or prev not in "csptg") and after and after in vowels:
                out.append("H")
        elif c == "k":
            if prev != "c":
                out.append("K")
        elif c == "p":
            out.append("F" if after == "h" else "P")
            step = 2 if after == "h" else 1
        elif c == "q":
            out.append("K")
        elif c == "s":
            if after == "h":
                out.append("X")
                step = 2
            elif w[i : i + 3] in ("sio", "sia"):
                out.append("X")
            else:
                out.append("S")
        elif c == "t":
            if w[i : i + 3] in ("tio", "tia"):
                out.append("X")
            elif after == "h":
                out.append("0")
                step = 2
            elif w[i : i + 3] != "tch":
                out.append("T")
        elif c == "v":
            out.append("F")
        elif c in "wy":
            if after and after in vowels:
                out.append(c.upper())
        elif c == "x":
            out.append("KS")
        elif c == "z":
            out.append("S")
        else:
            out.append(c.upper())
        i += step
    return "".join(out)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by a common beginning of up to four characters where it exceeds 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, pairs = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                pairs.append(c)
                break
    m = len(pairs)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(pairs, [c for c, u in zip(b, used, strict=True) if u], strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + common * weight * (1 - jaro) if jaro > 0.7 else jaro


def phrase_similarity(a: str | None, b: str | None) -> float:
    """1 for equal codes; Jaro-Winkler of single words; else the mean over paired words, less a tenth per word of difference in number. Rounded to two places."""
    left, right = ([c for w in (x or "").lower().split() if (c := metaphone(w))] for x in (a, b))
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    if len(left) == len(right) == 1:
        return round(jaro_winkler(left[0], right[0]), 2)
    total = sum(jaro_winkler(x, y) for x, y in zip(left, right, strict=False))
    return round(total / max(len(left), len(right)) * max(0.5, 1.0 - abs(len(left) - len(right)) * 0.1), 2)


def similarity(a: Column, b: Column) -> Column:
    """``phrase_similarity`` of two columns."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([phrase_similarity(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def confusions(phrases, count: int, least: float = 0.5):
    """``phrase, rank, confusion, similarity``: the ``count`` most similar candidates of each phrase with ``least`` similarity or more."""
    from pyspark.sql import Window

    from larkspan.functions.phrases import confusion_candidates

    made = phrases.select("phrase", F.explode(confusion_candidates(F.col("phrase"))).alias("confusion"))
    scored = made.withColumn("similarity", similarity(F.col("phrase"), F.col("confusion"))).where(F.col("similarity") >= least)
    order = Window.partitionBy("phrase").orderBy(F.desc("similarity"), "confusion")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("phrase", "rank", "confusion", "similarity")
