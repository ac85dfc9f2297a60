"""Crossing, dealing and splitting: who speaks what, and which group goes to which split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.draws import order_key
from larkspan.operators.manifest import speaker_counts


def combinations(variants: DataFrame, providers: DataFrame) -> DataFrame:
    """``combo, phrase, backend, voice``: each variant with each provider's voices, variants outermost.

    ``variants``: ``variant_pos, phrase``; ``providers``: ``provider_pos, backend, voices[]``. Providers come from a
    configuration, so their table is small by nature.
    """
    voices = providers.select("provider_pos", "backend", F.posexplode("voices").alias("voice_pos", "voice"))
    crossed = variants.join(F.broadcast(voices), F.lit(True))
    order = Window.orderBy("variant_pos", "provider_pos", "voice_pos")
    return crossed.select((F.row_number().over(order) - 1).cast("long").alias("combo"), "phrase", "backend", "voice")


def deal(rows: DataFrame, position: str, combos: DataFrame, base: int = 0) -> DataFrame:
    """Row at position i gets combination (base + i) modulo their number."""
    sized = combos.withColumn("__n", F.count("*").over(Window.partitionBy()))
    numbered = rows.join(F.broadcast(combos.agg(F.count("*").alias("__n"))), F.lit(True))
    keyed = numbered.withColumn("combo", F.pmod(F.col(position) + base, F.col("__n")).cast("long")).drop("__n")
    return keyed.join(F.broadcast(sized.drop("__n")), "combo")


def execution_order(rows: DataFrame) -> DataFrame:
    """Group rows that one backend instance serves: same backend, acceleration and voice together, in order of position."""
    return rows.repartition("backend", "acceleration", "voice").sortWithinPartitions("backend", "acceleration", "voice", "position")


def allocate(sources: DataFrame, total: int) -> DataFrame:
    """``source, n``: shares of ``total`` by ``weight``, rounded down; what is left goes to the largest remainders, then the larger shares.

    Sources come from a configuration, so one window over all of them is small by nature.
    """
    whole = Window.partitionBy()
    raw = sources.withColumn("__raw", F.lit(float(total)) * (F.col("weight") / F.sum("weight").over(whole))).withColumn("__n", F.floor("__raw").cast("long"))
    order = Window.orderBy((F.col("__raw") - F.col("__n")).desc(), F.col("__raw").desc(), F.col("source"))
    left = F.lit(total) - F.sum("__n").over(whole)
    return raw.select("source", (F.col("__n") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).cast("long").alias("n"))


SPLIT_SHARES = (0.7, 0.15, 0.15)


def check_shares(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError(f"the shares must sum to 1, got {train + val + test}")


def _fold(train: float, val: float) -> Column:
    """Assign an ordered array of groups ``(kind, k, positives, negatives)``; the state is what the next choice depends on."""
    positives, negatives = F.col("__all_positive").cast("double"), F.col("__all").cast("double") - F.col("__all_positive")
    goal = positives / (positives + negatives)
    target_train, target_val = F.floor(F.col("__all") * F.lit(train)), F.floor(F.col("__all") * F.lit(val))
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("vals"), F.array().cast("array<struct<speaker:string,split:string>>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        turn = g["k"] % 3
        fits_p = (s["p"] + g["positives"]) <= target_train + target_val * F.lit(0.3)
        fits_n = (s["n"] + g["negatives"]) <= target_train * F.lit(1.2)
        pure = F.when((turn == 0) & F.when(g["kind"] == 0, fits_p).otherwise(fits_n), "train").when(turn == 1, "val").otherwise("test")
        have = s["p"] + s["n"]
        now = F.when(have > 0, s["p"].cast("double") / have.cast("double")).otherwise(F.lit(0.5))
        own = g["positives"].cast("double") / (g["positives"] + g["negatives"]).cast("double")
        mixed = F.when(F.abs(now - goal) > F.abs(now + own - F.lit(2.0) * goal), "train").when(s["vals"].cast("double") < F.col("__groups") * F.lit(val), "val").otherwise("test")
        split = F.when(g["kind"] == 2, mixed).otherwise(pure)
        to_train = (split == "train").cast("long")
        return F.struct(
            (s["p"] + to_train * g["positives"]).alias("p"),
            (s["n"] + to_train * g["negatives"]).alias("n"),
            (s["vals"] + (split == "val").cast("long")).alias("vals"),
            F.concat(s["out"], F.array(F.struct(g["speaker"].alias("speaker"), split.alias("split")))).alias("out"),
        )

    return F.aggregate("__ordered", start, step, lambda s: s["out"])


def assign_groups(manifest: DataFrame, shares: tuple[float, float, float] = SPLIT_SHARES, seed: int = 42, by: str = "voice") -> DataFrame:
    """``speaker, split``: whole groups to train, val or test.

    Groups of positives only, then of negatives only, go round the three splits, train being skipped for
    test once it would exceed its cap; mixed groups go to train if that brings its share of positives nearer to
    the whole's, else to val while it has too few groups, else to test. Groups of a kind are shuffled by a draw.
    The choice depends on all choices before, so groups, not rows, are folded in order: their array must fit
    one task.
    """
    check_shares(*shares)
    counts = speaker_counts(manifest, by)
    kind = F.when(F.col("negatives") == 0, 0).when(F.col("positives") == 0, 1).otherwise(2)
    keyed = counts.select("speaker", "positives", "negatives", kind.alias("kind"), order_key(seed, "split", F.col("speaker")).alias("o"))
    gathered = keyed.agg(
        F.array_sort(F.collect_list(F.struct("kind", "o", "speaker", "positives", "negatives"))).alias("__sorted"),
        F.sum(F.col("positives") + F.col("negatives")).alias("__all"),
        F.sum("positives").alias("__all_positive"),
        F.count("*").alias("__groups"),
    )
    first = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.size(F.filter("__sorted", lambda g: g["kind"] < k)))
    numbered = gathered.withColumn("__first", first).withColumn("__ordered", F.transform("__sorted", lambda g, i: F.struct(g["kind"].alias("kind"), (i - F.element_at("__first", g["kind"] + 1)).alias("k"), g["speaker"].alias("speaker"), g["positives"].alias("positives"), g["negatives"].alias("negatives"))))
    return numbered.select(F.explode(_fold(shares[0], shares[1])).alias("a")).select("a.speaker", "a.split")


def split_rows(manifest: DataFrame, assigned: DataFrame, by: str = "voice") -> DataFrame:
    """The manifest with each row's ``split``. One row per group is sent along."""
    from larkspan.operators.manifest import speaker

    return manifest.withColumn("__speaker", speaker(by)).join(assigned.withColumnRenamed("speaker", "__speaker"), "__speaker").drop("__speaker")


def split_by_share(manifest: DataFrame, shares: tuple[float, float, float] = SPLIT_SHARES, seed: int = 42, by: str = "voice") -> DataFrame:
    """An alternative that scales to any number of groups: each group draws its split by the shares; nothing is folded."""
    from larkspan.functions.draws import uniform
    from larkspan.operators.manifest import speaker

    check_shares(*shares)
    u = uniform(seed, "share", speaker(by))
    return manifest.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))
