"""Signal functions over array columns, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.draws import integer, uniform

Transform = Callable[[Column, Column], Column]


def _floats(audio: Column) -> Column:
    return F.transform(audio, lambda x: x.cast("float"))


def _doubles(audio: Column) -> Column:
    return F.transform(audio, lambda x: x.cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once. In a lambda over samples an expression would be worked out for each sample."""
    return F.element_at(F.transform(F.array(value), body), 1)


def power(audio: Column) -> Column:
    """Mean of squares; 0 for an empty signal."""
    total = F.aggregate(_doubles(audio), F.lit(0.0), lambda a, x: a + x * x)
    return F.when(F.size(audio) > 0, total / F.size(audio)).otherwise(F.lit(0.0))


def peak(audio: Column) -> Column:
    """Largest magnitude; 0 for an empty signal."""
    return F.coalesce(F.array_max(F.transform(_doubles(audio), F.abs)), F.lit(0.0))


def normalise(audio: Column, limit: float = 1.0) -> Column:
    """Divide by the peak if that exceeds ``limit``."""
    both = F.struct(_doubles(audio).alias("a"), peak(audio).alias("top"))
    return let(both, lambda b: _floats(F.when(b["top"] > limit, F.transform(b["a"], lambda x: x / b["top"])).otherwise(b["a"])))


def decibels(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def scale(audio: Column, factor: Column) -> Column:
    # Repeated, not captured: an expression in a lambda would be worked out for each sample.
    return F.zip_with(audio, F.array_repeat(factor, F.size(audio)), lambda x, f: (x.cast("double") * f).cast("float"))


def adjust_gain(low: float, high: float, p: float = 1.0, seed: int = 42) -> Transform:
    """A gain drawn in decibels, with probability ``p``."""

    def apply(audio: Column, key: Column) -> Column:
        db = F.lit(low) + uniform(seed, "gain", key) * (high - low)
        return F.when(uniform(seed, "gain?", key) <= p, scale(audio, decibels(db))).otherwise(_floats(audio))

    return apply


def hard_clip(low: float = -1.0, high: float = 1.0) -> Transform:
    if low >= high:
        raise ValueError(f"the lower limit must be below the upper, got {low} and {high}")
    return lambda audio, key: _floats(F.transform(_doubles(audio), lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))))


def soft_clip(threshold: float = 0.8) -> Transform:
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be above 0 and at most 1, got {threshold}")
    return lambda audio, key: _floats(F.transform(_doubles(audio), lambda x: F.tanh(x / threshold) * threshold))


def fade(audio: Column, samples: int) -> Column:
    """Linear ramps at both ends, each of ``samples`` or half the signal."""
    n = F.size(audio)
    length = F.least(n, F.when(n <= 2 * samples, F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(samples))

    def ramp(k: Column) -> Column:
        return F.when(length > 1, k / (length - 1)).otherwise(F.lit(0.0))

    def one(x: Column, i: Column) -> Column:
        rise = F.when(i < length, ramp(i.cast("double"))).otherwise(F.lit(1.0))
        # A ramp of one sample is 0 at the front and 1 at the back.
        back = F.when(length > 1, ramp((n - 1 - i).cast("double"))).otherwise(F.lit(1.0))
        return x * rise * F.when(i >= n - length, back).otherwise(F.lit(1.0))

    return _floats(F.transform(_doubles(audio), one))


def gain_transition(low: float = -30.0, high: float = 0.0, fade_samples: int = 1000, p: float = 0.5, seed: int = 42) -> Transform:
    """A drawn gain and, with probability ``p``, ramps at both ends."""

    def apply(audio: Column, key: Column) -> Column:
        gained = scale(audio, decibels(F.lit(low) + uniform(seed, "transition", key) * (high - low)))
        return F.when(uniform(seed, "transition?", key) < p, fade(gained, max(1, fade_samples))).otherwise(gained)

    return apply


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))


def stretch(audio: Column, target: int) -> Column:
    """Linear interpolation at ``target`` places from the first to the last sample."""
    n = F.size(audio)

    def at(i: Column) -> Column:
        place = i * ((n - 1) / F.lit(float(max(1, target - 1))))
        low = F.least(F.floor(place).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        a, b = F.element_at(audio, low + 1).cast("double"), F.element_at(audio, high + 1).cast("double")
        return a + (b - a) * (place - low)

    return _floats(F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(target - 1)), at)))


def fixed_size(target: int, mode: str = "pad_or_crop", jitter: bool = False, seed: int = 42) -> Transform:
    """Bring a signal to ``target`` samples: ``pad`` and ``pad_or_crop`` at the end, ``center`` on both sides, ``pad_only`` stretches long ones."""
    if target <= 0:
        raise ValueError(f"the target must be positive, got {target}")
    if mode not in ("pad", "pad_or_crop", "center", "pad_only"):
        raise ValueError(f"unknown mode {mode!r}")

    def apply(audio: Column, key: Column) -> Column:
        a, n = _floats(audio), F.size(audio)
        away = F.abs(F.lit(target) - n)
        if mode == "center":
            front = F.floor(away / 2).cast("int")
            if jitter:
                front = front + F.when((away % 2 == 0) & (away > 0) & (uniform(seed, "jitter", key) < 0.5), 1).otherwise(0)
        elif jitter and mode != "pad_only":
            front = integer(seed, "jitter", key, away + 1)
        else:
            front = F.lit(0)
        padded = F.concat(_zeros(front), a, _zeros(F.greatest(F.lit(0), F.lit(target) - n - front)))
        cut = stretch(audio, target) if mode == "pad_only" else F.slice(a, front + 1, F.lit(target))
        return F.when(n == target, a).when(n < target, padded).otherwise(cut)

    return apply


def fit(noise: Column, size: Column) -> Column:
    """Repeat or cut noise to ``size`` samples."""
    times = F.ceil(size / F.size(noise)).cast("int")
    return F.when(F.size(noise) == 0, F.array().cast("array<float>")).otherwise(F.slice(F.flatten(F.array_repeat(_floats(noise), F.greatest(F.lit(1), times))), F.lit(1), size.cast("int")))


def mix_at_snr(audio: Column, noise: Column, snr_db: Column, compat: bool = False) -> Column:
    """Add noise at a ratio of powers. Silent signals and noises change nothing; a peak above 1 is divided out. ``compat`` takes the noise as of unit power."""
    def mixed(b: Column) -> Column:
        wanted = b["signal"] / F.pow(F.lit(10.0), snr_db / 10.0)
        factor = F.sqrt(wanted if compat else wanted / b["other"])
        sums = let(factor, lambda f: F.zip_with(b["a"], b["n"], lambda x, y: x + y.cast("double") * f))
        return F.when((b["signal"] <= 0) | (b["other"] <= 0), _floats(b["a"])).otherwise(normalise(sums))

    def measured(b: Column) -> Column:
        return let(F.struct(b["a"].alias("a"), b["n"].alias("n"), power(b["a"]).alias("signal"), power(b["n"]).alias("other")), mixed)

    return let(F.struct(_doubles(audio).alias("a"), fit(noise, F.size(audio)).alias("n")), measured)


def rt60(impulse: Column, rate: int = 16000) -> Column:
    """Twice the number of samples from the peak on that are less than 60 dB below it, in seconds; 0 if empty or silent."""
    def measured(b: Column) -> Column:
        tail = F.slice(b["a"], F.array_position(b["a"], b["top"]).cast("int"), F.size(b["a"]))
        above = F.size(F.filter(tail, lambda x: x > b["top"] * F.lit(10 ** (-60 / 20))))
        return F.when((F.size(b["a"]) == 0) | (b["top"] < 1e-10), F.lit(0.0)).otherwise(above * 2 / F.lit(float(rate)))

    return let(F.struct(F.transform(_doubles(impulse), F.abs).alias("a"), peak(impulse).alias("top")), measured)


def mono(channels: Column) -> Column:
    """Mean over an array of channels of equal length."""
    sums = F.aggregate(F.slice(channels, 2, F.size(channels)), _doubles(F.element_at(channels, 1)), lambda a, c: F.zip_with(a, c, lambda x, y: x + y.cast("double")))
    return _floats(F.transform(sums, lambda x: x / F.size(channels)))


def duration_ms(audio: Column, rate: int = 16000) -> Column:
    return (F.size(audio) / F.lit(float(rate)) * 1000.0).cast("int")


def has_nan(audio: Column) -> Column:
    return F.exists(audio, lambda x: F.isnan(x))


def has_infinity(audio: Column) -> Column:
    return F.exists(_doubles(audio), lambda x: F.abs(x) == float("inf"))


def valid_result(audio: Column, rate: Column, duration: Column) -> Column:
    """Whether a synthesised signal lies in [-1, 1], has a positive rate and duration, and a duration that fits its length."""
    wanted = F.size(audio) / rate.cast("double")
    inside = F.forall(_doubles(audio), lambda x: (x >= -1) & (x <= 1))
    return F.coalesce(inside & (rate > 0) & (duration > 0) & (F.abs(duration - wanted) <= 1e-8 + 1e-3 * F.abs(wanted)), F.lit(False))


def compose(transforms: list[Transform]) -> Transform:
    """Apply one after the other."""

    def apply(audio: Column, key: Column) -> Column:
        for t in transforms:
            audio = t(audio, key)
        return audio

    return apply
