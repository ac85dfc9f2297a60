"""Signal processing that column expressions can't hold: filters, transforms and resampling, as Arrow-batched functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.draws import uniform
from larkspan.shipping import ship

# Numerator and denominator of the pink noise filter.
PINK_B = (0.021128, 0.07872, 0.15877, 0.2118, 0.15877, 0.07872, 0.021128)
PINK_A = (1.0, -1.747, 1.823, -1.129, 0.874, -0.514, 0.178)


def over_audio(kernel: Callable[..., np.ndarray], shape: str = "array<float>") -> Callable[..., Column]:
    """A column function from one that takes an array (and further values of the row)."""

    def call(audio: Column, *more: Column) -> Column:
        ship(SparkSession.getActiveSession())

        @F.pandas_udf(shape)
        def run(a: pd.Series, *rest: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else kernel(np.asarray(x, np.float64), *own) for x, *own in zip(a, *rest, strict=True)])

        return run(audio, *more)

    return call


def generator(seed: int, purpose: str, key: object) -> np.random.Generator:
    """A generator that depends on seed, purpose and key alone."""
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{purpose}|{key}".encode()).digest()[:8], "big"))


def pink(white: np.ndarray) -> np.ndarray:
    """Filter white noise by the pole-zero form, section by section through its impulse response."""
    response = np.zeros(min(len(white), 4096))
    for n in range(len(response)):
        total = PINK_B[n] if n < len(PINK_B) else 0.0
        for k in range(1, min(n, len(PINK_A) - 1) + 1):
            total -= PINK_A[k] * response[n - k]
        response[n] = total
    return convolve(white, response)[: len(white)]


def convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Full convolution by fast Fourier transform."""
    size = len(a) + len(b) - 1
    n = 1 << max(0, size - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[:size]


def coloured(n: int, colour: str, rng: np.random.Generator) -> np.ndarray:
    """White (half scale), pink or brown noise of ``n`` samples."""
    white = rng.standard_normal(n)
    if colour == "white":
        return white * 0.5
    if colour == "pink":
        return pink(white)
    if colour != "brown":
        raise ValueError(f"unknown colour {colour!r}")
    brown = np.cumsum(white)
    brown = brown - brown.mean() if n else brown
    spread = brown.std() if n else 0
    return (brown / spread if spread > 0 else brown) * 0.25


def mix(a: np.ndarray, noise: np.ndarray, snr_db: float, compat: bool = False) -> np.ndarray:
    """``signal.mix_at_snr`` for arrays."""
    signal, other = float((a * a).mean()) if len(a) else 0.0, float((noise * noise).mean()) if len(noise) else 0.0
    if signal <= 0 or other <= 0:
        return a.astype(np.float32)
    wanted = signal / 10 ** (snr_db / 10)
    out = a + noise * np.sqrt(wanted if compat else wanted / other)
    top = np.abs(out).max()
    return (out / top if top > 1 else out).astype(np.float32)


def add_coloured_noise(colour: str, low: float, high: float, p: float = 1.0, seed: int = 42, compat: bool = False):
    """A transform that mixes generated noise at a drawn ratio, with probability ``p``. Noise and mixture are made in one crossing to Python."""

    def make(a: np.ndarray, key: str, snr: float, wanted: bool) -> np.ndarray:
        return mix(a, coloured(len(a), colour, generator(seed, colour, key)), snr, compat) if wanted else a.astype(np.float32)

    def apply(audio: Column, key: Column) -> Column:
        snr = F.lit(low) + uniform(seed, f"snr {colour}", key) * (high - low)
        return over_audio(make)(audio, key.cast("string"), snr, uniform(seed, f"{colour}?", key) <= p)

    return apply


def reverberate(a: np.ndarray, impulse: np.ndarray) -> np.ndarray:
    """Convolve with an impulse response of unit peak, keep the middle, and leave headroom if the peak exceeds 0.99."""
    impulse = np.asarray(impulse, np.float64)
    top = np.abs(impulse).max(initial=0.0)
    if not len(a) or top <= 0:
        return a.astype(np.float32)
    full = convolve(a, impulse / top)
    at = (len(impulse) - 1) // 2
    out = full[at : at + len(a)]
    high = np.abs(out).max()
    return (out / (1.1 * high) if high > 0.99 else out).astype(np.float32)


def resample(a: np.ndarray, source: int, target: int) -> np.ndarray:
    """Band-limited resampling by a windowed sinc, 16 zero crossings on each side."""
    if source == target or not len(a):
        return a.astype(np.float32)
    size = int(np.ceil(len(a) * target / source))
    cut = min(1.0, target / source)
    reach = int(np.ceil(16 / cut))
    place = np.arange(size) * (source / target)
    near = np.floor(place).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)[None]
    away = place[:, None] - near
    weights = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
    inside = (near >= 0) & (near < len(a))
    return (np.where(inside, a[np.clip(near, 0, len(a) - 1)], 0.0) * weights).sum(axis=1).astype(np.float32)


def linear_resample(a: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation to ``int(len / source * target)`` samples."""
    size = int(len(a) / source * target)
    return np.interp(np.linspace(0, len(a) - 1, size), np.arange(len(a)), a).astype(np.float32) if size and len(a) else np.zeros(0, np.float32)


def frames(a: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames centred at multiples of ``hop``, zero-padded at both ends."""
    padded = np.pad(a, size // 2)
    count = 1 + (len(padded) - size) // hop if len(padded) >= size else 0
    return padded[np.arange(count)[:, None] * hop + np.arange(size)[None]]


def trim_silence(a: np.ndarray, top_db: float = 20.0, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Cut ends whose frames are more than ``top_db`` below the loudest."""
    if not len(a):
        return a.astype(np.float32)
    rms = np.sqrt((frames(a, size, hop) ** 2).mean(axis=1))
    top = rms.max(initial=0.0)
    loud = np.flatnonzero(20 * np.log10(np.maximum(rms, 1e-10) / max(top, 1e-10)) > -top_db) if top > 0 else np.zeros(0, int)
    return a[loud[0] * hop : min(len(a), (loud[-1] + 1) * hop)].astype(np.float32) if len(loud) else np.zeros(0, np.float32)


def mel_filters(rate: int, n_fft: int, n_mels: int, low: float, high: float) -> np.ndarray:
    """Triangular filters of equal area, evenly spaced on the mel scale that is linear up to 1 kHz and logarithmic above."""
    linear, log_from, step = 200.0 / 3, 1000.0, np.log(6.4) / 27

    def mel(f: np.ndarray) -> np.ndarray:
        return np.where(f < log_from, f / linear, log_from / linear + np.log(np.maximum(f, 1e-9) / log_from) / step)

    def hertz(m: np.ndarray) -> np.ndarray:
        return np.where(m < log_from / linear, m * linear, log_from * np.exp(step * (m - log_from / linear)))

    edges = hertz(np.linspace(mel(np.array(low)), mel(np.array(high)), n_mels + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(a: np.ndarray, rate: int = 16000, n_mels: int = 40, hop: int = 480, n_fft: int = 2048, low: float = 0.0, high: float = 8000.0) -> np.ndarray:
    """Log-mel power in decibels below the loudest bin, ``n_mels`` x frames, at most 80 dB down."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    spectrum = np.abs(np.fft.rfft(frames(a, n_fft, hop) * window, axis=1)) ** 2
    mels = mel_filters(rate, n_fft, n_mels, low, high) @ spectrum.T
    db = 10 * np.log10(np.maximum(mels, 1e-10)) - 10 * np.log10(max(1e-10, mels.max(initial=0.0)))
    return np.maximum(db, db.max(initial=0.0) - 80.0).astype(np.float32)


#: Parameters of the two feature exports.
RAGGED_MEL = {"n_mels": 40, "hop": 480, "n_fft": 2048}
DENSE_MEL = {"n_mels": 96, "hop": 160, "n_fft": 512}


def fit_frames(mel: np.ndarray, size: int) -> np.ndarray:
    """Zero-pad or cut the time axis alone."""
    return np.pad(mel[:, :size], ((0, 0), (0, max(0, size - mel.shape[1]))))


def mel_features(**parameters: float) -> Callable[[Column], Column]:
    """Log-mel as ``array<array<float>>``."""
    return over_audio(lambda a: [row.tolist() for row in log_mel(a, **parameters)], "array<array<float>>")
