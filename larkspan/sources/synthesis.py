"""Text to signal through registered backends. No engine ships with this package but a deterministic stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from larkspan.shipping import ship

RATE = 16000
# Voices of the two public engines.
KOKORO_VOICES = tuple(
    "af_alloy af_aoede af_bella af_heart af_jessica af_kore af_nicole af_nova af_river af_sarah af_sky "
    "am_adam am_echo am_eric am_fenrir am_liam am_michael am_onyx am_puck am_santa bf_alice bf_emma bf_isabella bf_lily "
    "bm_daniel bm_fable bm_george bm_lewis".split()
)
PIPER_VOICES = tuple(
    "en_US-lessac-high en_US-lessac-medium en_US-lessac-low en_US-ryan-high en_US-ryan-medium en_US-ryan-low en_US-ljspeech-high "
    "en_US-ljspeech-medium en_US-libritts-high en_US-libritts_r-medium en_US-amy-medium en_US-amy-low en_US-arctic-medium "
    "en_US-hfc_female-medium en_US-hfc_male-medium en_US-joe-medium en_US-kusal-medium en_US-kristin-medium en_GB-alan-medium "
    "en_GB-alan-low en_GB-alba-medium en_GB-aru-medium en_GB-cori-medium en_GB-cori-high en_GB-jenny_dioco-medium "
    "en_GB-northern_english_male-medium en_GB-semaine-medium en_GB-southern_english_female-low en_GB-vctk-medium".split()
)
VOICES = {"kokoro": KOKORO_VOICES, "piper": PIPER_VOICES}


class Backend(Protocol):
    """What a backend does: a signal in [-1, 1] at ``RATE`` for a text and a voice."""

    def synthesize(self, text: str, voice: str, speed: float) -> np.ndarray: ...

    def voices(self) -> list[str]: ...


_factories: dict[str, Callable[..., Backend]] = {}
_pool: dict[tuple[Any, ...], Backend] = {}


def register(name: str, factory: Callable[..., Backend]) -> None:
    _factories[name] = factory


def unregister(name: str) -> None:
    _factories.pop(name, None)


def backends() -> list[str]:
    return sorted(_factories)


def get(name: str, **options: Any) -> Backend:
    """One instance per worker, backend and options."""
    if name not in _factories:
        raise KeyError(f"unknown backend {name!r}; known: {', '.join(backends())}")
    key = (name, *sorted(options.items()))
    if key not in _pool:
        _pool[key] = _factories[name](**options)
    return _pool[key]


class Tones:
    """A stand-in: 60 ms of a tone for each character; pitch and loudness follow from text, voice and place."""

    def __init__(self, voices: tuple[str, ...] = (), **options: Any) -> None:
        self._voices = voices

    def voices(self) -> list[str]:
        return list(self._voices)

    def synthesize(self, text: str, voice: str, speed: float = 1.0) -> np.ndarray:
        if self._voices and voice not in self._voices:
            raise ValueError(f"unknown voice {voice!r}")
        if not 0 < speed <= 3:
            raise ValueError(f"the speed must be above 0 and at most 3, got {speed}")
        size = int(0.06 * RATE / speed)
        time = np.arange(size) / RATE
        parts = []
        for k, c in enumerate(text):
            h = hashlib.md5(f"{voice}|{k}|{c}".encode()).digest()
            parts.append((0.2 + h[0] / 512) * np.sin(2 * np.pi * (120 + 4 * h[1]) * time) if not c.isspace() else np.zeros(size))
        return np.concatenate(parts).astype(np.float32) if parts else np.zeros(0, np.float32)


register("kokoro", lambda **o: Tones(KOKORO_VOICES, **o))
register("piper", lambda **o: Tones(PIPER_VOICES, **o))
register("tones", lambda **o: Tones(**o))


def synthesize(requests: DataFrame, options: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """``path, audio, sample_rate, duration_ms, error`` of ``requests(path, text, voice, backend, speed)``; a failed request has an error and no signal."""
    ship(requests.sparkSession)
    given = options or {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, voice, backend, speed in zip(*(part[c] for c in ("path", "text", "voice", "backend", "speed")), strict=True):
                try:
                    a = get(backend, **given.get(backend, {})).synthesize(text, voice, float(speed))
                    top = np.abs(a).max(initial=0.0)
                    a = (a / top if top > 1 else a).astype(np.float32)
                    rows.append((path, a, RATE, int(len(a) / RATE * 1000), None))
                except (KeyError, ValueError) as problem:
                    rows.append((path, None, RATE, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "audio", "sample_rate", "duration_ms", "error"]).astype({"duration_ms": "Int32"})

    return requests.select("path", "text", "voice", "backend", "speed").mapInPandas(run, "path string, audio array<float>, sample_rate int, duration_ms int, error string")


def voice_table(spark: SparkSession) -> DataFrame:
    """``backend, voice``."""
    return spark.createDataFrame([(b, v) for b, own in VOICES.items() for v in own], "backend string, voice string")
