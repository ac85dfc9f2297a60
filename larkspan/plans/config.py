"""Configuration of a dataset build, checked as it is read."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Accelerations, strategies, and output formats by the trainers that read them.
ACCELERATIONS = ("cpu", "cuda", "openvino")
STRATEGIES = ("random", "sentence", "topic")
FORMATS = {"microwakeword": "ragged", "openwakeword": "dense"}


class ConfigError(ValueError):
    """A configuration that can't be used."""


def _need(ok: bool, said: str) -> None:
    if not ok:
        raise ConfigError(said)


@dataclass(frozen=True)
class Samples:
    positives: int
    negatives_multiplier: int

    def __post_init__(self) -> None:
        _need(self.positives > 0, "samples.positives must be positive")
        _need(self.negatives_multiplier > 0, "samples.negatives_multiplier must be positive")


@dataclass(frozen=True)
class Provider:
    backend: str
    voices: tuple[str, ...]
    speed: float = 1.0
    acceleration: str = "cpu"
    device: str | None = None
    model_path: str | None = None

    def __post_init__(self) -> None:
        _need(bool(self.backend), "a provider needs a backend")
        _need(bool(self.voices), "a provider needs voices")
        _need(0 < self.speed <= 3, "a speed must be above 0 and at most 3")
        object.__setattr__(self, "acceleration", self.acceleration.strip().lower())
        _need(self.acceleration in ACCELERATIONS, f"an acceleration must be one of {', '.join(ACCELERATIONS)}, not {self.acceleration!r}")
        for name in ("device", "model_path"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, value.strip())
                _need(bool(value.strip()), f"a given {name} must not be empty")
        _need(not (self.backend.strip().lower() == "piper" and self.acceleration == "openvino"), "piper runs on cpu and cuda, not openvino")

    @property
    def key(self) -> tuple[Any, ...]:
        """What tells instances of a backend apart."""
        return self.backend, self.speed, self.acceleration, self.device, self.model_path


@dataclass(frozen=True)
class Augmentation:
    noise_snr: tuple[float, float]
    reverb_probability: float
    gain_range: tuple[float, float]

    def __post_init__(self) -> None:
        for name in ("noise_snr", "gain_range"):
            value = getattr(self, name)
            _need(len(value) == 2, f"augmentation.{name} must have two values")
            _need(value[0] <= value[1], f"augmentation.{name} must be in order")
        _need(0 <= self.reverb_probability <= 1, "augmentation.reverb_probability must be between 0 and 1")


@dataclass(frozen=True)
class Confusion:
    enabled: bool = True
    weight: float = 0.6
    min_similarity: float = 0.6

    def __post_init__(self) -> None:
        _need(self.weight >= 0, "the weight of confusions must not be negative")
        _need(0 <= self.min_similarity <= 1, "min_similarity must be between 0 and 1")


@dataclass(frozen=True)
class Synthetic:
    enabled: bool = True
    weight: float = 0.4
    strategy: str = "random"
    min_word_count: int = 2
    max_word_count: int = 4
    topics: tuple[str, ...] | None = None
    word_list: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        _need(self.weight >= 0, "the weight of synthetic phrases must not be negative")
        _need(self.strategy in STRATEGIES, f"a strategy must be one of {', '.join(STRATEGIES)}")
        _need(self.min_word_count >= 1, "min_word_count must be at least 1")
        _need(self.min_word_count <= self.max_word_count, "numbers of words must be in order")
        for name in ("topics", "word_list"):
            _need(getattr(self, name) is None or bool(getattr(self, name)), f"given {name} must not be empty")


@dataclass(frozen=True)
class Negatives:
    confusion: Confusion = field(default_factory=Confusion)
    synthetic: Synthetic = field(default_factory=Synthetic)
    custom_phrases: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        on = self.sources
        _need(self.confusion.enabled or self.synthetic.enabled, "at least one source of negatives must be enabled")
        _need(sum(w for _, w in on) > 0, "enabled sources of negatives must have a positive weight in total")
        if self.custom_phrases is not None:
            _need(bool(self.custom_phrases), "given custom_phrases must not be empty")
            clean = [" ".join(p.split()) for p in self.custom_phrases]
            _need(all(clean), "custom_phrases must not hold empty ones")
            first: dict[str, str] = {}
            for p in clean:
                first.setdefault(p.lower(), p)
            object.__setattr__(self, "custom_phrases", tuple(first.values()))

    @property
    def sources(self) -> list[tuple[str, float]]:
        """Enabled sources and their weights."""
        return [(n, s.weight) for n, s in (("confusion", self.confusion), ("synthetic", self.synthetic)) if s.enabled]


@dataclass(frozen=True)
class Output:
    path: str
    format: tuple[str, ...]

    def __post_init__(self) -> None:
        _need(bool(self.path), "output.path must not be empty")
        _need(bool(self.format), "output.format must not be empty")
        for f in self.format:
            _need(f in FORMATS, f"unknown output.format {f!r}")


@dataclass(frozen=True)
class Config:
    wake_word: str
    samples: Samples
    providers: tuple[Provider, ...]
    output: Output
    augmentation: Augmentation
    negatives: Negatives = field(default_factory=Negatives)
    variants: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        _need(bool(self.wake_word.strip()), "wake_word must not be empty")
        _need(bool(self.providers), "tts.providers must not be empty")
        if self.variants is not None:
            _need(bool(self.variants), "given wake_word_variants must not be empty")
            clean = [" ".join(v.split()) for v in self.variants]
            _need(all(clean), "wake_word_variants must not hold empty ones")
            object.__setattr__(self, "variants", tuple(dict.fromkeys(clean)))

    @property
    def phrases(self) -> tuple[str, ...]:
        """Explicit variants, or the wake word with blanks for underscores."""
        return self.variants or (self.wake_word.replace("_", " "),)

    @property
    def voices(self) -> list[tuple[str, str]]:
        """All (backend, voice) pairs."""
        return [(p.backend, v) for p in self.providers for v in p.voices]


def _section(data: dict[str, Any], name: str, required: bool = True) -> dict[str, Any]:
    found = data.get(name)
    _need(isinstance(found, dict) or (found is None and not required), f"{name} is missing or no mapping")
    return found or {}


def parse(data: Any) -> Config:
    """Check and build; every problem is a ``ConfigError``."""
    _need(isinstance(data, dict), "a configuration must be a mapping")
    _need(bool(data.get("wake_word")), "wake_word is missing")
    samples, tts = _section(data, "samples"), _section(data, "tts")
    _need(isinstance(tts.get("providers"), list), "tts.providers is missing or no list")
    augmentation, output = _section(data, "augmentation"), _section(data, "output")
    negatives = _section(data, "negatives", required=False)

    def listed(value: Any) -> tuple[str, ...] | None:
        return None if value is None else tuple(value)

    try:
        synthetic = dict(negatives.get("synthetic") or {})
        return Config(
            wake_word=str(data["wake_word"]),
            samples=Samples(samples["positives"], samples["negatives_multiplier"]),
            providers=tuple(Provider(**{**p, "voices": tuple(p["voices"] or ())}) for p in tts["providers"]),
            augmentation=Augmentation(tuple(augmentation["noise_snr"]), augmentation["reverb_probability"], tuple(augmentation["gain_range"])),
            negatives=Negatives(
                Confusion(**(negatives.get("confusion") or {})),
                Synthetic(**{**synthetic, **{k: listed(synthetic.get(k)) for k in ("topics", "word_list")}}),
                listed(negatives.get("custom_phrases")),
            ),
            output=Output(output["path"], tuple(output["format"])),
            variants=listed(data.get("wake_word_variants")),
        )
    except (KeyError, TypeError) as problem:
        raise ConfigError(f"a value is missing or of a wrong kind: {problem}") from problem


def load(path: str | Path) -> Config:
    """Read YAML."""
    import yaml

    try:
        return parse(yaml.safe_load(Path(path).read_text()))
    except (OSError, yaml.YAMLError) as problem:
        raise ConfigError(f"{path} can't be read: {problem}") from problem
