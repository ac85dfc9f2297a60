"""Named transforms, configurations of them and presets."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from larkspan.functions import dsp, signal

_registry: dict[str, Callable[..., signal.Transform]] = {}


def register(name: str) -> Callable[[Callable[..., signal.Transform]], Callable[..., signal.Transform]]:
    """Add a factory of transforms under a name."""

    def add(factory: Callable[..., signal.Transform]) -> Callable[..., signal.Transform]:
        _registry[name] = factory
        return factory

    return add


register("AdjustGain")(lambda gain_range=(-45, 0), p=1.0, seed=42: signal.adjust_gain(*map(float, gain_range), p, seed))
register("HardClip")(lambda min_val=-1.0, max_val=1.0: signal.hard_clip(min_val, max_val))
register("SoftClip")(lambda threshold=0.8: signal.soft_clip(threshold))
register("GainTransition")(lambda gain_range=(-30, 0), fade_samples=1000, transition_prob=0.5, seed=42: signal.gain_transition(*map(float, gain_range), fade_samples, transition_prob, seed))
register("AddColoredNoise")(lambda color="white", snr_range=(0, 20), p=1.0, seed=42, compat=False: dsp.add_coloured_noise(color, *map(float, snr_range), p, seed, compat))
register("FixedSizeClip")(lambda target_samples, mode="pad_or_crop", jitter=False, seed=42: signal.fixed_size(target_samples, mode, jitter, seed))


def from_config(config: dict[str, Any] | str | Path) -> signal.Transform:
    """A transform from ``{"transforms": [{"type": ..., "kwargs": {...}}]}``, or from a YAML or JSON file of that."""
    if not isinstance(config, dict):
        path = Path(config)
        if path.suffix in (".yaml", ".yml"):
            import yaml

            config = yaml.safe_load(path.read_text())
        elif path.suffix == ".json":
            config = json.loads(path.read_text())
        else:
            raise ValueError(f"unknown kind of file: {path}")
    if not isinstance(config, dict) or not isinstance(config.get("transforms"), list):
        raise ValueError("a configuration needs a list of transforms")
    made = []
    for item in config["transforms"]:
        if item.get("type") not in _registry:
            raise ValueError(f"unknown transform {item.get('type')!r}; known: {', '.join(sorted(_registry))}")
        made.append(_registry[item["type"]](**item.get("kwargs", {})))
    return signal.compose(made)


# The presets.
PRESETS: dict[str, dict[str, Any]] = {
    "minimal": {"transforms": [{"type": "AdjustGain", "kwargs": {"gain_range": [-20, 0], "p": 1.0}}]},
    "default": {"transforms": [{"type": "AdjustGain", "kwargs": {"gain_range": [-45, 0], "p": 1.0}}, {"type": "AddColoredNoise", "kwargs": {"color": "pink", "snr_range": [-5, 15], "p": 0.5}}]},
    "heavy": {
        "transforms": [
            {"type": "AdjustGain", "kwargs": {"gain_range": [-45, 0], "p": 1.0}},
            {"type": "AddColoredNoise", "kwargs": {"color": "pink", "snr_range": [-10, 10], "p": 0.3}},
            {"type": "AddColoredNoise", "kwargs": {"color": "brown", "snr_range": [-15, 5], "p": 0.3}},
            {"type": "AddColoredNoise", "kwargs": {"color": "white", "snr_range": [-20, 0], "p": 0.2}},
        ]
    },
}


def preset(name: str) -> signal.Transform:
    """One of the presets ``minimal``, ``default`` and ``heavy``."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return from_config(PRESETS[name])
