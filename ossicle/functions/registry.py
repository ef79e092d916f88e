"""The transforms by key: family, defaults and the function that runs on one channel of samples."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

FAMILIES = {
    "A": "baseline", "B": "temporal", "C": "multirate", "D": "spectral", "E": "noise and interference", "F": "psychoacoustic", "G": "adversarial", "H": "channel",
}


@dataclass(frozen=True)
class Transform:
    key: str
    family: str
    run: Callable[..., np.ndarray]
    defaults: dict[str, Any]
    description: str


_NOT_PARAMETERS = set("condition_index sample_index type name".split())
_known: dict[str, Transform] = {}
_loaded: list[bool] = []


def register(key: str, family: str, run: Callable[..., np.ndarray], description: str = "", *, overwrite: bool = False, **defaults: Any) -> Transform:
    """Add a transform ``run(x, sr, rng, **params)``; the way for users to add their own."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    if not callable(run):
        raise TypeError("a transform must be callable")
    if key in _known and not overwrite:
        raise ValueError(f"{key} is registered already")
    _known[key] = Transform(key, family, run, defaults, description)
    return _known[key]


def transform(key: str, family: str, **defaults: Any):
    """Decorator form of :func:`register`."""

    def add(run):
        register(key, family, run, (run.__doc__ or "").strip(), **defaults)
        return run

    return add


def load() -> dict[str, Transform]:
    if not _loaded:
        from . import channel, psychoacoustic, simple, spectral, temporal  # noqa: F401

        _loaded.append(True)
    return _known


def keys(family: str | None = None) -> list[str]:
    return sorted(k for k, t in load().items() if family in (None, t.family))


def get(key: str) -> Transform:
    found = load()
    if key not in found:
        raise KeyError(f"no transform {key}")
    return found[key]


def apply(key: str, x: np.ndarray, sr: int, params: dict[str, Any] | None = None, seed: int = 42) -> np.ndarray:
    """One transform; explicit parameters go before the registered ones.  The result has no NaN or infinity."""
    t = get(key)
    p = t.defaults | {k: v for k, v in (params or {}).items() if k not in _NOT_PARAMETERS}
    if unknown := set(p) - set(t.defaults):
        raise ValueError(f"{key} has no parameter {', '.join(sorted(unknown))}")
    x = np.asarray(x, float)
    if x.ndim == 2:
        x = x.mean(0)
    if x.ndim != 1:
        raise ValueError("a waveform has one or two dimensions")
    if not len(x):
        return x
    y = t.run(x, sr, np.random.default_rng(seed), **p)
    return y if np.isfinite(y).all() else np.nan_to_num(y, nan=0.0, posinf=1.0, neginf=-1.0)


def chain(steps: list[tuple[str, dict[str, Any]]], x: np.ndarray, sr: int, seed: int = 42) -> np.ndarray:
    """Transforms from left to right; none: x itself."""
    for key, params in steps:
        x = apply(key, x, sr, params, seed)
    return x


def seed_of(*parts: Any) -> int:
    """A seed that depends on the parts alone, whatever the partitioning."""
    return zlib.crc32("|".join(map(str, parts)).encode())


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)
