"""Psychoacoustic scales, thresholds, masking budgets and loudness: as columns where they are scalar, else on numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import frames_of, kept

BANDS = 24


def hz_to_bark(f, method: str = "traunmuller"):
    """Bark of a frequency in Hz, a column or an array."""
    m = F if isinstance(f, Column) else np
    if method == "traunmuller":
        return 26.81 * f / (1960.0 + f) - 0.53
    if method == "zwicker":
        atan = m.atan if m is F else np.arctan
        return 13.0 * atan(0.00076 * f) + 3.5 * atan((f / 7500.0) * (f / 7500.0))
    if method == "wang":
        return 6.0 * (m.asinh if m is F else np.arcsinh)(f / 600.0)
    raise ValueError(f"unknown Bark formula {method}")


def bark_to_hz(z, method: str = "traunmuller"):
    if method == "traunmuller":
        return 1960.0 * (z + 0.53) / (26.28 - z)
    if method == "wang":
        return 600.0 * (F.sinh if isinstance(z, Column) else np.sinh)(z / 6.0)
    if method == "zwicker":
        raise NotImplementedError("the Zwicker formula has no closed inverse")
    raise ValueError(f"unknown Bark formula {method}")


def erb_rate(f):
    return 21.4 * (F.log10 if isinstance(f, Column) else np.log10)(1 + 0.00437 * f)


def absolute_threshold(f):
    """Threshold in quiet in dB, within [-20, 120]; 100 at zero Hz."""
    if isinstance(f, Column):
        k = f / 1000.0
        t = 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * (k - 3.3) * (k - 3.3)) + 0.001 * k * k * k * k
        return F.when(f < 0, F.raise_error(F.lit("negative frequency"))).when(f == 0, F.lit(100.0)).otherwise(F.least(F.greatest(t, F.lit(-20.0)), F.lit(120.0)))
    f = np.asarray(f, float)
    if np.isnan(f).any() or (f < 0).any():
        raise ValueError("frequencies must be numbers from zero")
    k = np.where(f > 0, f, 1.0) / 1000.0
    t = np.clip(3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 0.001 * k**4, -20, 120)
    return np.where(f > 0, t, 100.0)


def grid(n: int, sr: int) -> np.ndarray:
    return np.arange(n // 2 + 1) * sr / n


def band_power(power: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Power of the Bark bands 0-1, 1-2 ... 23-24 (half-open)."""
    band = np.floor(hz_to_bark(freqs)).astype(int)
    ok = (band >= 0) & (band < BANDS)
    return np.bincount(band[ok], power[ok], BANDS)


@kept()
def _slopes(n: int, below: float, above: float) -> np.ndarray:
    d = np.arange(n)[:, None] - np.arange(n)[None]
    return np.where(d < 0, below * d, -above * d)


def spread(levels: np.ndarray, below: float = 27.0, above: float = 5.0) -> np.ndarray:
    """The largest masker at each band (of the last axis): a masker falls 27 dB a Bark downwards and 5 dB upwards."""
    return (levels[..., None, :] + _slopes(levels.shape[-1], below, above)).max(-1)


@kept()
def quiet(n: int, sr: int) -> np.ndarray:
    """The threshold in quiet of the bins of n samples."""
    return absolute_threshold(grid(n, sr))


@kept()
def _places(n: int, sr: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band of each bin, first bin of each band, levels of the bands' counts, Bark of each bin)."""
    bark = hz_to_bark(grid(n, sr))
    band = np.floor(bark).astype(int)
    count = np.maximum(np.bincount(np.clip(np.floor(bark), 0, BANDS - 1).astype(int), minlength=BANDS)[:BANDS], 1)
    return band, np.searchsorted(band, np.arange(BANDS + 1)), 10 * np.log10(count), bark


def thresholds(frames: np.ndarray, sr: int) -> np.ndarray:
    """:func:`simultaneous_threshold` of each row."""
    if frames.ndim != 2 or sr <= 0 or not np.isfinite(frames).all():
        raise ValueError("one channel of finite samples and a positive rate are needed")
    n = frames.shape[1]
    low = quiet(n, sr)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    _, edges, counts, bark = _places(n, sr)
    levels = np.empty((len(frames), BANDS))
    for b in range(BANDS):
        levels[:, b] = power[:, edges[b] : edges[b + 1]].sum(1)
    masked = spread(10 * np.log10(np.maximum(levels, 1e-12))) - counts
    k, share = _between(n, sr)
    out = np.maximum(masked[:, k] * (1 - share) + masked[:, np.minimum(k + 1, BANDS - 1)] * share, low)
    return np.where(power.any(1)[:, None], out, low)


@kept()
def _between(n: int, sr: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bin lies between the middles of two bands."""
    at = np.clip(_places(n, sr)[3] - 0.5, 0, BANDS - 1)
    k = np.floor(at).astype(int)
    return k, at - k


def simultaneous_threshold(x: np.ndarray, sr: int) -> np.ndarray:
    """Masking threshold in dB of each rfft bin; the threshold in quiet where it is higher or all is silent."""
    x = np.asarray(x, float)
    if x.ndim != 1 or sr <= 0 or not np.isfinite(x).all():
        raise ValueError("one channel of finite samples and a positive rate are needed")
    low = quiet(len(x), sr)
    power = np.abs(np.fft.rfft(x)) ** 2
    if not power.any():
        return low.copy()
    band, _, counts, bark = _places(len(x), sr)
    ok = slice(*np.searchsorted(band, (0, BANDS)))
    levels = 10 * np.log10(np.maximum(np.bincount(band[ok], power[ok], BANDS), 1e-12))
    return np.maximum(np.interp(bark, np.arange(BANDS) + 0.5, spread(levels) - counts), low)


def temporal_threshold(x: np.ndarray, sr: int, frame: float = 0.025, hop: float = 0.01) -> np.ndarray:
    """(frames, bins): the most of up to 15 earlier frames' thresholds, falling with the logarithm of the lag."""
    size, step = max(2, int(frame * sr)), max(1, int(hop * sr))
    own = thresholds(frames_of(x, size, step), sr)
    out = own.copy()
    for lag in range(1, min(15, len(own) - 1) + 1):
        out[lag:] = np.maximum(out[lag:], own[:-lag] - 12 * np.log2(max(lag * hop / 0.01, 1.0)))
    return out


def masking_budget(x: np.ndarray, sr: int, margin_db: float) -> np.ndarray:
    """Power under the threshold by a margin, per bin."""
    return _under(simultaneous_threshold(x, sr), margin_db)


def _under(threshold: np.ndarray, margin_db) -> np.ndarray:
    if np.min(margin_db) < 0:
        raise ValueError("the margin must not be negative")
    return np.maximum(10 ** ((threshold - margin_db) / 10), np.finfo(float).tiny)


def budget_under(threshold: np.ndarray, low: np.ndarray, margin_db) -> np.ndarray:
    """The budget of thresholds, zero where only that in quiet governs."""
    return np.where(threshold <= low + 1e-6, 0.0, _under(threshold, margin_db))


def perturbation_budget(x: np.ndarray, sr: int, margin_db: float) -> np.ndarray:
    """The masking budget, zero where only the threshold in quiet governs."""
    return budget_under(simultaneous_threshold(x, sr), quiet(len(x), sr), margin_db)


def perturbation_budgets(frames: np.ndarray, sr: int, margin_db) -> np.ndarray:
    """:func:`perturbation_budget` of each row; a margin for all or a column of them."""
    return budget_under(thresholds(frames, sr), quiet(frames.shape[1], sr), margin_db)


def specific_loudness(x: np.ndarray, sr: int) -> np.ndarray:
    return 0.0635 * band_power(np.abs(np.fft.rfft(x)) ** 2, grid(len(x), sr)) ** 0.23


def loudness(x: np.ndarray, sr: int) -> float:
    return float(specific_loudness(x, sr).sum())


def level_spl(x: np.ndarray) -> float:
    r = float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
    return 20 * np.log10(r / 2e-5) if r > 0 else -np.inf


def to_level_spl(x: np.ndarray, target_db: float) -> np.ndarray:
    r = np.sqrt(np.mean(np.square(x))) if len(x) else 0.0
    if r == 0:
        raise ValueError("silence has no level")
    return x * (2e-5 * 10 ** (target_db / 20) / r)
