"""Family B: time and pitch."""

from __future__ import annotations

import numpy as np

from .kernels import fit, phase_vocoder, pitch_period, resample_poly, smooth, spline, stretch_to
from .registry import need, transform


def shifted(x: np.ndarray, semitones: float, size: int = 512) -> np.ndarray:
    """Pitch moved, length kept."""
    rate = 2 ** (semitones / 12)
    return fit(stretch_to(phase_vocoder(x, 1 / rate, size), len(x)), len(x))


@transform("temporal.time_stretch", "B", rate=1.3, n_fft=512, hop_length=None)
def time_stretch(x, sr, rng, rate, n_fft, hop_length):
    """Faster or slower with the pitch kept."""
    need(rate > 0, "the rate must be positive")
    return phase_vocoder(x, rate, n_fft, hop_length)


@transform("temporal.pitch_shift", "B", n_steps=2.0, n_fft=512, hop_length=None)
def pitch_shift(x, sr, rng, n_steps, n_fft, hop_length):
    """Moved by semitones, the length kept."""
    return shifted(x, n_steps, n_fft)


@transform("temporal.speed_perturbation", "B", factor=1.1)
def speed_perturbation(x, sr, rng, factor):
    """Speed and pitch changed together."""
    need(factor > 0, "the factor must be positive")
    return resample_poly(x, max(1, int(sr / factor)), sr)


@transform("temporal.time_masking", "B", max_mask_ms=120.0, num_masks=1)
def time_masking(x, sr, rng, max_mask_ms, num_masks):
    """Random spans set to zero."""
    need(max_mask_ms >= 0 and num_masks >= 0, "lengths and counts from 0")
    y = x.copy()
    for _ in range(num_masks):
        n = min(int(rng.uniform(0, max_mask_ms) * sr / 1000), len(x))
        at = int(rng.integers(0, len(x) - n + 1))
        y[at : at + n] = 0
    return y


@transform("temporal.dropout", "B", dropout_rate=0.08, segment_ms=10.0)
def dropout(x, sr, rng, dropout_rate, segment_ms):
    """Segments set to zero by chance."""
    need(0 <= dropout_rate <= 1 and segment_ms > 0, "a chance and a positive length")
    part = np.arange(len(x)) // max(1, int(segment_ms * sr / 1000))
    return np.where(rng.random(part[-1] + 1)[part] < dropout_rate, 0.0, x)


def _warped(x, knots, places):
    at = np.sort(np.clip(spline(knots, places, np.arange(len(x))), 0, len(x) - 1))
    return np.interp(at, np.arange(len(x)), x)


@transform("temporal.local_warp", "B", warp_factor=0.15, num_control_points=5)
def local_warp(x, sr, rng, warp_factor, num_control_points):
    """Time bent through jittered control points."""
    need(0 <= warp_factor < 1 and num_control_points >= 2, "a factor below 1 and two points at least")
    knots = np.linspace(0, len(x) - 1, num_control_points)
    moved = knots + rng.uniform(-1, 1, num_control_points) * warp_factor * len(x) / num_control_points
    moved[[0, -1]] = knots[[0, -1]]
    return _warped(x, knots, np.sort(moved))


@transform("temporal.jitter", "B", amplitude_ms=10.0, frequency_hz=5.0)
def jitter(x, sr, rng, amplitude_ms, frequency_hz):
    """Time displaced along a smooth random curve, kept monotone."""
    need(amplitude_ms >= 0 and frequency_hz > 0, "an amplitude from 0 and a positive rate")
    if len(x) < 4 or amplitude_ms == 0:
        return x.copy()
    n = min(len(x), max(4, int(len(x) / sr * frequency_hz) + 2))
    curve = rng.uniform(-1.0, 1.0, n)
    knots = np.linspace(0, len(x) - 1, n)
    bend = spline(knots, curve, np.arange(len(x)))
    at = np.arange(len(x)) + bend / max(np.abs(bend).max(), 1e-12) * amplitude_ms * sr / 1000
    return np.interp(np.sort(np.clip(at, 0, len(x) - 1)), np.arange(len(x)), x)


@transform("temporal.overlap_add", "B", window_size=512, hop_ratio=0.25, window="hann", jitter_ms=0.0)
def overlap_add(x, sr, rng, window_size, hop_ratio, window, jitter_ms):
    """Grains windowed and added again, their starts jittered."""
    need(window_size >= 4 and 0 < hop_ratio <= 1 and window in ("hann", "hamming", "rectangular"), "a size, a ratio to 1 and a known window")
    hop, w = max(1, int(window_size * hop_ratio)), {"hann": np.hanning, "hamming": np.hamming, "rectangular": np.ones}[window](window_size)
    padded = np.pad(x, (window_size // 2, window_size * 2))
    out, norm, most = np.zeros(len(padded)), np.zeros(len(padded)), int(jitter_ms * sr / 1000)
    for at in range(0, len(padded) - window_size, hop):
        take = int(np.clip(at + (rng.integers(-most, most + 1) if most else 0), 0, len(padded) - window_size))
        out[at : at + window_size] += padded[take : take + window_size] * w
        norm[at : at + window_size] += w
    return (out / np.where(norm > 1e-8, norm, 1.0))[window_size // 2 : window_size // 2 + len(x)]


@transform("temporal.resampler", "B", factor=1.1)
def resampler(x, sr, rng, factor):
    """Shorter by a factor."""
    need(factor > 0, "the factor must be positive")
    return resample_poly(x, max(1, round(len(x) / factor)), len(x))


@transform("temporal.wsola", "B", rate=1.2, frame_ms=40, search_ms=10)
def wsola(x, sr, rng, rate, frame_ms, search_ms):
    """Stretched by frames placed where they resemble what came before."""
    need(rate > 0 and frame_ms > 0 and search_ms >= 0, "positive rate and frames")
    size, n = max(8, int(frame_ms * sr / 1000)), max(1, round(len(x) / rate))
    hop, reach = size // 2, int(search_ms * sr / 1000)
    if len(x) < 4 * hop:
        return stretch_to(x, n)
    w, out, norm = np.hanning(size), np.zeros(n + 2 * size), np.zeros(n + 2 * size)
    before, padded = x[:size], np.pad(x, (0, 2 * size))
    for at in range(0, n, hop):
        centre = int(at * rate)
        places = np.arange(max(0, centre - reach), min(len(x) - 1, centre + reach) + 1)
        places = places[:: max(1, len(places) // 64)]
        frames = padded[places[:, None] + np.arange(size)]
        score = frames @ before / (np.linalg.norm(frames, axis=1) + 1e-12)
        best = int(places[np.argmax(score)])
        out[at : at + size] += padded[best : best + size] * w
        norm[at : at + size] += w
        before = padded[best + hop : best + hop + size]
    return (out / np.where(norm > 1e-8, norm, 1.0))[:n]


@transform("temporal.psola", "B", n_steps=2.0, fmin=60.0, fmax=400.0)
def psola(x, sr, rng, n_steps, fmin, fmax):
    """Pitch moved by resampled grains at pitch marks; without a pitch, by the phase vocoder."""
    need(0 < fmin < fmax, "an increasing pair of pitches")
    period = pitch_period(x, sr, fmin, fmax)
    if period is None or len(x) < 4 * period:
        return shifted(x, n_steps)
    rate, out, norm, w = 2 ** (n_steps / 12), np.zeros(len(x)), np.zeros(len(x)), np.hanning(2 * period)
    for mark in range(period, len(x) - period, period):
        grain = x[mark - period : mark + period]
        grain = np.interp(np.clip((np.arange(2 * period) - period) * rate + period, 0, 2 * period - 1), np.arange(2 * period), grain)
        out[mark - period : mark + period] += grain * w
        norm[mark - period : mark + period] += w
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-3), x)


def _pieces(x, n):
    return [p for p in np.array_split(x, max(1, min(n, len(x)))) if len(p)]


@transform("temporal.prosody", "B", semitone_range=1.5, n_segments=6)
def prosody(x, sr, rng, semitone_range, n_segments):
    """Segments each moved by some semitones, cross-faded."""
    need(semitone_range >= 0 and n_segments >= 1, "a range from 0 and a segment at least")
    fade, out, at = max(1, int(0.01 * sr)), np.zeros(len(x)), 0
    for p in _pieces(x, n_segments):
        y = shifted(p, rng.uniform(-semitone_range, semitone_range), min(512, max(16, len(p) // 4 * 2)))
        m = min(fade, at, len(y))
        ramp = np.sin(np.linspace(0, np.pi / 2, m)) if m else np.zeros(0)
        out[at : at + len(p)] = y
        if m:
            out[at : at + m] = y[:m] * ramp + out[at - m : at] * np.cos(np.linspace(0, np.pi / 2, m))
        at += len(p)
    return out


@transform("temporal.rhythm", "B", rate_sigma=0.12, n_segments=8, max_rate_deviation=0.3)
def rhythm(x, sr, rng, rate_sigma, n_segments, max_rate_deviation):
    """Segments each stretched by chance, the whole fitted to its length."""
    need(rate_sigma >= 0 and 0 <= max_rate_deviation < 1, "a deviation below 1")
    rates = [1 + float(np.clip(rng.normal(0, rate_sigma), -max_rate_deviation, max_rate_deviation)) for _ in range(n_segments)]
    return stretch_to(np.concatenate([stretch_to(p, max(1, round(len(p) / r))) for p, r in zip(_pieces(x, n_segments), rates)]), len(x))


@transform("temporal.pause_insertion", "B", n_pauses=3, pause_ms=120.0, min_gap_ms=400.0)
def pause_insertion(x, sr, rng, n_pauses, pause_ms, min_gap_ms):
    """Silence put in at the quietest places that lie apart."""
    need(n_pauses >= 0 and pause_ms >= 0, "counts and lengths from 0")
    size = max(1, int(0.02 * sr))
    energy = smooth(np.array([np.mean(x[i : i + size] ** 2) for i in range(0, len(x), size)]), 5)
    low = [i for i in range(1, len(energy) - 1) if energy[i] <= energy[i - 1] and energy[i] <= energy[i + 1]]
    chosen: list[int] = []
    for i in sorted(low, key=lambda i: energy[i]):
        if len(chosen) < n_pauses and all(abs(i - j) * size >= min_gap_ms * sr / 1000 for j in chosen):
            chosen.append(i)
    return np.insert(x, np.repeat([i * size for i in chosen], int(pause_ms * sr / 1000)).astype(int), 0.0) if chosen else x.copy()


@transform("temporal.segment_displacement", "B", segment_ms=200.0, max_shift_ms=60.0, n_moves=3)
def segment_displacement(x, sr, rng, segment_ms, max_shift_ms, n_moves):
    """Blocks copied to a place nearby, over what is there."""
    need(segment_ms > 0 and max_shift_ms >= 0 and n_moves >= 0, "positive lengths")
    y, n, most = x.copy(), min(len(x), max(1, int(segment_ms * sr / 1000))), int(max_shift_ms * sr / 1000)
    for _ in range(n_moves):
        at = int(rng.integers(0, len(x) - n + 1))
        to = int(np.clip(at + rng.integers(-most, most + 1), 0, len(x) - n))
        y[to : to + n] = y[at : at + n].copy()
    return y


@transform("temporal.micro_timing", "B", max_shift_ms=8.0, n_control_points=12)
def micro_timing(x, sr, rng, max_shift_ms, n_control_points):
    """Small displacements between anchored ends."""
    need(max_shift_ms >= 0 and n_control_points >= 2, "a shift from 0 and two points at least")
    moves = rng.uniform(-1, 1, n_control_points) * max_shift_ms * sr / 1000
    moves[[0, -1]] = 0
    at = np.arange(len(x)) + np.interp(np.arange(len(x)), np.linspace(0, len(x) - 1, n_control_points), moves)
    return np.interp(np.clip(at, 0, len(x) - 1), np.arange(len(x)), x)
