"""Family D: filters and spectra."""

from __future__ import annotations

import numpy as np

from .kernels import butter, lfilter, notch, overlapped, smooth
from .psycho import BANDS, bark_to_hz, hz_to_bark
from .registry import need, transform
from .simple import band, nyquist, rms

SIZE, HOP = 1024, 512


def polar(mag: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return mag * np.exp(1j * phase)


def through(x, change):
    """One rfft of the whole signal, changed, and back."""
    return np.fft.irfft(change(np.fft.rfft(x)), len(x))


def frequencies(x, sr):
    return np.fft.rfftfreq(len(x), 1 / sr)


def framed(x, change, size=SIZE):
    return overlapped(x, change, size, size // 2, 0.1)


def filtered(kind: str):
    def run(x, sr, rng, order, **cuts):
        need(1 <= order <= 12 and all(c > 0 for c in cuts.values()), "positive cut-offs and an order to 12")
        if kind == "band":
            return lfilter(*butter(order, band(cuts["low_hz"], cuts["high_hz"], sr), "band"), x)
        if cuts["cutoff_hz"] >= sr / 2:
            return x.copy() if kind == "low" else np.zeros(len(x))
        return lfilter(*butter(order, nyquist(cuts["cutoff_hz"], sr), kind), x)

    run.__doc__ = f"Causal Butterworth {kind}-pass."
    return run


transform("spectral.bandpass", "D", low_hz=300.0, high_hz=3400.0, order=4)(filtered("band"))
transform("spectral.lowpass", "D", cutoff_hz=4000.0, order=4)(filtered("low"))
transform("spectral.highpass", "D", cutoff_hz=80.0, order=4)(filtered("high"))


@transform("spectral.tilt", "D", tilt_db_per_octave=6.0, pivot_hz=1000.0)
def tilt(x, sr, rng, tilt_db_per_octave, pivot_hz):
    """So many decibels an octave from a pivot."""
    need(pivot_hz > 0, "the pivot must be positive")
    f = np.maximum(frequencies(x, sr), 1e-10)
    return through(x, lambda z: z * 10 ** (tilt_db_per_octave * np.log2(f / pivot_hz) / 20))


@transform("spectral.smoothing", "D", smoothing_bins=10)
def smoothing(x, sr, rng, smoothing_bins):
    """Magnitudes smoothed by a Hann window, phases kept."""
    need(smoothing_bins >= 1, "one bin at least")
    w = np.hanning(smoothing_bins + 2)[1:-1]
    return through(x, lambda z: polar(np.convolve(np.abs(z), w / w.sum(), "same")[: len(z)] if len(z) >= len(w) else np.abs(z), np.angle(z)))


@transform("spectral.freq_dropout", "D", dropout_rate=0.1)
def freq_dropout(x, sr, rng, dropout_rate):
    """Bins set to zero by chance."""
    need(0 <= dropout_rate <= 1, "a chance")
    return through(x, lambda z: np.where(rng.random(len(z)) < dropout_rate, 0, z))


@transform("spectral.phase_randomization", "D", randomization_strength=1.0)
def phase_randomization(x, sr, rng, randomization_strength):
    """Phases moved towards random ones, magnitudes kept."""
    need(0 <= randomization_strength <= 1, "a strength to 1")

    def change(z):
        phase = np.angle(z)
        gap = np.angle(np.exp(1j * (rng.uniform(-np.pi, np.pi, len(z)) - phase)))
        return polar(np.abs(z), phase + randomization_strength * gap)

    return through(x, change)


@transform("spectral.comb_filter", "D", delay_ms=10.0, gain=0.5)
def comb_filter(x, sr, rng, delay_ms, gain):
    """Feedback comb."""
    need(abs(gain) < 1 and delay_ms > 0, "a gain below 1 and a positive delay")
    d, y = max(1, int(delay_ms * sr / 1000)), x.copy()
    for at in range(d, len(x), d):  # block by block: each needs only the one before
        part = y[at : at + d]
        part += gain * y[at - d : at - d + len(part)]
    return y


@transform("spectral.harmonic_attenuation", "D", fundamental_hz=100.0, num_harmonics=5, attenuation_db=10.0, bandwidth_hz=50.0)
def harmonic_attenuation(x, sr, rng, fundamental_hz, num_harmonics, attenuation_db, bandwidth_hz):
    """Notches at the multiples of a pitch, mixed with the signal."""
    need(fundamental_hz > 0 and bandwidth_hz > 0, "positive frequencies")
    y, g = x, 10 ** (-attenuation_db / 20)
    for h in range(1, num_harmonics + 1):
        f = h * fundamental_hz
        if f < sr / 2:
            y = lfilter(*notch(f / (sr / 2), f / bandwidth_hz), y) * (1 - g) + y * g
    return y


@transform("spectral.masking", "D", masker_level_db=20.0, bandwidth_bark=2.0, center_bark=6.0)
def masking(x, sr, rng, masker_level_db, bandwidth_bark, center_bark):
    """Tones of random phase in a Bark band."""
    n = 1 << int(np.ceil(np.log2(max(2, len(x)))))
    z, bark = np.fft.rfft(x, n), hz_to_bark(np.fft.rfftfreq(n, 1 / sr))
    inside = np.abs(bark - center_bark) <= bandwidth_bark / 2
    z[inside] += polar(np.full(inside.sum(), 10 ** (masker_level_db / 20)), rng.uniform(0, 2 * np.pi, inside.sum()))
    return np.fft.irfft(z, n)[: len(x)]


@transform("spectral.notch", "D", frequency_hz=1000.0, bandwidth_hz=100.0)
def single_notch(x, sr, rng, frequency_hz, bandwidth_hz):
    """One notch."""
    need(0 < frequency_hz < sr / 2 and bandwidth_hz > 0, "a frequency below the Nyquist rate")
    return lfilter(*notch(frequency_hz / (sr / 2), frequency_hz / bandwidth_hz), x)


@transform("spectral.warping", "D", alpha=0.0)
def warping(x, sr, rng, alpha):
    """The Bark axis stretched."""
    need(abs(alpha) < 1, "alpha lies within -1 and 1")
    if alpha == 0:
        return x.copy()
    bark = hz_to_bark(frequencies(x, sr))

    def change(z):
        at = np.clip(bark * (1 + alpha), bark[0], bark[-1])
        return polar(np.interp(at, bark, np.abs(z)), np.interp(at, bark, np.unwrap(np.angle(z))))

    return through(x, change)


def mel_edges(n: int, sr: int) -> np.ndarray:
    top = 2595 * np.log10(1 + sr / 2 / 700)
    return 700 * (10 ** (np.linspace(0, top, n + 2) / 2595) - 1)


@transform("spectral.mel_masking", "D", max_mask_bands=2, n_mels=80)
def mel_masking(x, sr, rng, max_mask_bands, n_mels):
    """Random mel bands set to zero."""
    need(0 <= max_mask_bands <= n_mels, "no more bands than there are")
    e, f = mel_edges(n_mels, sr), frequencies(x, sr)
    gone = np.zeros(len(f), bool)
    for b in rng.choice(n_mels, max_mask_bands, replace=False):
        gone |= (f >= e[b]) & (f <= e[b + 2])
    return through(x, lambda z: np.where(gone, 0, z))


@transform("spectral.bark_masking", "D", max_mask_bands=2)
def bark_masking(x, sr, rng, max_mask_bands):
    """Random Bark bands set to zero."""
    f = frequencies(x, sr)
    gone = np.zeros(len(f), bool)
    for b in rng.choice(BANDS, min(max_mask_bands, BANDS), replace=False):
        gone |= (f >= bark_to_hz(float(b))) & (f < bark_to_hz(float(b + 1)))
    return through(x, lambda z: np.where(gone, 0, z))


@transform("spectral.critical_band_attenuation", "D", band_indices=None, attenuation_db=20.0)
def critical_band_attenuation(x, sr, rng, band_indices, attenuation_db):
    """Bark bands (5, 10 and 15) made fainter."""
    bark = np.floor(hz_to_bark(frequencies(x, sr)))
    return through(x, lambda z: np.where(np.isin(bark, band_indices or [5, 10, 15]), z * 10 ** (-attenuation_db / 20), z))


@transform("spectral.formant_shift", "D", shift_ratio=1.1)
def formant_shift(x, sr, rng, shift_ratio):
    """Envelope read at other frequencies, mean magnitude kept."""
    need(shift_ratio > 0, "the ratio must be positive")

    def change(z):
        mag, k = np.abs(z), np.arange(z.shape[1])
        moved = np.stack([np.interp(k / shift_ratio, k, m) for m in mag])
        return polar(moved * mag.mean(1, keepdims=True) / np.maximum(moved.mean(1, keepdims=True), 1e-12), np.angle(z))

    return framed(x, change)


def peaks(mag: np.ndarray, freqs: np.ndarray, low: float, high: float, most: int) -> list[int]:
    mid = [i for i in range(1, len(mag) - 1) if low <= freqs[i] <= high and mag[i] > mag[i - 1] and mag[i] >= mag[i + 1] and mag[i] > mag.mean()]
    return sorted(mid, key=lambda i: -mag[i])[:most]


@transform("spectral.formant_suppression", "D", depth_db=-8.0, bandwidth_hz=300.0, max_formants=4)
def formant_suppression(x, sr, rng, depth_db, bandwidth_hz, max_formants):
    """The largest peaks of the smoothed spectrum cut."""
    freqs = np.fft.rfftfreq(SIZE, 1 / sr)

    def change(z):
        found = peaks(smooth(np.abs(z).mean(0), 61), freqs, 250, 5000, max_formants)
        cut = np.zeros(len(freqs))
        for i in found:
            cut = np.maximum(cut, np.clip(1 - np.abs(freqs - freqs[i]) / bandwidth_hz, 0, 1))
        return z * 10 ** (depth_db * cut / 20)

    return framed(x, change)


@transform("spectral.group_delay", "D", perturbation_scale=0.3, smooth_bins=16)
def group_delay(x, sr, rng, perturbation_scale, smooth_bins):
    """Smoothed phase noise, magnitudes kept."""

    def change(z):
        bend = smooth(rng.standard_normal(len(z)), smooth_bins)
        return z * np.exp(1j * bend / max(np.abs(bend).max(), 1e-12) * perturbation_scale * np.pi)

    return through(x, change)


@transform("spectral.minimum_phase", "D")
def minimum_phase(x, sr, rng):
    """The same magnitudes with minimum phase, RMS kept."""
    n = len(x)
    cepstrum = np.fft.ifft(np.log(np.maximum(np.abs(np.fft.fft(x)), 1e-10))).real
    fold = np.zeros(n)
    fold[0] = 1
    fold[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        fold[n // 2] = 1
    y = np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real
    return y * (rms(x) / max(rms(y), 1e-12))


def _banded(mag: np.ndarray, n: int) -> np.ndarray:
    edges = np.linspace(0, mag.shape[1], n + 1).astype(int)
    return np.concatenate([np.repeat(mag[:, a:b].mean(1, keepdims=True), b - a, axis=1) for a, b in zip(edges, edges[1:]) if b > a], axis=1)


@transform("spectral.contrast", "D", contrast_factor=1.5, n_bands=16)
def contrast(x, sr, rng, contrast_factor, n_bands):
    """Deviations from the mean of each band made larger."""
    need(contrast_factor >= 0 and n_bands >= 1, "a factor from 0 and a band at least")

    def change(z):
        mag = np.abs(z)
        mean = _banded(mag, n_bands)
        return polar(np.maximum(mean + (mag - mean) * contrast_factor, 0), np.angle(z))

    return framed(x, change)


@transform("spectral.random_eq", "D", max_gain_db=6.0, n_bands=8)
def random_eq(x, sr, rng, max_gain_db, n_bands):
    """Random gains at some bands, interpolated."""
    gains = rng.uniform(-max_gain_db, max_gain_db, n_bands)
    return framed(x, lambda z: z * 10 ** (np.interp(np.linspace(0, n_bands - 1, z.shape[1]), np.arange(n_bands), gains) / 20))


@transform("spectral.sharpening", "D", strength=0.5, smooth_bins=9)
def sharpening(x, sr, rng, strength, smooth_bins):
    """Magnitudes raised over their local mean, each frame's sum kept."""

    def change(z):
        mag = np.abs(z)
        local = np.stack([smooth(m, smooth_bins) for m in mag])
        new = mag * (mag / np.maximum(local, 1e-12)) ** strength
        return polar(new * mag.sum(1, keepdims=True) / np.maximum(new.sum(1, keepdims=True), 1e-12), np.angle(z))

    return framed(x, change)


@transform("spectral.hole", "D", center_hz=2000.0, width_hz=800.0, depth_db=-30.0)
def hole(x, sr, rng, center_hz, width_hz, depth_db):
    """A deep stop band; its shoulders start at unity beside it."""
    f = np.fft.rfftfreq(2 * SIZE, 1 / sr)
    d, deep = np.abs(f - center_hz), 10 ** (depth_db / 20)
    shoulder = (d > width_hz / 2) & (d <= width_hz)
    gain = np.where(d <= width_hz / 2, deep, 1.0)
    gain = np.where(shoulder, deep + (1 - deep) * 0.5 * (1 + np.cos(np.pi * (d - width_hz / 2) / (width_hz / 2))), gain)
    return framed(x, lambda z: z * gain, 2 * SIZE)


@transform("spectral.tf_masking", "D", n_masks=2, max_freq_mask=0.15, max_time_mask=0.15)
def tf_masking(x, sr, rng, n_masks, max_freq_mask, max_time_mask):
    """Random stripes of bins and of frames set to zero."""

    def change(z):
        z = z.copy()
        frames, bins = z.shape
        for _ in range(n_masks):
            b, t = int(rng.integers(0, max(1, int(max_freq_mask * bins)) + 1)), int(rng.integers(0, max(1, int(max_time_mask * frames)) + 1))
            i, j = int(rng.integers(0, bins - b + 1)), int(rng.integers(0, max(1, frames - t + 1)))
            z[:, i : i + b] = 0
            z[j : j + t] = 0
        return z

    return framed(x, change)
