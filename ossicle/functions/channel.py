"""Family H (channel and devices), and the preprocessing defences."""

from __future__ import annotations

import numpy as np

from .kernels import butter, filtfilt, fit, istft, overlapped, resample_poly, stft
from .registry import need, transform
from .simple import at_snr, band, mu_law, nyquist, reverberated, rms
from .spectral import frequencies, polar, through


def simulated_codec(x, sr, bitrate_kbps):
    bits = max(1.0, bitrate_kbps * 1000 / sr)

    def change(z):
        mag = np.abs(z)
        step = np.maximum(mag.max(1, keepdims=True), 1e-12) * 2.0**-bits
        return polar(np.round(mag / step) * step, np.angle(z))

    return overlapped(x, change, 1024, 512)


for _name, _rate in (("mp3", 32), ("opus", 16), ("aac", 32), ("codec_simulation", 32)):

    def _codec(x, sr, rng, bitrate_kbps):
        """Magnitudes rounded as a bit rate allows (there are no codecs here)."""
        need(bitrate_kbps > 0, "the rate must be positive")
        return simulated_codec(x, sr, bitrate_kbps)

    transform(f"channel.{_name}", "H", bitrate_kbps=_rate)(_codec)


@transform("channel.telephone_codec", "H")
def telephone_codec(x, sr, rng):
    """Band-pass, 8 kHz and mu-law."""
    y = filtfilt(*butter(4, band(300, 3400, sr), "band"), x)
    low = resample_poly(y / max(np.abs(y).max(), 1e-12), 8000, sr)
    return fit(resample_poly(mu_law(low, 255, 254), sr, 8000), len(x)) * np.abs(y).max()


@transform("channel.packet_loss", "H", loss_rate=0.05, packet_ms=20.0)
def packet_loss(x, sr, rng, loss_rate, packet_ms):
    """Lost packets filled by the fading one before and noise."""
    need(0 <= loss_rate <= 1 and packet_ms > 0, "a chance and a positive length")
    n, y, gone = max(1, int(packet_ms * sr / 1000)), x.copy(), 0
    for at in range(0, len(x), n):
        lost = rng.random() < loss_rate
        gone = gone + 1 if lost else 0
        if lost:
            m = min(n, len(x) - at)
            before = y[at - n : at][:m] if at >= n else np.zeros(m)
            y[at : at + m] = before * 0.7**gone + rng.standard_normal(m) * 0.01 * rms(before)
    return y


@transform("channel.packet_jitter", "H", jitter_ms=30.0, packet_ms=20.0)
def packet_jitter(x, sr, rng, jitter_ms, packet_ms):
    """Packets at later slots; the last writer of a slot wins, gaps are silent."""
    need(jitter_ms >= 0 and packet_ms > 0, "positive lengths")
    n, y = max(1, int(packet_ms * sr / 1000)), np.zeros(len(x))
    for i, at in enumerate(range(0, len(x), n)):
        to = (i + int(rng.integers(0, int(jitter_ms / packet_ms) + 2))) * n
        m = min(n, len(x) - at, max(0, len(x) - to))
        if m > 0:
            y[to : to + m] = x[at : at + m]
    return y


@transform("channel.resampling_chain", "H", intermediate_sr=48000)
def resampling_chain(x, sr, rng, intermediate_sr):
    """To another rate and back."""
    need(intermediate_sr > 0, "the rate must be positive")
    return fit(resample_poly(resample_poly(x, intermediate_sr, sr), sr, intermediate_sr), len(x))


@transform("channel.recording_replay", "H", rt60_s=0.4, snr_db=25.0)
def recording_replay(x, sr, rng, rt60_s, snr_db):
    """Played in a room and recorded again."""
    y = filtfilt(*butter(2, nyquist(200, sr), "high"), x)
    y = 0.65 * y + 0.35 * (reverberated(y, sr, rng, rt60_s, 0.0, 16) - y)
    y = at_snr(y, filtfilt(*butter(2, band(300, 3400, sr), "band"), rng.standard_normal(len(x))), snr_db)
    return y * np.clip(rms(x) / max(rms(y), 1e-12), 0.5, 2.0)


@transform("channel.aec_artifacts", "H", misalign_ms=6.0, subtraction_gain=0.6)
def aec_artifacts(x, sr, rng, misalign_ms, subtraction_gain):
    """A misaligned echo taken away."""
    need(misalign_ms >= 0, "the delay must not be negative")
    d, y = int(misalign_ms * sr / 1000), x.copy()
    if d < len(x):
        y[d:] -= subtraction_gain * x[: len(x) - d]
    return y


def _shelf(f, corner, gain_db, low):
    share = 1 / (1 + (np.maximum(f, 1e-6) / corner) ** (2 if low else -2))
    return gain_db * share


def _bump(f, centre, gain_db):
    return gain_db * np.exp(-0.5 * (np.log2(np.maximum(f, 1e-6) / centre) / 0.5) ** 2)


@transform("channel.playback_eq", "H", bass_db=-6.0, treble_db=-4.0, presence_db=2.0)
def playback_eq(x, sr, rng, bass_db, treble_db, presence_db):
    """Shelves for bass and treble and a bump between."""
    f = frequencies(x, sr)
    return through(x, lambda z: z * 10 ** ((_shelf(f, 250, bass_db, True) + _shelf(f, 4000, treble_db, False) + _bump(f, 2500, presence_db)) / 20))


@transform("channel.microphone", "H", low_hz=100.0, high_hz=7000.0, resonance_db=3.0)
def microphone(x, sr, rng, low_hz, high_hz, resonance_db):
    """Band-pass and a resonance added."""
    y = filtfilt(*butter(2, band(low_hz, high_hz, sr), "band"), x)
    f = frequencies(x, sr)
    return y + through(y, lambda z: z * (10 ** (_bump(f, 3000, resonance_db) / 20) - 1))


@transform("channel.speaker", "H", low_hz=150.0, rolloff_db_per_oct=12.0, resonance_db=4.0, resonance_hz=180.0)
def speaker(x, sr, rng, low_hz, rolloff_db_per_oct, resonance_db, resonance_hz):
    """High-pass and a bass shelf."""
    y = filtfilt(*butter(max(1, round(rolloff_db_per_oct / 6)), nyquist(low_hz, sr), "high"), x)
    f = frequencies(x, sr)
    return through(y, lambda z: z * 10 ** (_shelf(f, 250, resonance_db, True) / 20))


@transform("channel.agc", "H", target_db=-20.0, max_gain_db=18.0, attack_s=0.01, release_s=0.2)
def agc(x, sr, rng, target_db, max_gain_db, attack_s, release_s):
    """Each frame towards a target level, at the pace of attack and release."""
    need(attack_s > 0 and release_s > 0, "positive times")
    n, y, gain = max(1, int(0.01 * sr)), x.copy(), 0.0
    for at in range(0, len(x), n):
        level = 20 * np.log10(rms(x[at : at + n]) + 1e-12)
        wish = float(np.clip(target_db - level, -max_gain_db, max_gain_db))
        gain += (wish - gain) * (1 - np.exp(-0.01 / (attack_s if wish < gain else release_s)))
        y[at : at + n] *= 10 ** (gain / 20)
    return y


@transform("channel.noise_suppression", "H", over_sub=1.5, spectral_floor=0.05, noise_percentile=10.0)
def noise_suppression(x, sr, rng, over_sub, spectral_floor, noise_percentile):
    """The spectrum of the quietest frames taken away."""
    need(0 <= spectral_floor <= 1 and 0 < noise_percentile <= 100, "a floor to 1 and a percentage")

    def change(z):
        mag = np.abs(z)
        energy = (mag**2).sum(1)
        noise = np.median(mag[energy <= np.percentile(energy, noise_percentile)], axis=0)
        return polar(np.maximum(mag - over_sub * noise, spectral_floor * mag), np.angle(z))

    return overlapped(x, change, 512, 256)


@transform("channel.dereverberation", "H", suppression_db=-8.0, tail_ms=60.0)
def dereverberation(x, sr, rng, suppression_db, tail_ms):
    """Frames that resemble the mean of those before made fainter."""

    def change(z):
        mag, k = np.abs(z), max(1, int(tail_ms * sr / 1000 / 256))
        total = np.cumsum(np.pad(mag, ((1, 0), (0, 0))), axis=0)
        first = np.maximum(np.arange(len(mag)) - k, 0)
        mean = (total[1:] - total[first]) / (np.arange(len(mag)) + 1 - first)[:, None]
        return z * 10 ** (suppression_db * np.clip(1 - mean / np.maximum(mag, 1e-12), 0, 1) / 20)

    return overlapped(x, change, 512, 256)


@transform("channel.device_distortion", "H", drive=1.5, asymmetry=0.1, bits=8.0)
def device_distortion(x, sr, rng, drive, asymmetry, bits):
    """A driven tanh with an even harmonic, quantised."""
    need(drive > 0 and bits >= 1, "a positive drive and a bit at least")
    y = np.tanh(drive * x)
    y = y + asymmetry * y * y
    y = y - y.mean()
    peak, steps = np.abs(y).max(), 2.0 ** (bits - 1) - 1
    return np.round(y / peak * steps) / steps * peak if peak > 0 and steps > 0 else y


@transform("channel.room_reverb", "H", rt60_s=0.6, wet_db=-6.0)
def room_reverb(x, sr, rng, rt60_s, wet_db):
    """A synthetic room."""
    need(rt60_s > 0, "the decay must be positive")
    return reverberated(x, sr, rng, rt60_s, wet_db, 16)


def spectral_denoise(x: np.ndarray) -> np.ndarray:
    z = stft(x)
    mag = np.abs(z)
    energy = (mag**2).sum(0)
    quiet = np.argsort(energy, kind="stable")[: max(1, int(0.1 * len(energy)))]
    noise = mag[:, quiet].mean(1, keepdims=True)
    return istft(polar(np.maximum(mag - 1.5 * noise, 0.05 * mag), np.angle(z)), len(x))


DEFENSES = {
    "defense.raw": lambda x, sr: x.copy(),
    "defense.loudness_norm": lambda x, sr: x * 0.1 / rms(x) if rms(x) > 1e-8 else x.copy(),
    "defense.resampling": lambda x, sr: x.copy() if sr == 8000 else fit(resample_poly(resample_poly(x, 8000, sr), sr, 8000), len(x)),
    "defense.spectral_denoise": lambda x, sr: spectral_denoise(x),
    "defense.codec_sim": lambda x, sr: mu_law(x, 255, 127),
    "defense.replay_sim": lambda x, sr: x + 0.4 * np.concatenate((np.zeros(min(len(x), int(0.03 * sr))), x[: max(0, len(x) - int(0.03 * sr))])),
}
