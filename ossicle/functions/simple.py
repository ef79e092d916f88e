"""Families A (baseline), C (multirate) and E (noise and interference)."""

from __future__ import annotations

import numpy as np

from .kernels import butter, filtfilt, filtfilt_each, fit, lfilter, resample_poly, stretch_to
from .registry import need, transform


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x))) if len(x) else 0.0


def mu_law(x: np.ndarray, mu: float, levels: int) -> np.ndarray:
    peak = np.abs(x).max()
    if peak == 0:
        return x.copy()
    y = np.sign(x) * np.log1p(mu * np.abs(x) / peak) / np.log1p(mu)
    y = np.round(y * levels) / levels
    return np.sign(y) * np.expm1(np.abs(y) * np.log1p(mu)) / mu * peak


def at_snr(x: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """x with noise scaled to a signal-to-noise ratio by RMS; for a silent x, noise of RMS 0.01."""
    own, other = rms(x), rms(noise)
    if other < 1e-15:
        return x.copy()
    level = own / 10 ** (snr_db / 20) if own > 1e-12 else 0.01
    return x + noise * (level / other)


def coloured(rng: np.random.Generator, n: int, shape) -> np.ndarray:
    """White noise with its spectrum multiplied by shape(normalised frequency)."""
    f = np.fft.rfftfreq(n)
    return np.fft.irfft(np.fft.rfft(rng.standard_normal(n)) * shape(f), n)


def nyquist(hz: float, sr: int) -> float:
    return min(max(hz / (sr / 2), 1e-4), 0.999)


def band(low: float, high: float, sr: int) -> list[float]:
    a, b = nyquist(low, sr), nyquist(high, sr)
    return [a, b] if a < b else [b / 2, b]


@transform("baseline.identity", "A")
def identity(x, sr, rng):
    """The signal itself."""
    return x.copy()


@transform("baseline.gain", "A", gain_db=6.0)
def gain(x, sr, rng, gain_db):
    """All samples times 10 ** (gain / 20)."""
    need(np.isfinite(gain_db), "the gain must be finite")
    return x * 10 ** (gain_db / 20)


@transform("baseline.peak_normalize", "A", target_db=-3.0)
def peak_normalize(x, sr, rng, target_db):
    """Scaled to a peak level; silence stays."""
    need(target_db <= 0, "the peak must not exceed 0 dB")
    peak = np.abs(x).max()
    return x * (10 ** (target_db / 20) / peak) if peak > 0 else x.copy()


@transform("baseline.rms_normalize", "A", target_rms=0.1)
def rms_normalize(x, sr, rng, target_rms):
    """Scaled to an RMS; silence stays."""
    need(target_rms > 0, "the RMS must be positive")
    return x * (target_rms / rms(x)) if rms(x) > 0 else x.copy()


@transform("baseline.loudness_normalize", "A", target_lufs=-23.0)
def loudness_normalize(x, sr, rng, target_lufs):
    """Scaled so that the RMS level reaches a target."""
    return x * 10 ** ((target_lufs - 20 * np.log10(rms(x) + 1e-12)) / 20) if rms(x) > 0 else x.copy()


@transform("baseline.compressor", "A", threshold_db=-20.0, ratio=4.0, attack_ms=5.0, release_ms=50.0, makeup_gain_db=0.0)
def compressor(x, sr, rng, threshold_db, ratio, attack_ms, release_ms, makeup_gain_db):
    """Gain reduction above a threshold, smoothed by attack and release."""
    need(ratio >= 1 and attack_ms > 0 and release_ms > 0, "ratio from 1 and positive times are needed")
    over = np.maximum(20 * np.log10(np.abs(x) + 1e-12) - threshold_db, 0) * (1 / ratio - 1)
    fast, slow = (float(np.exp(-1000 / (ms * sr))) for ms in (attack_ms, release_ms))
    state, out = 0.0, np.empty(len(x))
    for i, v in enumerate(over.tolist()):
        c = fast if v < state else slow
        state = c * state + (1 - c) * v
        out[i] = state
    return x * 10 ** ((out + makeup_gain_db) / 20)


@transform("baseline.limiter", "A", threshold_db=-1.0)
def limiter(x, sr, rng, threshold_db):
    """Clipped at a level."""
    need(threshold_db <= 0, "the limit must not exceed 0 dB")
    top = 10 ** (threshold_db / 20)
    return np.clip(x, -top, top)


@transform("baseline.silence_padding", "A", pad_ms=500.0, location="both")
def silence_padding(x, sr, rng, pad_ms, location):
    """Zeros at the start, the end or both."""
    need(pad_ms >= 0 and location in ("start", "end", "both"), "a length from 0 and a place are needed")
    n = int(pad_ms * sr / 1000)
    return np.pad(x, (n * (location != "end"), n * (location != "start")))


@transform("baseline.sample_rate_converter", "A", target_sr=8000)
def sample_rate_converter(x, sr, rng, target_sr):
    """To another rate and back."""
    need(target_sr > 0, "the rate must be positive")
    return x.copy() if target_sr == sr else fit(resample_poly(resample_poly(x, target_sr, sr), sr, target_sr), len(x))


@transform("baseline.bit_depth_converter", "A", bits=8)
def bit_depth_converter(x, sr, rng, bits):
    """Rounded to the steps of so many bits of the peak."""
    need(1 <= bits <= 32, "1 to 32 bits")
    peak = np.abs(x).max()
    steps = max(2.0**bits / 2 - 1, 1.0)
    return np.round(x / peak * steps) / steps * peak if peak > 0 else x.copy()


@transform("baseline.mu_law_companding", "A", mu=255)
def mu_law_companding(x, sr, rng, mu):
    """Mu-law to 127 levels and back."""
    need(mu > 0, "mu must be positive")
    return mu_law(x, mu, 127)


def _decimated(x: np.ndarray, d: int) -> np.ndarray:
    return np.interp(np.arange(len(x)) / d, np.arange(len(x[::d])), x[::d])


@transform("multirate.integer", "C", down_factor=2, anti_alias=True)
def integer(x, sr, rng, down_factor, anti_alias):
    """Every d-th sample after a zero-phase low-pass, interpolated back."""
    need(down_factor >= 1, "the factor is a whole number from 1")
    return _decimated(filtfilt(*butter(4, 0.999 / down_factor), x) if anti_alias and down_factor > 1 else x, down_factor)


@transform("multirate.rational", "C", up_factor=3, down_factor=2)
def rational(x, sr, rng, up_factor, down_factor):
    """Polyphase by a fraction and back."""
    need(up_factor >= 1 and down_factor >= 1, "the factors are whole numbers from 1")
    return fit(resample_poly(resample_poly(x, up_factor, down_factor), down_factor, up_factor), len(x))


@transform("multirate.non_integer", "C", target_sr=11025)
def non_integer(x, sr, rng, target_sr):
    """Polyphase to a rate and back."""
    need(target_sr > 0, "the rate must be positive")
    return fit(resample_poly(resample_poly(x, target_sr, sr), sr, target_sr), len(x))


@transform("multirate.time_varying", "C", rate_start=1.0, rate_end=1.1)
def time_varying(x, sr, rng, rate_start, rate_end):
    """Read at a rate that changes from start to end."""
    need(rate_start > 0 and rate_end > 0, "rates must be positive")
    at = np.cumsum(np.linspace(rate_start, rate_end, len(x)))
    at = (at - at[0]) / max(at[-1] - at[0], 1e-12) * (len(x) - 1)
    return np.interp(at, np.arange(len(x)), x)


@transform("multirate.drift", "C", drift_ppm=500.0)
def drift(x, sr, rng, drift_ppm):
    """The clock off by parts in a million, to the nearest thousandth."""
    return fit(resample_poly(x, 1000, max(1, round(1000 / (1 + drift_ppm / 1e6)))), len(x))


@transform("multirate.bandwidth", "C", cutoff_hz=7000.0, rolloff_db_per_oct=24.0)
def bandwidth(x, sr, rng, cutoff_hz, rolloff_db_per_oct):
    """Zero-phase low-pass of an order that the roll-off asks for."""
    need(cutoff_hz > 0, "the cut-off must be positive")
    return x.copy() if cutoff_hz >= sr / 2 else filtfilt(*butter(max(2, round(rolloff_db_per_oct / 6)), cutoff_hz / (sr / 2)), x)


@transform("multirate.antialias_variation", "C", down_factor=2, alias_filter_order=2)
def antialias_variation(x, sr, rng, down_factor, alias_filter_order):
    """Decimated after a causal filter of low order (0: none)."""
    need(down_factor >= 1 and alias_filter_order >= 0, "a factor from 1 and an order from 0")
    y = lfilter(*butter(alias_filter_order, 0.999 / down_factor), x) if alias_filter_order and down_factor > 1 else x
    return _decimated(y, down_factor)


@transform("multirate.aliasing", "C", down_factor=3)
def aliasing(x, sr, rng, down_factor):
    """Every d-th sample without a filter, interpolated back."""
    need(down_factor >= 1, "the factor is a whole number from 1")
    return _decimated(x, down_factor)


@transform("multirate.narrowband", "C", low_hz=300.0, high_hz=3400.0)
def narrowband(x, sr, rng, low_hz, high_hz):
    """Zero-phase band-pass, then a round trip at 8 kHz."""
    d = max(1, sr // 8000)
    return fit(resample_poly(resample_poly(filtfilt(*butter(4, band(low_hz, high_hz, sr), "band"), x), 1, d), d, 1), len(x))


@transform("multirate.wideband_to_narrowband", "C", narrow_sr=8000, cutoff_hz=3400.0)
def wideband_to_narrowband(x, sr, rng, narrow_sr, cutoff_hz):
    """Zero-phase low-pass, then a round trip at a narrow rate."""
    d = max(1, round(sr / narrow_sr))
    return fit(resample_poly(resample_poly(filtfilt(*butter(4, nyquist(cutoff_hz, sr)), x), 1, d), d, 1), len(x))


@transform("multirate.codec_artifacts", "C", block_size_ms=1.5, quantization_bits=4.0)
def codec_artifacts(x, sr, rng, block_size_ms, quantization_bits):
    """Magnitudes of short blocks rounded to shares of the block's peak, phases kept."""
    from .kernels import overlapped

    size = max(64, 1 << int(np.ceil(np.log2(max(2, block_size_ms * sr / 1000)))))

    def change(z):
        mag = np.abs(z)
        step = mag.max(1, keepdims=True) * 2.0**-quantization_bits
        return np.round(mag / np.maximum(step, 1e-12)) * step * np.exp(1j * np.angle(z))

    return overlapped(x, change, size, size // 2)


def _noise(key: str, make, **more):
    def run(x, sr, rng, snr_db, **p):
        return at_snr(x, make(rng, len(x), sr, **p), snr_db)

    run.__doc__ = f"{key.split('.')[1].replace('_', ' ')} noise at a signal-to-noise ratio."
    transform(key, "E", **({"snr_db": 20.0} | more))(run)


def _floor(f):
    return np.maximum(f, 1 / max(2 * len(f), 1))


def _speech_shape(f, sr):
    hz = np.maximum(f * sr, 1.0)
    return np.where(hz < 1000, hz / 1000, np.where(hz > 4000, (4000 / hz) ** 2, 1.0))


def _brown(rng, n, sr):
    y = np.cumsum(rng.standard_normal(n))
    return y - y.mean()


def _competing(rng, n, sr, n_speakers):
    y = np.zeros(n)
    for _ in range(n_speakers):
        size = min(n, int(rng.uniform(0.5, 2.0) * sr))
        at = int(rng.integers(0, n - size + 1))
        y[at : at + size] += rng.standard_normal(size) * np.sin(2 * np.pi * rng.uniform(100, 250) * np.arange(size) / sr)
    return y


def _chirp(rng, n, sr, start_hz, end_hz, duration_sec):
    t, length = np.arange(n) / sr, duration_sec or n / sr
    return np.sin(2 * np.pi * (start_hz * t + (end_hz - start_hz) / (2 * max(length, 1e-9)) * t * t))


def _babble(rng, n, sr, n_talkers):
    if not n_talkers:
        return np.zeros(n)
    t, filters, draws = np.arange(n) / sr, [], []
    for _ in range(n_talkers):
        filters.append(butter(2, band(rng.uniform(80, 200), rng.uniform(2500, 5000), sr), "band", once=True))
        draws.append((rng.standard_normal(n), rng.uniform(0, 0.5), rng.uniform(3, 7), rng.uniform(0, 2 * np.pi)))
    white, back, rate, phase = (np.array(v) for v in zip(*draws))
    voices = filtfilt_each(filters, white)
    voices[:, 1:] -= back[:, None] * voices[:, :-1]
    return (voices * (1 + np.sin(2 * np.pi * rate[:, None] * t + phase[:, None])) / 2).sum(0)


def _harmonics(rng, n, sr, f0_hz, n_harmonics):
    t, y = np.arange(n) / sr, np.zeros(n)
    for h in range(1, n_harmonics + 1):
        if h * f0_hz < sr / 2:
            y += np.sin(2 * np.pi * h * f0_hz * t + rng.uniform(0, 2 * np.pi)) / h
    return y


def _nonstationary(rng, n, sr, segment_s):
    size, y = max(16, int(segment_s * sr)), np.zeros(n)
    for i, at in enumerate(range(0, n, size)):
        m = min(size, n - at)
        part = [lambda: rng.standard_normal(m), lambda: coloured(rng, m, lambda f: _floor(f) ** -0.5), lambda: _brown(rng, m, sr)][i % 3]()
        fade = np.minimum(1.0, np.minimum(np.arange(m), np.arange(m)[::-1]) / max(1, m // 20))
        y[at : at + m] = part / max(rms(part), 1e-12) * fade
    return y * (1 + 0.5 * np.sin(2 * np.pi * 0.7 * np.arange(n) / sr + rng.uniform(0, 2 * np.pi)))


_noise("noise.white", lambda rng, n, sr: rng.standard_normal(n))
_noise("noise.pink", lambda rng, n, sr: coloured(rng, n, lambda f: _floor(f) ** -0.5))
_noise("noise.brown", _brown)
_noise("noise.violet", lambda rng, n, sr: coloured(rng, n, lambda f: f))
_noise("noise.band_limited", lambda rng, n, sr, low_hz, high_hz: lfilter(*butter(4, band(low_hz, high_hz, sr), "band"), rng.standard_normal(n)), low_hz=300.0, high_hz=3400.0)
_noise("noise.speech_shaped", lambda rng, n, sr: coloured(rng, n, lambda f: _speech_shape(f, sr)))
_noise("noise.tonal", lambda rng, n, sr, frequency_hz: np.sin(2 * np.pi * frequency_hz * np.arange(n) / sr + rng.uniform(0, 2 * np.pi)), frequency_hz=1000.0)
_noise("noise.chirp", _chirp, start_hz=200.0, end_hz=3400.0, duration_sec=None)
_noise("noise.modulated", lambda rng, n, sr, modulation_freq_hz, modulation_index: rng.standard_normal(n) * (1 + modulation_index * np.sin(2 * np.pi * modulation_freq_hz * np.arange(n) / sr)), modulation_freq_hz=5.0, modulation_index=0.5)
_noise("noise.competing_speaker", _competing, n_speakers=2)
_noise("noise.babble", _babble, snr_db=10.0, n_talkers=10)
_noise("noise.harmonic_interference", _harmonics, snr_db=15.0, f0_hz=120.0, n_harmonics=12)
_noise("noise.nonstationary", _nonstationary, snr_db=10.0, segment_s=0.5)


@transform("noise.impulsive", "E", rate=0.001, amplitude=0.5)
def impulsive(x, sr, rng, rate, amplitude):
    """Each sample plus or minus an amplitude with some chance."""
    need(0 <= rate <= 1, "the rate is a chance")
    return x + np.where(rng.random(len(x)) < rate, amplitude * rng.choice([-1.0, 1.0], len(x)), 0.0)


@transform("noise.clicks", "E", click_rate=0.01, click_amplitude=0.5)
def clicks(x, sr, rng, click_rate, click_amplitude):
    """Short bursts of uniform noise at distinct places."""
    need(0 <= click_rate <= 1, "the rate is a share")
    y = x.copy()
    for at in rng.choice(len(x), int(len(x) * click_rate), replace=False):
        m = min(100, len(x) - at)
        y[at : at + m] += rng.uniform(-click_amplitude, click_amplitude, m)
    return y


@transform("noise.transient_masking", "E", level_db=6.0, n_transients=5, burst_ms=25.0)
def transient_masking(x, sr, rng, level_db, n_transients, burst_ms):
    """Decaying bursts at the strongest onsets."""
    size = max(1, int(0.01 * sr))
    energy = np.array([np.sum(x[i : i + size] ** 2) for i in range(0, len(x), size)])
    onsets = np.argsort(-np.diff(energy, prepend=0.0), kind="stable")[:n_transients]
    y, m = x.copy(), max(1, int(burst_ms * sr / 1000))
    for o in onsets:
        burst = rng.standard_normal(m) * np.exp(-5 * np.arange(m) / m) * rms(x) * 10 ** (level_db / 20)
        part = y[o * size : o * size + m]
        part += burst[: len(part)]
    return y


@transform("noise.delay_add", "E", n_taps=3, max_delay_ms=40.0, tap_gain=0.4)
def delay_add(x, sr, rng, n_taps, max_delay_ms, tap_gain):
    """Delayed copies, each fainter."""
    y = x.copy()
    for k in range(n_taps):
        d = int(rng.integers(1, max(2, int(max_delay_ms * sr / 1000) + 1)))
        if d < len(x):
            y[d:] += tap_gain * 0.6**k * x[:-d]
    return y


def room_response(rng, sr, rt60_s, n_taps, n):
    """A direct path, image taps and a band-limited decaying tail; peak one."""
    size = max(2, min(int(rt60_s * sr), 4 * n))
    h = np.zeros(size)
    h[0] = 1.0
    for _ in range(n_taps):
        d = int(rng.integers(1, max(2, min(size, int(0.08 * sr) + 2))))
        if d < size:
            h[d] += rng.choice([-1.0, 1.0]) * 0.7 * np.exp(-6.9 * d / size)
    tail = rng.standard_normal(size) * np.exp(-6.9 * np.arange(size) / size)
    if size > 32:
        tail = filtfilt(*butter(2, band(200.0, 6000.0, sr), "band"), tail)
    h += 0.2 * tail / max(np.abs(tail).max(), 1e-12)
    return h / np.abs(h).max()


def reverberated(x, sr, rng, rt60_s, wet_db, n_taps):
    h = room_response(rng, sr, rt60_s, n_taps, len(x))
    m = len(x) + len(h) - 1
    m = 1 << (m - 1).bit_length()
    wet = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(h, m), m)[: len(x)]
    return x + 10 ** (wet_db / 20) * wet * (rms(x) / max(rms(wet), 1e-12))


@transform("noise.rir", "E", rt60_s=0.6, wet_db=-6.0, n_taps=16)
def rir(x, sr, rng, rt60_s, wet_db, n_taps):
    """A synthetic room, as loud as asked next to the signal."""
    need(rt60_s > 0, "the decay must be positive")
    return reverberated(x, sr, rng, rt60_s, wet_db, n_taps)


@transform("noise.reverberation", "E", room_size=0.4, damping=0.5, wet_level=0.3, dry_level=0.7)
def reverberation(x, sr, rng, room_size, damping, wet_level, dry_level):
    """Four damped combs in parallel and two all-passes."""
    wet = np.zeros(len(x))
    for ms in (29.7, 37.1, 41.1, 43.7):
        d = max(1, int(ms * (0.5 + room_size) * sr / 1000))
        buffer, state, out = [0.0] * d, 0.0, []
        for i, v in enumerate(x.tolist()):
            y = buffer[i % d]
            state = y * (1 - damping) + state * damping
            buffer[i % d] = v + state * 0.84
            out.append(y)
        wet += np.array(out) / 4
    for ms in (5.0, 1.7):
        d = max(1, int(ms * sr / 1000))
        buffer, out = [0.0] * d, []
        for i, v in enumerate(wet.tolist()):
            b = buffer[i % d]
            buffer[i % d] = v + 0.5 * b
            out.append(b - 0.5 * buffer[i % d])
        wet = np.array(out)
    return dry_level * x + wet_level * wet


@transform("noise.echo", "E", delay_ms=200.0, gain=0.3)
def echo(x, sr, rng, delay_ms, gain):
    """The signal and a delayed copy."""
    need(delay_ms >= 0, "the delay must not be negative")
    d = int(delay_ms * sr / 1000)
    y = x.copy()
    if d < len(x):
        y[d:] += gain * x[: len(x) - d]
    return y


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    return stretch_to(x, n)
