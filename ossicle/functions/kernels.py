"""Signal kernels on numpy for what array expressions can't say: spectra, recursive filters, resampling, splines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def kept(size: int = 64):
    """A cache of arrays, which can't be written to, for what depends on sizes and parameters alone."""

    def wrap(f):
        def frozen(*args):
            out = f(*args)
            for a in out if isinstance(out, tuple) else (out,):
                if isinstance(a, np.ndarray):
                    a.setflags(write=False)
            return out

        return lru_cache(size)(frozen)

    return wrap


@kept()
def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


@kept()
def hanning(n: int) -> np.ndarray:
    return np.hanning(n)


def stft(x: np.ndarray, size: int = 512, hop: int = 256) -> np.ndarray:
    """(bins, frames): periodic Hann, zeros at both ends, padded to whole frames, divided by the window's sum."""
    w = hann(size)
    wide = np.zeros(size // 2 * 2 + len(x) + -(size // 2 * 2 + len(x) - size) % hop)
    wide[size // 2 : size // 2 + len(x)] = x
    return np.fft.rfft(cut(wide, size, hop) * w, axis=1).T / w.sum()


def stfts(xs: np.ndarray, size: int = 512, hop: int = 256) -> np.ndarray:
    """(rows, frames, bins): :func:`stft` of each row."""
    w, n = hann(size), xs.shape[1]
    wide = np.zeros((len(xs), size // 2 * 2 + n + -(size // 2 * 2 + n - size) % hop))
    wide[:, size // 2 : size // 2 + n] = xs
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(wide, size, axis=1)[:, ::hop] * w, axis=2) / w.sum()


def cut(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, size): a view of all whole frames of contiguous samples."""
    step = x.strides[0]
    return np.lib.stride_tricks.as_strided(x, ((len(x) - size) // hop + 1, size), (hop * step, step), writeable=False)


def istft(z: np.ndarray, n: int, size: int = 512, hop: int = 256) -> np.ndarray:
    w = hann(size)
    frames = np.fft.irfft(z.T * w.sum(), size, axis=1) * w
    total = (len(frames) - 1) * hop + size
    out, norm = np.zeros(total), np.zeros(total)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + size] += f
        norm[i * hop : i * hop + size] += w * w
    out = out / np.where(norm > 1e-10, norm, 1.0)
    out = out[size // 2 : size // 2 + n]
    return np.pad(out, (0, n - len(out)))


def overlapped(x: np.ndarray, change, size: int, hop: int, floor: float = 1e-3, window: np.ndarray | None = None) -> np.ndarray:
    """Frames through ``change(spectra) -> spectra`` (frames, bins), windowed twice and added up.

    The sum is divided by that of the squared windows, floored at a share of its largest value.
    """
    w = hanning(size) if window is None else window
    n = len(x)
    y = np.zeros(2 * size + n + -(size + n) % hop)
    y[size : size + n] = x
    changed = np.fft.irfft(change(np.fft.rfft(cut(y, size, hop) * w, axis=1)), size, axis=1) * w
    out = np.zeros(len(y))
    for i, f in enumerate(changed):
        out[i * hop : i * hop + size] += f
    norm = _weights(len(y), size, hop, floor) if window is None else _floored(w, len(y), hop, floor)
    return (out / norm)[size : size + n]


def _floored(w: np.ndarray, n: int, hop: int, floor: float) -> np.ndarray:
    norm = np.zeros(n)
    for a in range(0, n - len(w) + 1, hop):
        norm[a : a + len(w)] += w * w
    return np.maximum(norm, floor * max(norm.max(), 1e-12))


@kept(512)
def _weights(n: int, size: int, hop: int, floor: float) -> np.ndarray:
    return _floored(hanning(size), n, hop, floor)


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, size) whole frames; one padded frame if the signal is shorter."""
    if len(x) < size:
        return np.pad(x, (0, size - len(x)))[None]
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def _bilinear(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    fs2 = 4.0
    degree = len(p) - len(z)
    gain = k * np.real(np.prod(fs2 - z) / np.prod(fs2 - p))
    return np.append((fs2 + z) / (fs2 - z), -np.ones(degree)), (fs2 + p) / (fs2 - p), gain


def butter(order: int, cut, kind: str = "low", once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth filter; cut in (0, 1), a pair for ``band``.  once: it isn't kept."""
    return (_butter.__wrapped__ if once else _butter)(order, tuple(map(float, cut)) if isinstance(cut, (list, tuple, np.ndarray)) else float(cut), kind)


@kept(128)
def _butter(order: int, cut, kind: str) -> tuple[np.ndarray, np.ndarray]:
    p = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    warped = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / 2)
    z, k = np.empty(0, complex), 1.0
    if kind == "low":
        p, k = p * warped[0], k * warped[0] ** order
    elif kind == "high":
        k = k / np.real(np.prod(-p))
        p, z = warped[0] / p, np.zeros(order, complex)
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        q = p * width / 2
        root = np.sqrt(q * q - centre**2 + 0j)
        p, z, k = np.concatenate((q + root, q - root)), np.zeros(order, complex), k * width**order
    z, p, k = _bilinear(z, p, k)
    return np.real(k * np.poly(z)), np.real(np.poly(p))


class _Filter:
    """A filter's states (direct form II transposed) and what it gives without input."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        n = max(len(a), len(b))
        self.b, self.a = np.pad(b / a[0], (0, n - len(b))), np.pad(a / a[0], (0, n - len(a)))
        self.order = n - 1
        self.move = np.eye(n - 1, k=1)
        self.move[:, 0] -= self.a[1:]
        self.enter = self.b[1:] - self.a[1:] * self.b[0]

    def steady(self) -> np.ndarray:
        """The states that a constant one leaves as they are."""
        return np.linalg.solve(np.eye(self.order) - self.move, self.enter)

    def steps(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Sample by sample: the definition."""
        b, a, n, z, out = self.b.tolist(), self.a.tolist(), self.order + 1, [*state.tolist(), 0.0], []
        for v in x.tolist():
            y = b[0] * v + z[0]
            for i in range(1, n):
                z[i - 1] = b[i] * v - a[i] * y + z[i]
            out.append(y)
        return np.array(out)

    def responses(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(to an impulse, to steady states) by the definition."""
        one = np.zeros(n)
        one[0] = 1.0
        return self.steps(one, np.zeros(self.order)), self.steps(np.zeros(n), self.steady())


@lru_cache(128)
def _filter(b: bytes, a: bytes) -> _Filter:
    return _Filter(np.frombuffer(b), np.frombuffer(a))


def _ready(b: np.ndarray, a: np.ndarray) -> _Filter:
    return _filter(np.asarray(b, float).tobytes(), np.asarray(a, float).tobytes())


@kept(128)
def _responses(f: _Filter, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(spectrum of the impulse response for signals to n, what steady states give)."""
    h, g = f.responses(n)
    return np.fft.rfft(h, 2 * n), g


def _long(n: int) -> int:
    """The next of a few sizes, so that responses are made once for many lengths."""
    step = max(64, 1 << max(0, n.bit_length() - 3))
    return -(-n // step) * step


def _through(spectrum: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    return np.fft.irfft(np.fft.rfft(x, 2 * m) * spectrum, 2 * m)[: len(x)]


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal filter: its impulse response is convolved with the signal."""
    f, m = _ready(b, a), _long(len(x))
    if not f.order:
        return x * f.b[0]
    if not np.isfinite(x).all():  # step by step, so that what comes before stays finite
        return f.steps(x, np.zeros(f.order))
    return _through(_responses(f, m)[0], x, m) if len(x) else x.copy()


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter with odd extension by three filter lengths (less for short signals)."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x.copy()
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    f, m = _ready(b, a), _long(len(wide))
    if not np.isfinite(wide).all():
        zi = f.steady()
        y = f.steps(wide, zi * wide[0])[::-1]
        return f.steps(y, zi * y[0])[::-1][pad:-pad]
    spectrum, rest = _responses(f, m)
    rest = rest[: len(wide)]
    y = (_through(spectrum, wide, m) + rest * wide[0])[::-1]
    return (_through(spectrum, y, m) + rest * y[0])[::-1][pad:-pad]


def filtfilt_each(filters: list[tuple[np.ndarray, np.ndarray]], xs: np.ndarray) -> np.ndarray:
    """:func:`filtfilt` of each row by a filter of its own, all of one low order and used once.

    Responses come from powers of the states' matrices, all rows at once, which is less exact for high orders.
    """
    n, order = xs.shape[1], len(filters[0][1]) - 1
    pad = min(3 * (order + 1), n - 1)
    if pad < 1:
        return xs.copy()
    wide = np.concatenate((2 * xs[:, :1] - xs[:, pad:0:-1], xs, 2 * xs[:, -1:] - xs[:, -2 : -pad - 2 : -1]), axis=1)
    fs, long, m = [_Filter(b, a) for b, a in filters], _long(wide.shape[1]), math.isqrt(_long(wide.shape[1])) + 1
    move, enter, first = (np.stack([v(f) for f in fs]) for v in (lambda f: f.move, lambda f: f.enter, lambda f: f.b[:1]))
    state = np.stack((enter, np.linalg.solve(np.eye(order) - move, enter[:, :, None])[:, :, 0]), axis=2)
    rows, cols = np.empty((len(fs), m, order)), np.empty((m, len(fs), order, 2))
    row, leap = np.zeros((len(fs), 1, order)), np.linalg.matrix_power(move, m)
    row[:, 0, 0] = 1.0
    for i in range(m):
        rows[:, i], row = row[:, 0], row @ move
        cols[i], state = state, leap @ state
    h, rest = (np.einsum("irs,jis->ijr", rows, cols[..., k]).reshape(len(fs), -1) for k in (0, 1))
    spectrum, rest = np.fft.rfft(np.concatenate((first, h[:, : long - 1]), axis=1), 2 * long, axis=1), rest[:, : wide.shape[1]]
    for _ in range(2):
        wide = (np.fft.irfft(np.fft.rfft(wide, 2 * long, axis=1) * spectrum, 2 * long, axis=1)[:, : wide.shape[1]] + rest * wide[:, :1])[:, ::-1]
    return wide[:, pad:-pad]


def notch(centre: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch at centre in (0, 1)."""
    w = np.pi * centre
    beta = math.tan(w / q / 2)
    gain = 1 / (1 + beta)
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


def resample_poly(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling with a Kaiser (5.0) low-pass of 10 max(up, down) taps a side."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return x.copy()
    n, m = -(-len(x) * up // down), _long(len(x))
    at, weights = (_gathered if m * up // down * (20 * max(up, down) // up + 1) < 1 << 18 else _gathered.__wrapped__)(up, down, m)
    return (weights[:n] * np.pad(x, (0, m - len(x)))[at[:n]]).sum(1)


@kept(8)
def _taps(up: int, down: int) -> np.ndarray:
    half, most = 10 * max(up, down), max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / most) / most * np.kaiser(2 * half + 1, 5.0)
    return taps * (up / taps.sum())


@kept(256)
def _gathered(up: int, down: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights): what each sample that comes out is made of."""
    half, taps = 10 * max(up, down), _taps(up, down)
    n = -(-length * up // down)
    # output i needs the inputs j with taps at i * down - j * up + half: one gather for each tap phase
    centre = np.arange(n) * down + half
    first = np.maximum(-(-(centre - 2 * half) // up), 0)
    reach = 2 * half // up + 1
    j = first[:, None] + np.arange(reach)
    t = centre[:, None] - j * up
    ok = (t >= 0) & (t <= 2 * half) & (j < length)
    return np.clip(j, 0, length - 1).astype(np.int32), np.where(ok, taps[np.clip(t, 0, 2 * half)], 0.0)


def fit(x: np.ndarray, n: int) -> np.ndarray:
    return x[:n] if len(x) >= n else np.pad(x, (0, n - len(x)))


def stretch_to(x: np.ndarray, n: int) -> np.ndarray:
    """Linear resampling to n samples."""
    return np.interp(np.linspace(0, max(len(x) - 1, 0), n), np.arange(len(x)), x) if len(x) and n else np.zeros(n)


def spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (xs, ys), at least four points, else a polynomial."""
    n = len(xs)
    if n < 4:
        return np.polyval(np.polyfit(xs, ys, n - 1), at)
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    m, r = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    m[i, i - 1], m[i, i], m[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    r[1:-1] = 6 * np.diff(d)
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    c = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(xs, at, side="right") - 1, 0, n - 2)
    a, b = xs[k + 1] - at, at - xs[k]
    return (c[k] * a**3 + c[k + 1] * b**3) / (6 * h[k]) + (ys[k] / h[k] - c[k] * h[k] / 6) * a + (ys[k + 1] / h[k] - c[k + 1] * h[k] / 6) * b


def phase_vocoder(x: np.ndarray, rate: float, size: int = 512, hop: int | None = None) -> np.ndarray:
    """Time stretch by 1 / rate with the pitch kept."""
    hop = hop or size // 4
    w = hann(size)
    padded = np.pad(x, (size // 2, size))
    at = np.arange(0, len(padded) - size, hop)
    z = np.fft.rfft(padded[at[:, None] + np.arange(size)] * w, axis=1)
    if len(z) < 2:
        return stretch_to(x, max(1, round(len(x) / rate)))
    steps = np.arange(0, len(z) - 1, rate)
    omega = 2 * np.pi * hop * np.arange(z.shape[1]) / size
    n = max(1, round(len(x) / rate))
    k = steps.astype(int)
    f, mag, angle = (steps - k)[:, None], np.abs(z), np.angle(z)
    delta = angle[k + 1] - angle[k] - omega
    turn = np.concatenate((angle[:1], omega + delta[:-1] - 2 * np.pi * np.round(delta[:-1] / (2 * np.pi))))
    parts = np.fft.irfft(((1 - f) * mag[k] + f * mag[k + 1]) * np.exp(1j * np.cumsum(turn, axis=0)), size, axis=1) * w
    out, norm, square = np.zeros(len(steps) * hop + size), np.zeros(len(steps) * hop + size), w * w
    for i, part in enumerate(parts):
        out[i * hop : i * hop + size] += part
        norm[i * hop : i * hop + size] += square
    return fit((out / np.where(norm > 1e-8, norm, 1.0))[size // 2 :], n)


def pitch_period(x: np.ndarray, sr: int, low: float = 80.0, high: float = 400.0) -> int | None:
    """The lag of the largest autocorrelation between two pitches, or None for silence."""
    a, b = max(1, int(sr / high)), min(len(x) - 1, int(sr / low))
    y = x - x.mean() if len(x) else x
    if b <= a or not np.any(y):
        return None
    full = np.fft.irfft(np.abs(np.fft.rfft(y, 2 * len(y))) ** 2)
    return a + int(np.argmax(full[a : b + 1]))


def smooth(x: np.ndarray, taps: int) -> np.ndarray:
    return np.convolve(x, np.full(taps, 1 / taps), "same")[: len(x)] if len(x) >= taps else np.convolve(x, np.full(max(1, len(x)), 1 / max(1, len(x))), "same")


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of one best alignment."""
    prev = [(j, 0, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        row = [(i, 0, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            c, hit, s, d, n = prev[j - 1]
            if r == h:
                row.append((c, hit + 1, s, d, n))
                continue
            best = (c + 1, hit, s + 1, d, n)
            c, hit, s, d, n = prev[j]
            if c + 1 < best[0]:
                best = (c + 1, hit, s, d + 1, n)
            c, hit, s, d, n = row[j - 1]
            if c + 1 < best[0]:
                best = (c + 1, hit, s, d, n + 1)
            row.append(best)
        prev = row
    return prev[-1][1:]


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of the normal distribution by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.inf if p >= 1 else -math.inf
    low, high = -40.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function (Lentz's continued fraction)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0
