"""Metrics of a signal and its processed form, on numpy; :mod:`arrays` has those that are array expressions."""

from __future__ import annotations

import numpy as np

from .kernels import kept, stft, stfts
from .psycho import BANDS, hz_to_bark

NAMES = [
    "snr_db", "si_sdr_db", "rmse", "mse", "psnr_db", "spectral_convergence", "normalized_cross_correlation", "log_spectral_distance",
    "mbsd", "stoi_proxy", "rms_original", "rms_processed", "rms_ratio",
]


def _common(x, y):
    n = min(len(x), len(y))
    return np.asarray(x[:n], float), np.asarray(y[:n], float)


def snr_db(x, y) -> float:
    x, y = _common(x, y)
    noise, own = np.mean((x - y) ** 2) if len(x) else 0.0, np.mean(x * x) if len(x) else 0.0
    return np.inf if noise < 1e-15 else 0.0 if own < 1e-15 else 10 * np.log10(own / noise)


def si_sdr_db(x, y) -> float:
    x, y = _common(x, y)
    if not len(x):
        return 0.0
    x = x - x.mean()
    return _si_sdr(x, y - y.mean(), x @ x)


def _si_sdr(x: np.ndarray, y: np.ndarray, own: float) -> float:
    if own < 1e-15:
        return 0.0
    target = (y @ x) / own * x
    rest = y - target
    if rest @ rest < 1e-15:
        return np.inf
    return -100.0 if target @ target < 1e-15 else 10 * np.log10((target @ target) / (rest @ rest))


@kept(8)
def _bands(sr: int) -> np.ndarray:
    """(bands, bins): which bins of a short spectrum make up each Bark band."""
    bark = np.floor(hz_to_bark(np.arange(257) * sr / 512)).astype(int)
    return (bark[None] == np.arange(BANDS)[:, None]).astype(float)


class Signal:
    """What the metrics need of one of two signals of the same length; made when asked for, once."""

    def __init__(self, x: np.ndarray, sr: int = 16000):
        self.x, self.sr = x, sr
        self._spectrum = self._levels = self._powers = self._shape = self._plain = None

    @property
    def magnitudes(self) -> np.ndarray:
        if self._spectrum is None:
            self._spectrum = np.abs(stft(self.x))
        return self._spectrum

    @property
    def levels(self) -> np.ndarray:
        if self._levels is None:
            self._levels = 10 * np.log10(np.maximum(self.magnitudes**2, 1e-12))
        return self._levels

    @property
    def powers(self) -> np.ndarray:
        if self._powers is None:
            self._powers = _bands(self.sr) @ self.magnitudes**2
        return self._powers

    @property
    def shape(self) -> tuple[np.ndarray, np.ndarray]:
        """(magnitudes without their mean over time, their norms) of each bin."""
        if self._shape is None:
            a = self.magnitudes - self.magnitudes.mean(1, keepdims=True)
            self._shape = a, np.sqrt(np.einsum("ij,ij->i", a, a))
        return self._shape

    @property
    def plain(self) -> tuple[np.ndarray, float, float, np.ndarray, float]:
        """(centred, its power, mean square, spectrum's magnitudes, their norm)."""
        if self._plain is None:
            x = self.x
            c = x - x.mean() if len(x) else x
            s = np.abs(np.fft.rfft(x)) if len(x) else np.zeros(1)
            self._plain = c, float(c @ c), float(x @ x) / len(x) if len(x) else 0.0, s, float(np.linalg.norm(s))
        return self._plain


def _lsd(a: Signal, b: Signal) -> float:
    return 0.0 if len(a.x) < 256 else float(np.sqrt(((a.levels - b.levels) ** 2).mean(0)).mean())


def log_spectral_distance(x, y) -> float:
    return _lsd(*map(Signal, _common(x, y)))


def _mbsd(a: Signal, b: Signal) -> float:
    if len(a.x) < 256:
        return 0.0
    active = a.powers.sum(0) > 1e-4
    if not active.any():
        return 0.0
    p, q = (10 * np.log10(np.maximum(s.powers[:, active], 1e-10)) for s in (a, b))
    return float(np.abs(p - q).mean())


def mbsd(x, y, sr: int = 16000) -> float:
    return _mbsd(*(Signal(v, sr) for v in _common(x, y)))


def likeness(a: Signal, b: Signal) -> float:
    """:func:`stoi_proxy` of signals."""
    if len(a.x) < 512:
        return 1.0
    (u, nu), (v, nv) = a.shape, b.shape
    ok = (nu > 1e-8) & (nv > 1e-8)
    if not ok.any():
        return 1.0 if np.allclose(a.x, b.x) else 0.0
    r = np.clip(np.einsum("ij,ij->i", u, v)[ok] / (nu[ok] * nv[ok]), -1, 1)
    return float((r.mean() + 1) / 2)


def judged(a: Signal, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(:func:`likeness`, :func:`snr_db`) of each row."""
    return _likenesses(a, ys, np.abs(stfts(ys)) if len(a.x) >= 512 else None), _snrs(float(np.mean(a.x * a.x)), np.mean((a.x - ys) ** 2, axis=1))


def _snrs(own: float, noise: np.ndarray) -> np.ndarray:
    return np.where(noise < 1e-15, np.inf, 0.0 if own < 1e-15 else 10 * np.log10(max(own, 1e-300) / np.maximum(noise, 1e-300)))


def _likenesses(a: Signal, ys: np.ndarray, magnitudes: np.ndarray | None) -> np.ndarray:
    if len(a.x) < 512:
        return np.ones(len(ys))
    u, nu = a.shape
    v = magnitudes - magnitudes.mean(1, keepdims=True)
    nv = np.sqrt(np.einsum("kfb,kfb->kb", v, v))
    ok = (nu > 1e-8) & (nv > 1e-8)
    r = np.where(ok, np.clip(np.einsum("kfb,bf->kb", v, u) / np.where(ok, nu * nv, 1.0), -1, 1), 0.0)
    n = ok.sum(1)
    return np.where(n > 0, (r.sum(1) / np.maximum(n, 1) + 1) / 2, [float(np.allclose(a.x, y)) if not k else 0.0 for y, k in zip(ys, n)])


def stoi_proxy(x, y) -> float:
    return likeness(*map(Signal, _common(x, y)))


class Reference:
    """A signal that others are measured against; what is known of it is kept for each length they have."""

    def __init__(self, x, sr: int = 16000):
        self.x, self.sr, self._known = np.asarray(x, float), sr, {}

    def upto(self, n: int) -> Signal:
        n = min(n, len(self.x))
        if n not in self._known:
            if len(self._known) > 8:
                self._known.clear()
            self._known[n] = Signal(self.x[:n], self.sr)
        return self._known[n]

    def table(self, ys: list[np.ndarray]) -> np.ndarray:
        """(signals, metrics in the order of NAMES): :meth:`metrics` of many, those of one length at once."""
        out, lengths = np.empty((len(ys), len(NAMES))), {}
        for i, y in enumerate(ys):
            lengths.setdefault(min(len(y), len(self.x)), []).append(i)
        for n, places in lengths.items():
            step = max(1, (1 << 16) // max(n, 1))
            for at in range(0, len(places), step):
                some = places[at : at + step]
                out[some] = self._rows(self.upto(n), np.stack([np.asarray(ys[i][:n], float) for i in some])) if n else [list(self.metrics(ys[i]).values()) for i in some]
        return out

    def _rows(self, a: Signal, ys: np.ndarray) -> np.ndarray:
        x, n, k = a.x, len(a.x), len(ys)
        cx, xx, px, sx, nx = a.plain
        square = lambda v: np.einsum("ij,ij->i", v, v)
        alike = lambda: [float(np.allclose(x, y)) for y in ys]
        cy = ys - ys.mean(1, keepdims=True)
        mse, yy, py, peak = square(ys - x) / n, square(cy), square(ys) / n, float(np.abs(self.x).max())
        rmse, norm, along = np.sqrt(mse), np.sqrt(xx * yy), cy @ cx
        silent = xx < 1e-15
        target = (np.zeros(k) if silent else along / xx)[:, None] * cx
        tt, rest = square(target), square(cy - target)
        sdr = np.zeros(k) if silent else np.where(rest < 1e-15, np.inf, np.where(tt < 1e-15, -100.0, 10 * np.log10(np.maximum(tt, 1e-300) / np.maximum(rest, 1e-300))))
        psnr = np.where(rmse < 1e-15, np.inf, 0.0 if peak < 1e-15 else 20 * np.log10(max(peak, 1e-300) / np.maximum(rmse, 1e-300)))
        gap = np.sqrt(square(np.abs(np.fft.rfft(ys, axis=1)) - sx)) / nx if nx > 1e-15 else np.zeros(k)
        ncc = np.where(norm > 1e-15, along / np.where(norm > 1e-15, norm, 1.0), alike() if (norm <= 1e-15).any() else 0.0)
        lsd, bark, mag = np.zeros(k), np.zeros(k), None
        if n >= 256:
            mag = np.abs(stfts(ys))
            power = mag**2
            lsd = np.sqrt(((10 * np.log10(np.maximum(power, 1e-12)) - a.levels.T) ** 2).mean(2)).mean(1)
            active = a.powers.sum(0) > 1e-4
            if active.any():
                own = 10 * np.log10(np.maximum(a.powers[:, active], 1e-10)).T
                bark = np.abs(10 * np.log10(np.maximum(power[:, active] @ _bands(self.sr).T, 1e-10)) - own).mean((1, 2))
        ro, rp = np.full(k, px**0.5), np.sqrt(py)
        return np.stack((_snrs(px, mse), sdr, rmse, mse, psnr, gap, ncc, lsd, bark, _likenesses(a, ys, mag), ro, rp, rp / (ro + 1e-12)), axis=1)

    def metrics(self, y) -> dict[str, float]:
        a = self.upto(len(y))
        b = Signal(np.asarray(y[: len(a.x)], float), self.sr)
        x, y = a.x, b.x
        (cx, xx, px, sx, nx), (cy, yy, py, sy, _) = a.plain, b.plain
        mse = float(np.mean((x - y) ** 2)) if len(x) else 0.0
        rmse, peak = mse**0.5, float(np.abs(self.x).max()) if len(self.x) else 0.0
        norm, ro, rp = (xx * yy) ** 0.5, px**0.5, py**0.5
        snr = np.inf if mse < 1e-15 else 0.0 if px < 1e-15 else 10 * np.log10(px / mse)
        return dict(
            zip(
                NAMES,
                (
                    snr, _si_sdr(cx, cy, xx) if len(x) else 0.0, rmse, mse, np.inf if rmse < 1e-15 else 0.0 if peak < 1e-15 else 20 * np.log10(peak / rmse),
                    float(np.linalg.norm(sx - sy) / nx) if nx > 1e-15 else 0.0,
                    float(cx @ cy / norm) if norm > 1e-15 else float(np.allclose(x, y)), _lsd(a, b), _mbsd(a, b), likeness(a, b), ro, rp, rp / (ro + 1e-12),
                ),
            )
        )


def all_metrics(x, y, sr: int = 16000) -> dict[str, float]:
    return Reference(x, sr).metrics(y)
