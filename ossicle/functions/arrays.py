"""Transforms and metrics of waveforms as array expressions, which stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: in a lambda, an outer expression would run for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(w: Column, f=lambda x: x) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + f(x))


def mean(w: Column, f=lambda x: x) -> Column:
    return F.when(F.size(w) > 0, total(w, f) / F.greatest(F.size(w), F.lit(1))).otherwise(zero())


def rms(w: Column) -> Column:
    return F.sqrt(mean(w, lambda x: x * x))


def peak(w: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(w, F.abs)), zero())


def scaled(w: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(w, lambda x: x * k))


def gain(w: Column, db: float) -> Column:
    return scaled(w, F.lit(10 ** (db / 20)))


def peak_normalize(w: Column, target_db: float = -3.0) -> Column:
    return scaled(w, F.when(peak(w) > 0, F.lit(10 ** (target_db / 20)) / peak(w)).otherwise(1.0))


def rms_normalize(w: Column, target: float = 0.1) -> Column:
    return scaled(w, F.when(rms(w) > 0, F.lit(target) / rms(w)).otherwise(1.0))


def loudness_normalize(w: Column, target_lufs: float = -23.0) -> Column:
    level = 20 * F.log10(rms(w) + 1e-12)
    return scaled(w, F.when(rms(w) > 0, F.pow(F.lit(10.0), (target_lufs - level) / 20)).otherwise(1.0))


def limiter(w: Column, threshold_db: float = -1.0) -> Column:
    top = 10 ** (threshold_db / 20)
    return F.transform(w, lambda x: F.least(F.greatest(x, F.lit(-top)), F.lit(top)))


def silence_padding(w: Column, samples: int) -> Column:
    return F.concat(F.array_repeat(zero(), samples), w, F.array_repeat(zero(), samples))


def bit_depth(w: Column, bits: int = 8) -> Column:
    steps = max(2.0**bits / 2 - 1, 1.0)
    return let(peak(w), lambda p: F.when(p > 0, F.transform(w, lambda x: F.rint(x / p * steps) / steps * p)).otherwise(w))


def mu_law(w: Column, mu: float = 255.0, levels: int = 127) -> Column:
    k = math.log1p(mu)

    def one(x: Column, p: Column) -> Column:
        y = F.rint(F.signum(x) * F.log1p(mu * F.abs(x) / p) / k * levels) / levels
        return F.signum(y) * (F.exp(F.abs(y) * k) - 1) / mu * p

    return let(peak(w), lambda p: F.when(p > 0, F.transform(w, lambda x: one(x, p))).otherwise(w))


def delayed(w: Column, samples: int) -> Column:
    """w later by so many samples, its length kept."""
    return F.slice(F.concat(F.array_repeat(zero(), samples), w), F.lit(1), F.greatest(F.size(w), F.lit(0)))


def add_delayed(w: Column, samples: int, by: float) -> Column:
    return F.zip_with(w, delayed(w, samples), lambda x, d: x + by * d)


def aliased(w: Column, down: int = 3) -> Column:
    """Every down-th sample, interpolated back; the last one holds."""

    def one(kept: Column, i: Column) -> Column:
        k = F.floor(i / down).cast("int")
        a = F.element_at(kept, F.least(k + 1, F.size(kept)))
        b = F.element_at(kept, F.least(k + 2, F.size(kept)))
        return a + (b - a) * (i % down) / down

    return let(F.filter(w, lambda x, i: i % down == 0), lambda kept: F.transform(w, lambda _, i: one(kept, i)))


def comb(w: Column, samples: int, by: float) -> Column:
    """Feedback comb: y[i] = x[i] + by * y[i - samples], as a fold over the samples."""
    seed = F.array().cast("array<double>")

    def step(y: Column, x: Column) -> Column:
        before = F.when(F.size(y) >= samples, F.element_at(y, F.greatest(F.size(y) - samples + 1, F.lit(1)))).otherwise(zero())
        return F.concat(y, F.array(x + by * F.coalesce(before, zero())))

    return F.aggregate(w, seed, step)


def tone(w: Column, hz: float, sr: int, amplitude: float) -> Column:
    return F.transform(w, lambda x, i: x + amplitude * F.sin(2 * math.pi * hz * i / sr))


def device_distortion(w: Column, drive: float = 1.5, asymmetry: float = 0.1) -> Column:
    driven = F.transform(w, lambda x: F.tanh(drive * x) + asymmetry * F.tanh(drive * x) * F.tanh(drive * x))
    return _centred(driven)


def common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def pair_sum(a: Column, b: Column, f) -> Column:
    a, b = common(a, b)
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def mse(a: Column, b: Column) -> Column:
    return pair_sum(a, b, lambda x, y: (x - y) * (x - y)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def snr_db(a: Column, b: Column) -> Column:
    """In dB; null where the reference has infinity: no noise."""
    noise, own = mse(a, b), mean(common(a, b)[0], lambda x: x * x)
    return F.when(noise < 1e-15, F.lit(None)).when(own < 1e-15, zero()).otherwise(10 * F.log10(own / F.greatest(noise, F.lit(1e-300))))


def _centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def si_sdr_db(a: Column, b: Column) -> Column:
    return let(_moments(a, b), lambda s: _si_sdr(s["own"], s["cross"], s["other"]))


def _moments(a: Column, b: Column) -> Column:
    """Sums of squares and products of the centred signals."""
    x, y = (_centred(v) for v in common(a, b))
    sums = ((n, u, v) for n, u, v in (("own", "x", "x"), ("cross", "x", "y"), ("other", "y", "y")))
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: F.struct(*(pair_sum(s[u], s[v], lambda p, q: p * q).alias(n) for n, u, v in sums)))


def _si_sdr(own: Column, cross: Column, other: Column) -> Column:
    target = cross * cross / F.greatest(own, F.lit(1e-300))
    rest = other - target
    return F.when(own < 1e-15, zero()).when(rest < 1e-15, F.lit(None)).when(target < 1e-15, F.lit(-100.0)).otherwise(10 * F.log10(F.greatest(target, F.lit(1e-300)) / F.greatest(rest, F.lit(1e-300))))


def correlation(a: Column, b: Column) -> Column:
    """Centred; for a constant signal 1 if both are the same, else 0."""
    same = F.when(mse(a, b) < 1e-16, 1.0).otherwise(0.0)

    def ratio(s: Column) -> Column:
        norm = F.sqrt(s["own"] * s["other"])
        return F.when(norm > 1e-15, s["cross"] / F.greatest(norm, F.lit(1e-300))).otherwise(same)

    return let(_moments(a, b), ratio)


def psnr_db(a: Column, b: Column) -> Column:
    r = F.sqrt(mse(a, b))
    return F.when(r < 1e-15, F.lit(None)).when(peak(a) < 1e-15, zero()).otherwise(20 * F.log10(F.greatest(peak(a), F.lit(1e-300)) / F.greatest(r, F.lit(1e-300))))


def rms_ratio(a: Column, b: Column) -> Column:
    a, b = common(a, b)
    return rms(b) / (rms(a) + 1e-12)


def frames(w: Column, size: int, hop: int) -> Column:
    """Whole frames."""
    n = F.floor((F.size(w) - size) / hop)
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.slice(w, i * hop + 1, F.lit(size))))


def crossings(w: Column) -> Column:
    """Share of neighbours with different signs."""
    ahead = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), ahead, lambda x, y: F.when((x < 0) != (y < 0), 1.0).otherwise(0.0))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(w) - 1, F.lit(1))


def dft_power(w: Column, n: int) -> Column:
    """|rfft|^2 of n samples by the definition: for short windows only."""
    bins = F.sequence(F.lit(0), F.lit(n // 2))

    def at(k: Column) -> Column:
        re = F.aggregate(F.transform(w, lambda x, i: x * F.cos(2 * math.pi * k * i / n)), F.lit(0.0), lambda s, v: s + v)
        im = F.aggregate(F.transform(w, lambda x, i: x * F.sin(2 * math.pi * k * i / n)), F.lit(0.0), lambda s, v: s + v)
        return re * re + im * im

    return F.transform(bins, at)
