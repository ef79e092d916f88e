"""What is kept or done for many at once equals what is done one by one, and isn't done again."""

import numpy as np
import pytest

from ossicle.functions import kernels, metrics, psycho, registry

RNG = np.random.default_rng(3)
X = RNG.standard_normal(601) * 0.2


def by_definition(b, a, x):
    """y[n] = sum b x - sum a y."""
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[i] * x[n - i] for i in range(len(b)) if n >= i) - sum(a[i] * y[n - i] for i in range(1, len(a)) if n >= i)
    return y / a[0]


@pytest.mark.parametrize("kind, cut", [("low", 0.3), ("high", 0.05), ("band", [0.04, 0.42])])
def test_filters_follow_their_definition(kind, cut):
    b, a = kernels.butter(2, cut, kind)
    for x in (X, X[:5], np.zeros(50)):
        assert np.allclose(kernels.lfilter(b, a, x), by_definition(b, a, x), atol=1e-10)
    x = np.where(np.arange(60) == 30, np.nan, X[:60])
    y = kernels.lfilter(b, a, x)
    assert np.allclose(y[:30], by_definition(b, a, x[:30]), atol=1e-10) and np.isnan(y[30:]).all()
    rows = np.stack([X, X[::-1]])
    assert np.allclose(kernels.filtfilt_each([(b, a)] * 2, rows), [kernels.filtfilt(b, a, r) for r in rows], atol=1e-8)


def test_resampling_plans_serve_many_lengths():
    kernels._gathered.cache_clear()
    for n in range(540, 640):
        x = RNG.standard_normal(n)
        at = kernels._gathered.__wrapped__(3, 2, n)
        assert np.allclose(kernels.resample_poly(x, 3, 2), (at[1] * x[at[0]]).sum(1), atol=1e-12)
    assert kernels._gathered.cache_info().misses <= 3


def test_thresholds_of_frames_are_those_of_each():
    frames = np.concatenate((RNG.standard_normal((5, 400)), np.zeros((1, 400))))
    assert np.allclose(psycho.thresholds(frames, 16000), [psycho.simultaneous_threshold(f, 16000) for f in frames], atol=1e-9)
    margins = np.arange(6.0)[:, None]
    assert np.allclose(psycho.perturbation_budgets(frames, 16000, margins), [psycho.perturbation_budget(f, 16000, m) for f, m in zip(frames, margins[:, 0])], rtol=1e-9)


@pytest.mark.parametrize("x", [X, X[:300], X[:100], np.zeros(600), np.zeros(0), np.where(np.arange(600) == 9, np.nan, X[:600])])
def test_metrics_of_many_are_those_of_each(x):
    ys = [x * 0.5, x.copy(), np.zeros(len(x)), x + 0.1 * RNG.standard_normal(len(x)), np.concatenate((x, x)), x[: len(x) // 2]]
    with np.errstate(all="ignore"):
        table = metrics.Reference(x).table(ys)
        each = [list(metrics.all_metrics(x, y).values()) for y in ys]
    assert np.allclose(table, each, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_an_utterance_is_looked_at_once(monkeypatch):
    calls = []
    for name in ("stft", "stfts"):
        monkeypatch.setattr(metrics, name, lambda *a, f=getattr(metrics, name): calls.append(1) or f(*a))
    metrics.Reference(X).table([X + 0.01 * k for k in range(20)])
    assert len(calls) == 2  # of the utterance and of all that came of it; six for each before


def test_searches_judge_many_margins_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(psycho, "simultaneous_threshold", lambda *a, f=psycho.simultaneous_threshold: calls.append(1) or f(*a))
    for key in ("adversarial.multi_objective", "adversarial.gradient_free"):
        assert len(registry.apply(key, X, 16000)) == len(X)
    assert len(calls) == 2  # once for each search; twice for each margin before
