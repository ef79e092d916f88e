import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ossicle.functions import arrays, kernels, metrics, psycho, registry
from ossicle.functions.channel import DEFENSES

T = np.arange(8000) / 16000
PROBE = 0.3 * (1 + np.sin(2 * np.pi * 4 * T)) * np.sin(2 * np.pi * 220 * T)
COUNTS = {"A": 11, "B": 16, "C": 11, "D": 24, "E": 20, "F": 9, "G": 10, "H": 18}


def test_registry_counts_and_errors():
    assert {f: len(registry.keys(f)) for f in COUNTS} == COUNTS and len(registry.keys()) == 119
    with pytest.raises(KeyError):
        registry.get("no.such")
    with pytest.raises(ValueError):
        registry.register("baseline.gain", "A", lambda x, sr, rng: x)
    with pytest.raises(ValueError):
        registry.register("own.x", "Z", lambda x, sr, rng: x)
    with pytest.raises(TypeError):
        registry.register("own.x", "A", 3)
    with pytest.raises(ValueError):
        registry.apply("baseline.gain", PROBE, 16000, {"volume": 3})


@pytest.mark.parametrize("key", registry.keys())
def test_every_transform_is_finite_and_repeatable(key):
    for x in (PROBE, np.zeros(700), PROBE[:64]):
        y = registry.apply(key, x, 16000)
        assert np.isfinite(y).all() and y.ndim == 1 and np.array_equal(y, registry.apply(key, x, 16000))
    assert len(registry.apply(key, np.empty(0), 16000)) == 0


@pytest.mark.parametrize(
    ("key", "bad"),
    [
        ("baseline.peak_normalize", {"target_db": 1.0}), ("baseline.gain", {"gain_db": math.inf}), ("temporal.dropout", {"dropout_rate": 2.0}), ("temporal.time_stretch", {"rate": 0.0}),
        ("multirate.integer", {"down_factor": 0}), ("spectral.notch", {"frequency_hz": 9000.0}), ("noise.rir", {"rt60_s": 0.0}), ("psychoacoustic.masked_noise", {"margin_db": -1.0}), ("channel.packet_loss", {"loss_rate": -0.1}),
    ],
)
def test_bad_parameters(key, bad):
    with pytest.raises(ValueError):
        registry.apply(key, PROBE, 16000, bad)


def test_neutral_parameters_change_nothing():
    for key, p in (
        ("baseline.identity", {}), ("baseline.gain", {"gain_db": 0.0}), ("spectral.warping", {}), ("noise.echo", {"gain": 0.0}), ("temporal.jitter", {"amplitude_ms": 0.0}),
        ("temporal.dropout", {"dropout_rate": 0.0}), ("channel.packet_loss", {"loss_rate": 0.0}), ("multirate.drift", {}), ("multirate.aliasing", {"down_factor": 1}),
    ):
        assert np.allclose(registry.apply(key, PROBE, 16000, p), PROBE)


def test_physics():
    rms = lambda x: np.sqrt(np.mean(x * x))
    for key in ("noise.white", "noise.pink", "noise.violet", "noise.speech_shaped", "noise.brown"):
        assert abs(metrics.snr_db(PROBE, registry.apply(key, PROBE, 16000, {"snr_db": 12.0})) - 12) < 1e-6
    assert rms(registry.apply("spectral.highpass", PROBE, 16000, {"cutoff_hz": 4000.0})) < 0.01 * rms(PROBE)
    assert abs(np.abs(registry.apply("baseline.peak_normalize", PROBE, 16000)).max() - 10 ** (-3 / 20)) < 1e-12
    assert len(registry.apply("temporal.time_stretch", PROBE, 16000, {"rate": 2.0})) == 4000
    quiet = metrics.stoi_proxy(PROBE, registry.apply("psychoacoustic.masked_noise", PROBE, 16000, {"margin_db": 40.0}))
    loud = metrics.stoi_proxy(PROBE, registry.apply("psychoacoustic.masked_noise", PROBE, 16000, {"margin_db": 0.0}))
    assert quiet >= loud
    spectrum = np.abs(np.fft.rfft(registry.apply("spectral.minimum_phase", PROBE, 16000)))
    own = np.abs(np.fft.rfft(PROBE))
    big = own > 0.1 * own.max()
    assert np.allclose(spectrum[big] / spectrum.max(), own[big] / own.max(), atol=0.02)


def test_chain_and_defences():
    assert np.array_equal(registry.chain([], PROBE, 16000), PROBE)
    two = registry.chain([("baseline.gain", {"gain_db": 6.0}), ("baseline.gain", {"gain_db": -6.0})], PROBE, 16000)
    assert np.allclose(two, PROBE)
    assert list(DEFENSES) == [f"defense.{n}" for n in ("raw", "loudness_norm", "resampling", "spectral_denoise", "codec_sim", "replay_sim")]
    assert all(np.isfinite(f(PROBE, 16000)).all() and len(f(PROBE, 16000)) == len(PROBE) for f in DEFENSES.values())


def test_kernels():
    b, a = kernels.butter(4, 0.2)
    assert np.allclose(a, [1, -2.36951301, 2.31398841, -1.05466541, 0.18737949]) and np.allclose(b[0], 0.00482434, atol=1e-8)
    assert np.allclose(kernels.istft(kernels.stft(PROBE), len(PROBE)), PROBE)
    x = np.linspace(0, 7, 8)
    assert np.allclose(kernels.spline(x, x**3, np.linspace(0, 7, 30)), np.linspace(0, 7, 30) ** 3)
    low = kernels.filtfilt(*kernels.butter(2, 0.5), PROBE)
    assert np.abs(low - PROBE)[100:-100].max() < 0.01
    assert len(kernels.resample_poly(PROBE, 3, 2)) == 12000
    assert np.allclose(kernels.resample_poly(np.ones(500), 3, 2)[100:-100], 1, atol=1e-3)
    assert kernels.edit_counts("a b c d".split(), "a x c d e".split()) == (3, 1, 0, 1)
    assert abs(kernels.t_two_sided(2.0, 10) - 0.0733880) < 1e-6 and abs(kernels.normal_ppf(0.975) - 1.959964) < 1e-6


def test_psychoacoustics():
    quiet = psycho.absolute_threshold(np.array([0.0, 1000.0, 3300.0]))
    assert quiet[0] == 100 and quiet[2] < quiet[1]
    threshold = psycho.simultaneous_threshold(PROBE, 16000)
    assert len(threshold) == 4001 and (threshold >= psycho.absolute_threshold(psycho.grid(8000, 16000)) - 1e-9).all()
    assert np.array_equal(psycho.simultaneous_threshold(np.zeros(512), 16000), psycho.absolute_threshold(psycho.grid(512, 16000)))
    assert (psycho.masking_budget(PROBE, 16000, 0) >= psycho.masking_budget(PROBE, 16000, 10)).all()
    for bad in (lambda: psycho.masking_budget(PROBE, 16000, -1), lambda: psycho.simultaneous_threshold(np.array([np.nan]), 16000), lambda: psycho.hz_to_bark(1.0, "x"), lambda: psycho.to_level_spl(np.zeros(4), 60.0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        psycho.bark_to_hz(1.0, "zwicker")
    assert abs(psycho.bark_to_hz(psycho.hz_to_bark(1234.0)) - 1234) < 40 and abs(psycho.level_spl(psycho.to_level_spl(PROBE, 60.0)) - 60) < 1e-9
    assert psycho.temporal_threshold(PROBE, 16000).shape[1] == 201 and psycho.loudness(PROBE, 16000) > 0


def test_metric_identities():
    same = metrics.all_metrics(PROBE, PROBE)
    assert same["snr_db"] == math.inf and same["rmse"] == 0 and abs(same["stoi_proxy"] - 1) < 1e-9 and same["mbsd"] == 0 and same["log_spectral_distance"] == 0
    assert metrics.snr_db(np.zeros(9), np.ones(9)) == 0 and metrics.stoi_proxy(PROBE[:100], PROBE[:100] * 2) == 1
    assert metrics.all_metrics(PROBE, PROBE[:4000])["rms_ratio"] == pytest.approx(1)


def test_columns_agree_with_numpy(spark):
    x, y = PROBE[:200], registry.apply("noise.white", PROBE[:200], 16000)
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(arrays.snr_db(a, b), arrays.si_sdr_db(a, b), arrays.correlation(a, b), arrays.psnr_db(a, b), arrays.mse(a, b), arrays.snr_db(a, a), arrays.correlation(a, a)).first()
    m = metrics.all_metrics(x, y)
    assert np.allclose(r[:5], [m[k] for k in ("snr_db", "si_sdr_db", "normalized_cross_correlation", "psnr_db", "mse")])
    assert r[5] is None and abs(r[6] - 1) < 1e-9
    cases = {
        "baseline.gain": arrays.gain(a, 6.0), "baseline.peak_normalize": arrays.peak_normalize(a), "baseline.rms_normalize": arrays.rms_normalize(a), "baseline.limiter": arrays.limiter(a),
        "baseline.bit_depth_converter": arrays.bit_depth(a), "baseline.mu_law_companding": arrays.mu_law(a), "baseline.loudness_normalize": arrays.loudness_normalize(a),
        "channel.aec_artifacts": arrays.add_delayed(a, 96, -0.6), "spectral.comb_filter": arrays.comb(a, 160, 0.5), "multirate.aliasing": arrays.aliased(a, 3),
    }
    row = df.select(*(c.alias(str(i)) for i, c in enumerate(cases.values()))).first()
    for got, key in zip(row, cases):
        assert np.allclose(got, registry.apply(key, x, 16000)), key
