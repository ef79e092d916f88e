import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ossicle.operators import gap, grid, select, stats, summary, text


def near(a, b):
    return abs(a - b) < 1e-9


def test_benjamini_hochberg_and_bonferroni(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    rows = {r.k: r for r in stats.benjamini_hochberg(p, "p", "k").collect()}
    assert all(r.reject for r in rows.values()) and near(rows["a"].adjusted, 0.02) and near(rows["b"].adjusted, 0.04) and near(rows["c"].adjusted, 0.04)
    assert {r.k for r in stats.bonferroni(p, "p").where("reject").collect()} == {"a", "d"}


def test_pareto_ties(spark):
    rows = [("a", 0.9, 0.1), ("b", 0.8, 0.4), ("c", 0.75, 0.2), ("d", 0.7, 0.45), ("e", 0.7, 0.1), ("f", 0.8, 0.4), ("g", None, 0.9)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    front = lambda ties: {r.k for r in summary.pareto(df, ["k"], ["x", "y"], ties).where("pareto").collect()}
    assert front("keep") == {"a", "b", "d", "f"} and front("drop") == {"a", "d"}
    three = summary.pareto(df.withColumn("z", F.lit(1.0)), ["k"], ["x", "y", "z"])
    assert {r.k for r in three.where("pareto").collect()} == {"a", "b", "d", "f"}
    with pytest.raises(ValueError):
        summary.pareto(df, ["k"], ["x", "y"], "maybe")


def test_cross_delta_is_a_mean_over_lineages(spark):
    rows = []
    for cond, kind, wers in (("o", "original", (0.1, 0.05, 0.2, 0.02)), ("x", "transform", (0.6, 0.15, 0.5, 0.12))):
        rows += [(cond, kind, "A", u, u, "ok", 15.0, 0.9, 1.0, *wers) for u in range(4)]
    rows.append(("broken", "transform", "A", 1, 1, "error", None, None, None, None, None, None, None))
    cols = "condition_id string, kind string, family string, utt_id int, spk int, status string, snr_db double, stoi_proxy double, mbsd double, wer_whisper_tiny double, wer_whisper_small double, wer_vosk_small_en double, wer_wav2vec2_base double"
    got = {r.condition_id: r for r in summary.summary(spark.createDataFrame(rows, cols)).collect()}
    assert near(got["x"].cross_delta_wer, ((0.5 + 0.1) / 2 + 0.3 + 0.1) / 3)
    assert got["broken"].n_err == 1 and got["broken"].n_ok == 0 and got["broken"].attack_rank is None
    assert got["x"].attack_rank == 1 and got["o"].attack_rank is None


def test_gap_formulas(spark):
    one = spark.range(1)
    v = one.select(
        gap.survival(F.lit(0.4), F.lit(0.3)), gap.survival(F.lit(0.0), F.lit(0.0)), gap.survival(F.lit(0.0), F.lit(0.2)), gap.survival(F.lit(0.1), F.lit(0.9)),
        gap.recovery(F.lit(0.75)), gap.hsr_proxy(F.lit(0.83)), gap.gap(F.lit(1.2), F.lit(0.25)), gap.robustness(F.lit(1.0), F.lit(0.5)), gap.composite(F.lit(0.5), F.lit(0.8), F.lit(0.9)), gap.label(F.lit(0.5)),
    ).first()
    assert np.allclose(v[:9], [0.75, 1, 0, 2, 0.25, 0.932, 0.75, 0.8, 0.5 * 0.75 + 0.24 + 0.18]) and v[9] == "GOOD"
    long = spark.createDataFrame([(u, m, w) for u, ws in enumerate([(0.6, 0.9), (0.6, 0.1), (0.2, 0.3)]) for m, w in enumerate(ws)], "utt_id int, m int, wer double").withColumn("c", F.lit(1))
    assert near(gap.common_failures(long, ["c"]).first().cmfr, 1 / 3)


def test_text(spark):
    df = spark.createDataFrame([("Hello, World! 123", "the quick brown fox", "the slow brown fox jumps"), ("theré_X  y", "a", ""), (None, "", "b")], "t string, r string, h string")
    rows = df.select(text.normalize(F.col("t")).alias("n"), text.word_error_rate(F.col("r"), F.col("h")).alias("w"), text.phonemes(F.col("r")).alias("p")).collect()
    assert [r.n for r in rows] == ["hello world 123", "theré_x y", ""] and [r.w for r in rows] == [0.5, 1.0, None] and [r.p for r in rows] == [15, 1, 0]
    d = text.detailed(df.where("r <> ''"), "r", "h").select("wer", "hit_rate", "sub_rate", "del_rate", "ins_rate").collect()
    assert tuple(d[0]) == (0.5, 0.75, 0.25, 0.0, 0.25) and tuple(d[1]) == (1.0, 0.0, 0.0, 1.0, 0.0)
    pairs = {(r.ref_word, r.hyp_word): r.n for r in text.confusions(df, "r", "h").collect()}
    assert pairs[("quick", "slow")] == 1 and pairs[(None, "jumps")] == 1 and pairs[("a", None)] == 1
    many = " ".join(f"w{i}" for i in range(3000))
    assert near(spark.createDataFrame([(many, many.replace("w7 ", "x "))], "r string, h string").select(text.word_error_rate(F.col("r"), F.col("h"))).first()[0], 1 / 3000)
    m = df.select(text.mock_transcript(F.lit("one two three"), F.lit(20.0), F.lit(0.0)), text.mock_transcript(F.lit("one two"), F.lit(1.0), F.lit(1.0))).first()
    assert tuple(m) == ("one mumble three", "one two")


def test_selection(spark):
    df = spark.createDataFrame([(f"s{i % 40:02d}", i) for i in range(400)], "spk string, utt int")
    rows = select.balanced(df, "spk", "utt", 10, 70).collect()
    assert len(rows) == 70 and len({r.spk for r in rows}) == 10 and {sum(r.spk == s for r in rows) for s in {r.spk for r in rows}} == {7}
    parts = select.speaker_split(df, "spk").select("spk", "split").distinct().collect()
    assert len(parts) == 40 and [sum(r.split == s for r in parts) for s in ("train", "valid", "test")] == [28, 6, 6]
    t0 = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([("c", t0 + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 61))], "client string, ts timestamp, i int")
    assert [r.accepted for r in select.rate_limited(req, "client", "ts", 2).orderBy("i").collect()] == [True, True, False, True]
    assert select.rate_limited(req, "client", "ts", 0).where("not accepted").count() == 0
    gate = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", True, False), ("c", False, False)], "p string, c boolean, k boolean")
    assert {r.p: r.passed for r in select.attention_gate(gate, "p", F.col("k"), F.col("c")).collect()} == {"a": True, "b": False, "c": True}


def test_scaling_fit(spark):
    pts = spark.createDataFrame([("x", c, 40 * c**-1.25) for c in (39.0, 74.0, 244.0)] + [("flat", c, 0.5) for c in (39.0, 74.0)] + [("one", 39.0, 0.5)], "k string, c double, w double")
    rows = {r.k: r for r in stats.power_law(pts, ["k"], "c", "w").collect()}
    assert near(rows["x"].b, 1.25) and abs(rows["x"].a - 40) < 1e-6 and near(rows["x"].r2, 1) and "one" not in rows
    v = spark.range(1).select(stats.break_capacity(F.lit(40.0), F.lit(1.25), 0.3), stats.break_capacity(F.lit(1.0), F.lit(-1.0), 0.3), stats.months(F.lit(488.0), 244.0, 8.0), stats.months(F.lit(1.0), 244.0, 8.0)).first()
    assert near(v[0], (40 / 0.3) ** 0.8) and v[1] is None and near(v[2], 8) and v[3] == 0


def test_effects_and_tests(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("k", "a", v) for v in a] + [("k", "b", v) for v in b], "k string, g string, v double")
    two = stats.two_samples(df, ["k"], "g", "a", "b", "v")
    t, dof = stats.welch()
    r = two.select(stats.cohen_d().alias("d"), t.alias("t"), dof.alias("df"), stats.hedges_g(stats.cohen_d()).alias("g")).first()
    assert abs(r.d + 1.2) < 1e-6 and abs(r.t + 1.8973666) < 1e-6 and abs(r.df - 5.8823529) < 1e-6 and abs(r.g + 1.2 * 0.9027) < 1e-3
    u = stats.mann_whitney(df, ["k"], "g", "a", "b", "v").first()
    assert near(u.u, 5.0)
    w = stats.wilcoxon(spark.createDataFrame([("k", 1.0, 2.0), ("k", 5.0, 3.0), ("k", 4.0, 4.0), ("k", 9.0, 6.0)], "k string, a double, b double"), ["k"], "a", "b").first()
    assert (w.n, w.w_plus, w.w_minus, w.w) == (3, 5.0, 1.0, 1.0)
    low, high = stats.bca([1.0, 2, 3, 4, 9], list(np.linspace(2.0, 6.0, 101)))
    assert 2 <= low < high <= 6
    assert abs(df.select(stats.z_p_value(F.lit(1.96))).first()[0] - 0.05) < 1e-3


def test_grid(spark):
    rows = grid.condition_list(["baseline.gain", "psychoacoustic.masked_noise"])
    assert sum(r[2] == "psychoacoustic.masked_noise" for r in rows) == 7 and rows[0][1] == "original" and rows[-1][1] == "control"
    assert sum(r[2].startswith("psychoacoustic") and r[1] == "sweep" for r in rows) == 27
    assert grid.parameter_grid(spark, {"a": [1, 2, 3, 4, 5, 6], "f": [1, 2, 3, 4]}).count() == 24
    assert grid.family_counts(spark).agg(F.sum("n")).first()[0] == 119
    done = spark.createDataFrame([("original", 1)], "condition_id string, utt_id long")
    assert grid.tasks(grid.conditions(spark, ["baseline.gain"], False), spark.range(1, 4).withColumnRenamed("id", "utt_id"), done).count() == 5
