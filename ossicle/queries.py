"""Named queries over the test tables, and their DuckDB twins."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import psycho
from .operators import gap, grid, select, stats, summary, text
from .sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
RANKS = [f"{r}_rank" for r in "human attack gap quality".split()]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# signals: short ones, 64 samples each.

SHORT = "short as (select vec_id as utt_id, list_transform(embedding, lambda x: x::double) as w from embeddings where embedding is not null)"


def _digest(w) -> list:
    return [F.size(w).cast("long").alias("n"), F.round(A.total(w), 6).alias("total"), F.round(F.aggregate(F.transform(w, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("weighted"), F.round(A.peak(w), 6).alias("peak")]


_SQL_DIGEST = "len(y)::bigint as n, round(list_sum(y), 6) as total, round(list_sum(list_transform(y, lambda x, i: x * i)), 5) as weighted, round(list_max(list_transform(y, lambda x: abs(x))), 6) as peak"


def signal(name: str, change: Callable, sql: str) -> None:
    """A transform of every short signal: length, sum, weighted sum and peak of what comes out."""

    def run(spark, sf_dir):
        return T.short_signals(spark, sf_dir).select("utt_id", change(F.col("waveform")).alias("y")).select("utt_id", *_digest(F.col("y")))

    QUERIES[name] = run
    SQL[name] = f"with {SHORT}, s as (select utt_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x)) / len(w)) as r, list_max(list_transform(w, lambda x: abs(x))) as p from short), t as (select utt_id, {sql} as y from s) select utt_id, {_SQL_DIGEST} from t"


signal("signal_gain", lambda w: A.gain(w, 6.0), "list_transform(w, lambda x: x * pow(10, 0.3))")
signal("signal_peak_normalize", A.peak_normalize, "list_transform(w, lambda x: x * pow(10, -0.15) / p)")
signal("signal_rms_normalize", A.rms_normalize, "list_transform(w, lambda x: x * 0.1 / r)")
signal("signal_loudness_normalize", A.loudness_normalize, "list_transform(w, lambda x: x * pow(10, (-23 - 20 * log10(r + 1e-12)) / 20))")
signal("signal_limiter", lambda w: A.limiter(w, -12.0), "list_transform(w, lambda x: least(greatest(x, -pow(10, -0.6)), pow(10, -0.6)))")
signal("signal_silence_pad", lambda w: A.silence_padding(w, 16), "list_concat(list_concat(list_transform(range(16), lambda i: 0.0::double), w), list_transform(range(16), lambda i: 0.0::double))")
signal("signal_bit_depth", lambda w: A.bit_depth(w, 8), "list_transform(w, lambda x: round_even(x / p * 127, 0) / 127 * p)")
signal("signal_mu_law", A.mu_law, "list_transform(list_transform(w, lambda x: round_even(sign(x) * ln(1 + 255 * abs(x) / p) / ln(256.0::double) * 127, 0) / 127), lambda y: sign(y) * (exp(abs(y) * ln(256.0::double)) - 1) / 255 * p)")
signal("signal_echo", lambda w: A.add_delayed(w, 8, 0.3), "list_transform(w, lambda x, i: x + 0.3 * case when i > 8 then w[i - 8] else 0 end)")
signal("signal_aec", lambda w: A.add_delayed(w, 6, -0.6), "list_transform(w, lambda x, i: x - 0.6 * case when i > 6 then w[i - 6] else 0 end)")
signal("signal_decimate_alias", lambda w: A.aliased(w, 3), "list_transform(w, lambda x, i: w[1 + (i - 1) // 3 * 3] + (w[least(1 + ((i - 1) // 3 + 1) * 3, 1 + (len(w) - 1) // 3 * 3)] - w[1 + (i - 1) // 3 * 3]) * ((i - 1) % 3) / 3)")
signal("signal_tone", lambda w: A.tone(w, 1000.0, T.RATE, 0.05), "list_transform(w, lambda x, i: x + 0.05 * sin(2 * pi() * 1000 * (i - 1) / 16000))")
signal("signal_device_distortion", A.device_distortion, "list_transform(w, lambda x: tanh(1.5 * x) + 0.1 * tanh(1.5 * x) * tanh(1.5 * x) - list_avg(list_transform(w, lambda z: tanh(1.5 * z) + 0.1 * tanh(1.5 * z) * tanh(1.5 * z))))")
signal("signal_defense_replay", lambda w: A.add_delayed(w, 32, 0.4), "list_transform(w, lambda x, i: x + 0.4 * case when i > 32 then w[i - 32] else 0 end)")
signal("signal_comb", lambda w: A.comb(w, 20, 0.5), "list_transform(w, lambda x, i: x + 0.5 * case when i > 20 then w[i - 20] else 0 end + 0.25 * case when i > 40 then w[i - 40] else 0 end + 0.125 * case when i > 60 then w[i - 60] else 0 end)")

_PAIR = f"with {SHORT}, t as (select utt_id, w, list_transform(w, lambda x: least(greatest(x, -0.15), 0.15) * 0.9) as y from short), c as (select *, list_transform(w, lambda x: x - list_avg(w)) as cw, list_transform(y, lambda x: x - list_avg(y)) as cy from t)"


@query(
    _PAIR + ", e as (select utt_id, w, y, list_sum(list_transform(w, lambda x, i: (x - y[i]) * (x - y[i]))) / len(w) as mse, list_sum(list_transform(w, lambda x: x * x)) / len(w) as pw, list_sum(list_transform(cw, lambda x: x * x)) as xx,"
    " list_sum(list_transform(cy, lambda x: x * x)) as yy, list_sum(list_transform(cw, lambda x, i: x * cy[i])) as xy, list_max(list_transform(w, lambda x: abs(x))) as p, list_sum(list_transform(y, lambda x: x * x)) / len(y) as py from c)"
    " select utt_id, round(10 * log10(pw / mse), 5) as snr_db, round(10 * log10((xy * xy / xx) / (yy - xy * xy / xx)), 5) as si_sdr_db, round(sqrt(mse), 8) as rmse, round(xy / sqrt(xx * yy), 8) as ncc, round(20 * log10(p / sqrt(mse)), 5) as psnr_db, round(sqrt(py) / (sqrt(pw) + 1e-12), 8) as rms_ratio from e"
)
def pair_metrics(spark, sf_dir):
    """SNR, SI-SDR, RMSE, correlation, PSNR and RMS ratio against a clipped copy."""
    s = T.short_signals(spark, sf_dir).withColumn("y", F.transform("waveform", lambda x: F.least(F.greatest(x, F.lit(-0.15)), F.lit(0.15)) * 0.9))
    a, b = F.col("waveform"), F.col("y")
    return s.select(
        "utt_id", F.round(A.snr_db(a, b), 5).alias("snr_db"), F.round(A.si_sdr_db(a, b), 5).alias("si_sdr_db"), F.round(F.sqrt(A.mse(a, b)), 8).alias("rmse"),
        F.round(A.correlation(a, b), 8).alias("ncc"), F.round(A.psnr_db(a, b), 5).alias("psnr_db"), F.round(A.rms_ratio(a, b), 8).alias("rms_ratio"),
    )


_DFT = "list_transform(range(33), lambda k: pow(list_sum(list_transform(w, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(w, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64))), 2))"


@query(
    f"with {SHORT}, d as (select utt_id, {_DFT} as pw from short), b as (select utt_id, unnest(pw) as p, unnest(range(33)) as k from d)"
    " select utt_id, floor(26.81 * k * 250 / (1960.0 + k * 250) - 0.53)::int as band, round(sum(p), 5) as power from b where 26.81 * k * 250 / (1960.0 + k * 250) - 0.53 >= 0 group by 1, 2"
)
def dft_band_power_bark(spark, sf_dir):
    """Power of the Bark bands of each short signal, from a transform by definition."""
    bark = psycho.hz_to_bark(F.col("k") * 250)
    rows = T.short_signals(spark, sf_dir).select("utt_id", F.posexplode(A.dft_power(F.col("waveform"), 64)).alias("k", "p"))
    return rows.where(bark >= 0).groupBy("utt_id", F.floor(bark).cast("int").alias("band")).agg(F.round(F.sum("p"), 5).alias("power"))


@query(
    f"with {SHORT}, d as (select utt_id, {_DFT} as a, list_transform(range(33), lambda k: pow(list_sum(list_transform(w, lambda x, i: round_even(x * 8, 0) / 8 * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(w, lambda x, i: round_even(x * 8, 0) / 8 * sin(2 * pi() * k * (i - 1) / 64))), 2)) as b from short)"
    " select utt_id, round(sqrt(list_sum(list_transform(a, lambda x, i: pow(sqrt(x) - sqrt(b[i]), 2))) / list_sum(a)), 6) as spectral_convergence from d"
)
def spectral_convergence_64(spark, sf_dir):
    """Distance of magnitudes to those of a coarsely rounded copy."""
    s = T.short_signals(spark, sf_dir).withColumn("y", F.transform("waveform", lambda x: F.rint(x * 8) / 8))
    s = s.select("utt_id", A.dft_power(F.col("waveform"), 64).alias("a"), A.dft_power(F.col("y"), 64).alias("b"))
    gap_ = F.aggregate(F.zip_with("a", "b", lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))), F.lit(0.0), lambda t, x: t + x)
    return s.select("utt_id", F.round(F.sqrt(gap_ / A.total(F.col("a"))), 6).alias("spectral_convergence"))


@query(
    "with f as (select unnest(range(0, 8001, 125))::double as hz), k as (select hz, hz / 1000 as k from f) select hz, round(case when hz = 0 then 100 else least(greatest(3.64 * pow(k, -0.8) - 6.5 * exp(-0.6 * (k - 3.3) * (k - 3.3)) + 0.001 * k * k * k * k, -20), 120) end, 6) as quiet_db,"
    " round(26.81 * hz / (1960.0 + hz) - 0.53, 6) as traunmuller, round(13 * atan(0.00076 * hz) + 3.5 * atan((hz / 7500) * (hz / 7500)), 6) as zwicker, round(6 * asinh(hz / 600), 6) as wang, round(21.4 * log10(1 + 0.00437 * hz), 6) as erb from (select hz, case when hz = 0 then 1 else k end as k from k)"
)
def ath_curve(spark, sf_dir):
    """The threshold in quiet and the frequency scales."""
    hz = F.col("hz")
    rows = spark.range(0, 8001, 125).select(F.col("id").cast("double").alias("hz"))
    quiet = F.when(hz == 0, 100.0).otherwise(psycho.absolute_threshold(F.when(hz == 0, 1000.0).otherwise(hz)))
    return rows.select("hz", F.round(quiet, 6).alias("quiet_db"), *(F.round(psycho.hz_to_bark(hz, m), 6).alias(m) for m in ("traunmuller", "zwicker", "wang")), F.round(psycho.erb_rate(hz), 6).alias("erb"))


@query(
    f"with {SHORT}, d as (select utt_id, {_DFT} as pw from short), b as (select utt_id, unnest(pw) as p, unnest(range(33)) as k from d), l as (select utt_id, floor(26.81 * k * 250 / (1960.0 + k * 250) - 0.53)::int as z, 10 * log10(greatest(sum(p), 1e-12)) as lev from b where 26.81 * k * 250 / (1960.0 + k * 250) - 0.53 >= 0 group by 1, 2)"
    " select a.utt_id, a.z as band, round(max(m.lev + case when a.z < m.z then 27 * (a.z - m.z) else -5 * (a.z - m.z) end), 4) as threshold_db from l a join l m on a.utt_id = m.utt_id group by 1, 2"
)
def spreading_threshold(spark, sf_dir):
    """Each Bark band's masked threshold: the largest of all bands' spread levels."""
    bark = psycho.hz_to_bark(F.col("k") * 250)
    rows = T.short_signals(spark, sf_dir).select("utt_id", F.posexplode(A.dft_power(F.col("waveform"), 64)).alias("k", "p")).where(bark >= 0)
    levels = rows.groupBy("utt_id", F.floor(bark).cast("int").alias("z")).agg((10 * F.log10(F.greatest(F.sum("p"), F.lit(1e-12)))).alias("lev"))
    listed = levels.groupBy("utt_id").agg(F.collect_list(F.struct("z", "lev")).alias("all"))
    d = lambda a, m: a - m["z"]
    spread = F.transform("all", lambda a: F.struct(a["z"].alias("band"), F.round(F.array_max(F.transform("all", lambda m: m["lev"] + F.when(d(a["z"], m) < 0, 27.0 * d(a["z"], m)).otherwise(-5.0 * d(a["z"], m)))), 4).alias("threshold_db")))
    return listed.select("utt_id", F.inline(spread))


_LONG = "longs as (select l_suppkey as utt_id, list(l_extendedprice / 50000 - 1 order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as w from lineitem group by 1)"


@query(
    f"with {_LONG}, f as (select utt_id, unnest(range((len(w) - 64) // 32 + 1)) as i, w from longs where len(w) >= 64), g as (select utt_id, i, w[i * 32 + 1 : i * 32 + 64] as v from f)"
    " select utt_id, i::int as frame, round(list_sum(list_transform(v, lambda x: x * x)), 6) as energy, round(list_sum(list_transform(v[1:63], lambda x, j: case when (x < 0) <> (v[j + 1] < 0) then 1.0 else 0.0 end)) / 63, 8) as crossings from g"
)
def frame_features(spark, sf_dir):
    """Energy and zero crossings of overlapping frames of the long signals."""
    f = T.long_signals(spark, sf_dir).select("utt_id", F.posexplode(A.frames(F.col("waveform"), 64, 32)).alias("frame", "v"))
    return f.select("utt_id", "frame", F.round(A.total(F.col("v"), lambda x: x * x), 6).alias("energy"), F.round(A.crossings(F.col("v")), 8).alias("crossings"))


# fact rows.

FACTS = (
    "facts as (select 'c' || l_suppkey as condition_id, case when l_suppkey = 1 then 'original' when l_suppkey % 10 = 3 then 'sweep' when l_suppkey % 10 = 7 then 'control' else 'transform' end as kind, 't' || (l_suppkey % 7) as transform_key,"
    " case when l_suppkey = 1 then 'O' else chr((65 + l_suppkey % 8)::int) end as family, case when l_suppkey <> 1 and l_suppkey % 10 = 3 then (l_suppkey % 40)::double end as margin_db, l_orderkey as utt_id, l_orderkey % 10 as spk,"
    " case when l_quantity = 1 then 'error' else 'ok' end as status, case when l_quantity < 50 then l_quantity end as snr_db, 1.0 - 3 * l_discount - l_tax as stoi_proxy, l_tax * 50 as mbsd,"
    " l_discount * 5 as wer_whisper_tiny, l_discount * 3 as wer_whisper_small, l_tax * 10 as wer_vosk_small_en, l_extendedprice / 100000 as wer_wav2vec2_base from lineitem),"
    " lf as (select condition_id, kind, family, utt_id, spk, status, unnest([{'engine': 'whisper_tiny', 'lineage': 'whisper', 'wer': wer_whisper_tiny}, {'engine': 'whisper_small', 'lineage': 'whisper', 'wer': wer_whisper_small}, {'engine': 'vosk_small_en', 'lineage': 'kaldi', 'wer': wer_vosk_small_en}, {'engine': 'wav2vec2_base', 'lineage': 'ssl', 'wer': wer_wav2vec2_base}], recursive := true) from facts)"
)
DELTAS = (
    FACTS + ", em as (select condition_id, kind, engine, lineage, avg(wer) as m from lf where status = 'ok' group by all), base as (select engine, avg(m) as b from em where kind = 'original' group by 1),"
    " ed as (select condition_id, kind, engine, lineage, m, m - b as delta from em join base using (engine)), xd as (select condition_id, avg(d) as cross_delta_wer from (select condition_id, lineage, avg(delta) as d from ed group by all) group by 1)"
)
SUMMARY = (
    DELTAS + ", cs as (select condition_id, kind, family, count(*) filter (status = 'ok') as n_ok, count(*) filter (status <> 'ok') as n_err, avg(stoi_proxy) filter (status = 'ok') as stoi_mean, stddev_pop(stoi_proxy) filter (status = 'ok') as stoi_std, avg(snr_db) filter (status = 'ok') as snr_mean, avg(mbsd) filter (status = 'ok') as mbsd_mean from facts group by all),"
    " sr as (select condition_id, avg((wer < 0.3)::int) as asr_sr from lf where status = 'ok' group by 1),"
    " sm as (select *, least(greatest(0.6 + 0.4 * stoi_mean, 0), 1) as hsr, least(greatest(0.6 + 0.4 * stoi_mean, 0), 1) - asr_sr as hag from cs left join xd using (condition_id) left join sr using (condition_id))"
)


def _summary(spark, sf_dir):
    return summary.summary(T.facts(spark, sf_dir))


@query(f"with {SUMMARY} select condition_id, kind, family, n_ok, n_err, round(stoi_mean, 6) as stoi_mean, round(stoi_std, 6) as stoi_std, round(snr_mean, 6) as snr_mean, round(mbsd_mean, 6) as mbsd_mean from sm")
def condition_summary(spark, sf_dir):
    s = summary.condition_summary(T.facts(spark, sf_dir))
    return s.select("condition_id", "kind", "family", "n_ok", "n_err", *(F.round(c, 6).alias(c) for c in ("stoi_mean", "stoi_std", "snr_mean", "mbsd_mean")))


@query(f"with {DELTAS} select condition_id, engine, round(m, 6) as wer_mean, round(delta, 6) as delta from ed")
def engine_deltas(spark, sf_dir):
    return summary.engine_deltas(T.facts(spark, sf_dir)).select("condition_id", "engine", F.round("wer_mean", 6).alias("wer_mean"), F.round("delta", 6).alias("delta"))


@query(f"with {DELTAS} select condition_id, round(cross_delta_wer, 6) as cross_delta_wer from xd")
def cross_delta_macro(spark, sf_dir):
    return summary.cross_delta(summary.engine_deltas(T.facts(spark, sf_dir))).select("condition_id", F.round("cross_delta_wer", 6).alias("cross_delta_wer"))


_ROUNDED = ", rs as (select condition_id, kind, family, round(stoi_mean, 6) as stoi_mean, round(cross_delta_wer, 6) as cross_delta_wer, round(hag, 6) as hag, round(mbsd_mean, 6) as mbsd_mean, round(hsr, 6) as hsr from sm)"


def _rounded(spark, sf_dir):
    s = _summary(spark, sf_dir).drop(*RANKS)
    return s.select("condition_id", "kind", "family", *(summary.settled(c).alias(c) for c in ("stoi_mean", "cross_delta_wer", "hag", "mbsd_mean", "hsr")))


@query(f"with {SUMMARY}{_ROUNDED} select condition_id, rank() over (order by stoi_mean desc) as human_rank, rank() over (order by cross_delta_wer desc) as attack_rank, rank() over (order by hag desc) as gap_rank, rank() over (order by mbsd_mean) as quality_rank from rs where kind <> 'original' union all select condition_id, null, null, null, null from rs where kind = 'original'")
def four_ranks(spark, sf_dir):
    """The headline query: conditions ranked in four ways."""
    return summary.four_ranks(_rounded(spark, sf_dir)).select("condition_id", *RANKS)


_FRONT = "select condition_id, not exists (select 1 from rs b where b.condition_id <> a.condition_id and b.stoi_mean >= a.stoi_mean and b.cross_delta_wer >= a.cross_delta_wer{strict}) as pareto from rs a"


@query(f"with {SUMMARY}, rs as (select condition_id, round(stoi_mean, 2) as stoi_mean, round(cross_delta_wer, 2) as cross_delta_wer from sm) " + _FRONT.format(strict=""))
def pareto_drop_ties(spark, sf_dir):
    s = _summary(spark, sf_dir).select("condition_id", F.round("stoi_mean", 2).alias("stoi_mean"), F.round("cross_delta_wer", 2).alias("cross_delta_wer"))
    return summary.pareto(s, ["condition_id"], ["stoi_mean", "cross_delta_wer"], "drop").select("condition_id", "pareto")


@query(f"with {SUMMARY}, rs as (select condition_id, round(stoi_mean, 2) as stoi_mean, round(cross_delta_wer, 2) as cross_delta_wer from sm) " + _FRONT.format(strict=" and (b.stoi_mean > a.stoi_mean or b.cross_delta_wer > a.cross_delta_wer)"))
def pareto_keep_ties(spark, sf_dir):
    s = _summary(spark, sf_dir).select("condition_id", F.round("stoi_mean", 2).alias("stoi_mean"), F.round("cross_delta_wer", 2).alias("cross_delta_wer"))
    return summary.pareto(s, ["condition_id"], ["stoi_mean", "cross_delta_wer"], "keep").select("condition_id", "pareto")


@query(f"with {SUMMARY}{_ROUNDED} select condition_id, not exists (select 1 from rs b where b.stoi_mean >= a.stoi_mean and b.cross_delta_wer >= a.cross_delta_wer and b.hag >= a.hag and (b.stoi_mean > a.stoi_mean or b.cross_delta_wer > a.cross_delta_wer or b.hag > a.hag)) as pareto from rs a")
def pareto_three_objectives(spark, sf_dir):
    return summary.pareto(_rounded(spark, sf_dir), ["condition_id"], ["stoi_mean", "cross_delta_wer", "hag"]).select("condition_id", "pareto")


@query(f"with {SUMMARY}{_ROUNDED} select family, count(*) as n, round(avg(stoi_mean), 5) as stoi, round(avg(cross_delta_wer), 5) as delta, round(case when count(*) > 1 then 1.96 * stddev_samp(cross_delta_wer) / sqrt(count(*)) else 0 end, 5) as half, round(avg(hsr), 5) as hsr, max_by(condition_id, (cross_delta_wer, condition_id)) as strongest from rs where kind <> 'original' group by 1")
def family_summary_ci(spark, sf_dir):
    return summary.family_summary(_rounded(spark, sf_dir).withColumnRenamed("stoi_mean", "stoi_mean")).select("family", "n", *(F.round(c, 5).alias(c) for c in ("stoi", "delta", "half", "hsr")), "strongest")


@query(f"with {SUMMARY}, k as (select distinct condition_id, transform_key, margin_db from facts), j as (select * from sm join k using (condition_id)) select transform_key, margin_db, round(stoi_mean, 6) as stoi_mean, round(cross_delta_wer, 6) as cross_delta_wer from j where kind = 'sweep' union all select transform_key, null, round(avg(stoi_mean), 6), round(avg(cross_delta_wer), 6) from j where kind = 'control' group by 1")
def lambda_sweep_with_control(spark, sf_dir):
    keys = T.facts(spark, sf_dir).select("condition_id", "transform_key", "margin_db").distinct()
    s = summary.sweep_with_control(_summary(spark, sf_dir).join(keys, "condition_id"), ["transform_key"])
    return s.select("transform_key", "margin_db", F.round("stoi_mean", 6).alias("stoi_mean"), F.round("cross_delta_wer", 6).alias("cross_delta_wer"))


@query(f"with {DELTAS} select condition_id, round(max(delta) filter (engine = 'whisper_tiny'), 6) as whisper_tiny, round(max(delta) filter (engine = 'whisper_small'), 6) as whisper_small, round(max(delta) filter (engine = 'vosk_small_en'), 6) as vosk_small_en, round(max(delta) filter (engine = 'wav2vec2_base'), 6) as wav2vec2_base from ed group by 1")
def heatmap_pivot(spark, sf_dir):
    p = summary.engine_deltas(T.facts(spark, sf_dir)).groupBy("condition_id").pivot("engine", list(T.ENGINES)).agg(F.max("delta"))
    return p.select("condition_id", *(F.round(e, 6).alias(e) for e in T.ENGINES))


@query(f"with {FACTS}, r as (select condition_id, kind, family, spk, utt_id, avg((wer_whisper_tiny + wer_whisper_small + wer_vosk_small_en + wer_wav2vec2_base) / 4) as w from facts where status = 'ok' group by all) select a.spk, a.family, round(avg(a.w - b.w), 6) as delta, count(*) as n from r a join r b using (utt_id) where a.kind <> 'original' and b.kind = 'original' group by all")
def speaker_family_pivot(spark, sf_dir):
    return summary.speaker_family(T.facts(spark, sf_dir)).select("spk", "family", F.round("delta", 6).alias("delta"), "n")


_CORR = ["stoi_proxy", "mbsd", "snr_db", "wer_whisper_tiny", "wer_wav2vec2_base"]


@query(f"with {FACTS} " + " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) as n, round(corr({a}, {b}), 6) as r from facts where {a} is not null and {b} is not null" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def metric_corr_pairs(spark, sf_dir):
    return summary.correlations(T.facts(spark, sf_dir), _CORR).select("a", "b", "n", F.round("r", 6).alias("r"))


@query(f"with {SUMMARY}{_ROUNDED}, k as (select stoi_mean as a, cross_delta_wer as b from rs), q as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from k) select count(*) as n, round(corr(ra, rb), 6) as rho from q")
def spearman(spark, sf_dir):
    return summary.spearman(_rounded(spark, sf_dir), "stoi_mean", "cross_delta_wer").select("n", F.round("rho", 6).alias("rho"))


@query(f"with {FACTS} select family, count(snr_db) as n, round(avg(snr_db), 6) as mean, round(stddev_pop(snr_db), 6) as std, round(median(snr_db), 6) as median, min(snr_db) as min, max(snr_db) as max from facts where status = 'ok' group by 1")
def distribution_by_family(spark, sf_dir):
    d = summary.distribution(T.facts(spark, sf_dir).where("status = 'ok'"), ["family"], "snr_db")
    return d.select("family", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "median")), "min", "max")


@query(f"with {SUMMARY}{_ROUNDED} select family, max_by(condition_id, (stoi_mean, -(substr(condition_id, 2)::int))) as best, max(stoi_mean) as value from (select family, condition_id, stoi_mean from rs) group by 1")
def best_condition_argmax(spark, sf_dir):
    return summary.best_of(_rounded(spark, sf_dir).withColumn("k", F.substring("condition_id", 2, 9).cast("int")), ["family"], "stoi_mean", "k").select("family", F.concat(F.lit("c"), "best").alias("best"), "value")


@query(f"with {FACTS}, m as (select family, spk, avg(stoi_proxy) as v from facts where status = 'ok' group by all) select a.family as a, b.family as b, count(*) as n, round(avg(a.v) - avg(b.v), 6) as diff, round(100 * (avg(a.v) - avg(b.v)) / avg(a.v), 5) as relative from m a join m b on a.spk = b.spk and a.family < b.family group by 1, 2")
def experiment_pairs(spark, sf_dir):
    m = T.facts(spark, sf_dir).where("status = 'ok'").groupBy("family", "spk").agg(F.avg("stoi_proxy").alias("v"))
    return summary.experiment_pairs(m, "family", "spk", "v").select("a", "b", "n", F.round("diff", 6).alias("diff"), F.round("relative", 5).alias("relative"))


@query(f"with {FACTS} select family, transform_key, count(*) as n, round(avg(stoi_proxy), 6) as stoi from facts where status = 'ok' group by rollup (family, transform_key)")
def family_rollup(spark, sf_dir):
    return T.facts(spark, sf_dir).where("status = 'ok'").rollup("family", "transform_key").agg(F.count("*").alias("n"), F.round(F.avg("stoi_proxy"), 6).alias("stoi"))


@query(f"with {SUMMARY}{_ROUNDED} select condition_id, stoi_mean, cross_delta_wer from rs where kind <> 'original' order by cross_delta_wer desc, condition_id limit 10")
def top_attacks(spark, sf_dir):
    return _rounded(spark, sf_dir).where("kind <> 'original'").orderBy(F.desc("cross_delta_wer"), "condition_id").limit(10).select("condition_id", "stoi_mean", "cross_delta_wer")


# the gap stack.

_STACK = (
    FACTS + ", q as (select condition_id, avg(stoi_proxy) as stoi, avg((stoi_proxy >= 0.7 and mbsd <= 5 and (snr_db is null or snr_db >= 15))::int) as par from facts where status = 'ok' group by 1), sr as (select condition_id, avg((wer < 0.3)::int) as asr_sr from lf where status = 'ok' group by 1),"
    " cf as (select condition_id, avg((least_ > 0.3)::int) as cmfr from (select condition_id, utt_id, min(wer) as least_ from lf where status = 'ok' group by all) group by 1),"
    " st as (select condition_id, 0.6 + 0.4 * stoi as hsr, asr_sr, cmfr, par from q join sr using (condition_id) join cf using (condition_id)), tt as (select *, hsr - asr_sr as hag, 0.6 + 0.4 * cmfr as trs from st), cc as (select *, 0.5 * (hag + 1) / 2 + 0.3 * trs + 0.2 * par as css from tt)"
)


@query(f"with {_STACK} select condition_id, round(hsr, 4) as hsr, round(asr_sr, 4) as asr_sr, round(hag, 4) as hag, 1.0::double as dsr, 0.0::double as prr, round(cmfr, 4) as cmfr, round(par, 4) as par, round(trs, 4) as trs, round(css, 4) as css, case when css >= 0.7 then 'EXCELLENT' when css >= 0.5 then 'GOOD' when css >= 0.3 then 'MODERATE' when css >= 0.1 then 'WEAK' else 'POOR' end as label from cc")
def hag_stack(spark, sf_dir):
    f = T.facts(spark, sf_dir)
    return gap.evaluate(f, T.long_facts(f))


@query(f"with {FACTS} select condition_id, round(avg((m > 0.5)::int), 6) as cmfr, count(*) as n from (select condition_id, utt_id, min(wer) as m from lf where status = 'ok' group by all) group by 1")
def cmfr(spark, sf_dir):
    return gap.common_failures(T.long_facts(T.facts(spark, sf_dir).where("status = 'ok'")), ["condition_id"]).select("condition_id", F.round("cmfr", 6).alias("cmfr"), "n")


@query("with e as (select event_type, user_id % 5 as g, avg(value) / 500 - 0.1 as deg, avg(value) filter (event_id % 2 = 0) / 500 - 0.1 as sur from events group by all) select event_type, g, round(case when abs(deg) < 1e-6 then case when abs(sur) < 1e-6 then 1 else 0 end else least(greatest(sur / deg, -0.5), 2) end, 6) as dsr, round(least(greatest(1 - case when abs(deg) < 1e-6 then case when abs(sur) < 1e-6 then 1 else 0 end else least(greatest(sur / deg, -0.5), 2) end, 0), 1), 6) as prr from e where sur is not null")
def dsr_prr(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("g")).agg((F.avg("value") / 500 - 0.1).alias("deg"), (F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / 500 - 0.1).alias("sur"))
    d = gap.survival(F.col("deg"), F.col("sur"))
    return e.where("sur is not null").select("event_type", "g", F.round(d, 6).alias("dsr"), F.round(gap.recovery(d), 6).alias("prr"))


# text.

_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"select doc_id, md5({_NORM}) as digest, length({_NORM}) as n from documents")
def normalize_text(spark, sf_dir):
    n = text.normalize(F.col("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


# Python's and Spark's edit distances count code points, DuckDB's bytes: every code point of a pair stands as a byte there.
_CHARS = "regexp_extract_all({}, '(?s).')"
_AS_BYTES = "array_to_string(list_transform({}, lambda x: chr((33 + list_position(v, x))::int)), '')"


@query(f"with d as (select item_id, {_NORM} as r from benchmark), w as (select item_id, r, list_filter(string_split(r, ' '), lambda x: x <> '') as ws from d), h as (select item_id, r, ws, list_transform(ws, lambda x, i: case when i % 2 = 0 then 'mumble' else x end) as hs from w), c as (select *, {_CHARS.format('r')} as a, {_CHARS.format("array_to_string(hs, ' ')")} as b from h where len(ws) > 0), u as (select *, list_distinct(list_concat(a, b)) as v from c) select item_id, round(len(list_filter(hs, lambda x, i: x <> ws[i])) / len(ws), 6) as wer, round(levenshtein({_AS_BYTES.format('a')}, {_AS_BYTES.format('b')}) / len(a), 6) as cer from u")
def mock_error_rates(spark, sf_dir):
    """Word and character error rates of the mock recogniser's hypotheses (words differ one by one)."""
    r = T.table(spark, sf_dir, "benchmark").select("item_id", text.normalize(F.col("text")).alias("r"))
    h = r.withColumn("h", text.mock_transcript(F.col("r"), F.lit(20.0), F.lit(0.0)))
    return h.where("size(filter(split(r, ' '), w -> w <> '')) > 0").select("item_id", F.round(text.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"), F.round(text.cer(F.col("r"), F.col("h")), 6).alias("cer"))


@query()
def wer_token_map(spark, sf_dir):
    """Word error rate between neighbouring turns, whole ones: DuckDB's edit distance tells too few words apart, so brute force tests it."""
    from pyspark.sql import Window

    c = T.dealt(T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").withColumn("t2", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("t2 is not null")
    return c.where(F.size(text.words(F.col("text"))) > 0).select("conv_id", "turn", F.round(text.word_error_rate(F.col("text"), F.col("t2")), 6).alias("wer"))


@query("with p as (select doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) as l, length(regexp_replace(text, '[^\\p{N}]', '', 'g')) as d, trim(text) as t, n_chars / 15.0 as s from documents), n as (select doc_id, s, case when round_even(0.96::double * l + 1.5::double * d, 0) > 0 then round_even(0.96::double * l + 1.5::double * d, 0)::bigint when length(t) > 0 then 1 else 0 end as n from p) select doc_id, n as phonemes, round(n / s::double, 6) as rate from n where s > 0")
def phone_rate(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").where("n_chars > 0")
    return d.select("doc_id", text.phonemes(F.col("text")).alias("phonemes"), F.round(text.phone_rate(F.col("text"), F.col("n_chars") / 15.0), 6).alias("rate"))


@query("select source, sha256(string_agg(doc_id || '|' || source || '|' || md5(text), chr(10) order by doc_id)) as digest from documents group by 1")
def corpus_hash(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "source", F.md5(F.col("text").cast("binary"))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda s: s["line"])
    return d.groupBy("source").agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"))


# selection and joins.


@query("with s as (select source from (select distinct source from documents) order by source limit 7), r as (select doc_id, source, row_number() over (partition by source order by doc_id) as turn from documents where source in (select source from s)) select doc_id, source, turn from r order by turn, source limit 70")
def balanced_selection(spark, sf_dir):
    return select.balanced(T.table(spark, sf_dir, "documents"), "source", "doc_id", 7, 70).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


_U = "('0x' || substr(md5('{key}' || {x}), 1, 8))::bigint / 4294967296.0"


@query(f"with p as (select o_custkey as c, row_number() over (order by {_U.format(key='42|', x='o_custkey')}, o_custkey) as rn, count(*) over () as n from (select distinct o_custkey from orders)), s as (select c, case when rn <= round_even(n * 0.7::double, 0) then 'train' when rn <= round_even(n * 0.7::double, 0) + round_even(n * 0.15::double, 0) then 'valid' else 'test' end as split from p) select split, count(*) as n, count(distinct o_custkey) as speakers, sum(o_orderkey)::bigint as total from orders join s on o_custkey = c group by 1")
def speaker_split(spark, sf_dir):
    s = select.speaker_split(T.table(spark, sf_dir, "orders"), "o_custkey")
    return s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("speakers"), F.sum("o_orderkey").alias("total"))


@query(f"select doc_id, round({_U.format(key='42|', x='doc_id')}, 9) as draw from documents order by {_U.format(key='42|', x='doc_id')}, doc_id limit 25")
def random_selection(spark, sf_dir):
    return select.random_choice(T.table(spark, sf_dir, "documents"), "doc_id", 25).select("doc_id", F.round("draw", 9).alias("draw"))


@query("with g as (select a, f, c, d from (select unnest([1, 2]) as a), (select unnest([3, 5, 8]) as f), (select unnest([0.5, 1.0]) as c), (select unnest(['x', 'y']) as d)) select row_number() over (order by a, c, d, f) - 1 as condition_index, (a * 100 + f)::bigint as code from g")
def grid_cross(spark, sf_dir):
    """All combinations of parameter values, numbered."""
    g = grid.parameter_grid(spark, {"a": [1, 2], "f": [3, 5, 8], "c": [0.5, 1.0], "d": ["x", "y"]})
    p = F.from_json("params_json", "a long, f long, c double, d string")
    return g.select("condition_index", (p["a"] * 100 + p["f"]).alias("code"))


@query("with c as (select unnest(['c1', 'c2', 'c3', 'c4']) as condition_id), d as (select distinct event_type as t, user_id from events where event_id % 3 = 0) select condition_id, user_id from c, (select distinct user_id from events) where not exists (select 1 from d where d.user_id = events.user_id and ('c' || (length(t) % 4 + 1)) = condition_id)".replace("(select distinct user_id from events)", "(select distinct user_id from events) as events"))
def resume_anti(spark, sf_dir):
    """What is left of conditions times users."""
    e = T.table(spark, sf_dir, "events")
    c = spark.createDataFrame([(f"c{i}",) for i in range(1, 5)], "condition_id string")
    done = e.where("event_id % 3 = 0").select(F.concat(F.lit("c"), (F.length("event_type") % 4 + 1)).alias("condition_id"), "user_id")
    return grid.tasks(c, e.select("user_id").distinct(), done, "user_id").select("condition_id", "user_id")


@query("select l_suppkey, l_returnflag, min(l_orderkey) as first_order from lineitem group by 1, 2")
def condition_dedup(spark, sf_dir):
    """The first of rows with the same signature."""
    li = T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey")
    return select.first_of(li, ["l_suppkey", "l_returnflag"], ["l_orderkey"]).select("l_suppkey", "l_returnflag", F.col("l_orderkey").alias("first_order"))


@query("select count(*) as n, round(avg((value > 50 and not (event_id % 7 = 0))::int), 6) as hsr from events")
def batch_hsr(spark, sf_dir):
    h = select.human_success(T.table(spark, sf_dir, "events"), F.col("value") > 50, F.col("event_id") % 7 == 0)
    return h.select("n", F.round("hsr", 6).alias("hsr"))


@query("select user_id, count(*) filter (event_type = 'click') as checks, case when count(*) filter (event_type = 'click') = 0 then true else count(*) filter (event_type = 'click' and value > 50) >= 0.5 * count(*) filter (event_type = 'click') end as passed from events group by 1")
def attention_gate(spark, sf_dir):
    return select.attention_gate(T.table(spark, sf_dir, "events"), "user_id", F.col("value") > 50, F.col("event_type") == "click")


@query(f"with w as (select distinct unnest(['red', 'green', 'blue', 'black', 'white', 'grey', 'pink']) as word), a as (select user_id, min(event_type) as answer from events group by 1), r as (select user_id, answer, word, row_number() over (partition by user_id order by md5('7|' || user_id || '|' || word)) as k from a, w where word <> answer) select user_id, answer, string_agg(word, ',' order by k) as distractors from r where k <= 3 group by all")
def distractor_words(spark, sf_dir):
    a = T.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("answer"))
    w = spark.createDataFrame([(x,) for x in ("red", "green", "blue", "black", "white", "grey", "pink")], "word string")
    return select.distractors(a, w, "user_id", "answer").select("user_id", "answer", F.array_join("distractors", ",").alias("distractors"))


@query("with r as (select conv_id, turn, row_number() over (partition by conv_id order by ('0x' || substr(md5('11|' || conv_id || '|' || turn), 1, 8))::bigint / 4294967296.0, turn) - 1 as r, count(*) over (partition by conv_id) as n from conversations) select conv_id, turn, r + k * n as position from r, range(12) t(k) where r + k * n < 12")
def trial_order(spark, sf_dir):
    return select.trial_order(T.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 12)


@query("select q.user_id, count(*) as n, count(*) filter (q.value > p.v0) as above from events q join (select user_id, avg(value) as v0 from events group by 1) p using (user_id) group by 1")
def paired_join(spark, sf_dir):
    """Rows against their own group's mean."""
    e = T.table(spark, sf_dir, "events")
    m = e.groupBy("user_id").agg(summary.mean(F.col("value")).alias("v0"))
    v, m0 = F.col("value"), F.col("v0")
    above = (v > m0) & (v - m0 > 1e-14 * F.abs(m0))  # a value at the mean isn't above it by what rounding leaves
    return e.join(m, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(above).alias("above"))


# statistics.

_TWO = FACTS + ", t as (select transform_key, count(*) filter (family = 'B' and stoi_proxy is not null) as n_a, count(*) filter (family = 'C') as n_b, avg(stoi_proxy) filter (family = 'B') as ma, avg(stoi_proxy) filter (family = 'C') as mb, var_samp(stoi_proxy) filter (family = 'B') as va, var_samp(stoi_proxy) filter (family = 'C') as vb from facts group by 1 having count(*) filter (family = 'B') > 1 and count(*) filter (family = 'C') > 1)"


def _two(spark, sf_dir):
    t = stats.two_samples(T.facts(spark, sf_dir), ["transform_key"], "family", "B", "C", "stoi_proxy")
    return t.where("n_a > 1 and n_b > 1")


@query(f"with {_TWO} select transform_key, n_a, n_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) as d from t")
def cohen_d(spark, sf_dir):
    return _two(spark, sf_dir).select("transform_key", "n_a", "n_b", F.round(stats.cohen_d(), 6).alias("d"))


@query(f"with {_TWO} select transform_key, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) as t, round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 4) as df from t")
def welch_t(spark, sf_dir):
    t, df = stats.welch()
    return _two(spark, sf_dir).select("transform_key", F.round(t, 6).alias("t"), F.round(df, 4).alias("df"))


@query("with r as (select event_type, user_id % 2 as g, value, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 as k from events), t as (select event_type, sum(c * c * c - c)::double as ties from (select event_type, value, count(*) as c from events group by all) group by 1), s as (select event_type, count(*) filter (g = 0) as n_a, count(*) filter (g = 1) as n_b, sum(k) filter (g = 0) as ra from r group by 1) select event_type, n_a, n_b, round(ra - n_a * (n_a + 1) / 2, 3) as u, round((abs(ra - n_a * (n_a + 1) / 2 - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))), 5) as z from s join t using (event_type)")
def mwu_statistic(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("g", (F.col("user_id") % 2).cast("string"))
    return stats.mann_whitney(e, ["event_type"], "g", "0", "1", "value").select("event_type", "n_a", "n_b", F.round("u", 3).alias("u"), F.round("z", 5).alias("z"))


@query("with d as (select l_returnflag as f, l_discount - l_tax as d from lineitem where l_discount <> l_tax and abs(l_discount - l_tax) > 1e-9), r as (select f, d, rank() over (partition by f order by round(abs(d), 9)) + (count(*) over (partition by f, round(abs(d), 9)) - 1) / 2.0 as k from d) select f as l_returnflag, count(*) as n, sum(case when d > 0 then k else 0 end) as w_plus, sum(case when d < 0 then k else 0 end) as w_minus from r group by 1")
def wilcoxon_w(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_discount") - F.col("l_tax"), 9).alias("a"), F.lit(0.0).alias("b"))
    return stats.wilcoxon(li, ["l_returnflag"], "a", "b").select("l_returnflag", "n", "w_plus", "w_minus")


_P = "p as (select user_id, ('0x' || substr(md5('p|' || user_id), 1, 8))::bigint / 4294967296.0 * ('0x' || substr(md5('q|' || user_id), 1, 8))::bigint / 4294967296.0 * 0.2 as p from (select distinct user_id from events))"


def _p_values(spark, sf_dir):
    u = T.table(spark, sf_dir, "events").select("user_id").distinct()
    return u.withColumn("p", T.uniform("p", F.col("user_id")) * T.uniform("q", F.col("user_id")) * 0.2)


@query(f"with {_P} select user_id, round(p, 9) as p, p < 0.05 / (select count(*) from p) as reject from p")
def bonferroni(spark, sf_dir):
    return stats.bonferroni(_p_values(spark, sf_dir), "p").select("user_id", F.round("p", 9).alias("p"), "reject")


@query(f"with {_P}, r as (select *, row_number() over (order by p, user_id) as k, count(*) over () as n from p), a as (select *, least(1, min(p * n / k) over (order by k desc)) as adjusted, max(case when p <= 0.05 * k / n then k end) over () as top from r) select user_id, round(adjusted, 9) as adjusted, coalesce(k <= top, false) as reject from a")
def bh_adjust(spark, sf_dir):
    return stats.benjamini_hochberg(_p_values(spark, sf_dir), "p", "user_id").select("user_id", F.round("adjusted", 9).alias("adjusted"), "reject")


_POISSON = "[" + ", ".join(repr(x) for x in accumulate(math.exp(-1) / math.factorial(k) for k in range(12))) + "]::double[]"


@query(f"with d as (select event_type, b, value, len(list_filter({_POISSON}, lambda c: ('0x' || substr(md5('42|' || b || '|' || event_id), 1, 8))::bigint / 4294967296.0 >= c)) as w from events, range(100) t(b) where value is not null), m as (select event_type, b, sum(w * value) / sum(w) as m from d group by all) select event_type, round(quantile_cont(m, 0.025), 5) as low, round(quantile_cont(m, 0.975), 5) as high from m group by 1")
def bootstrap_ci_hash(spark, sf_dir):
    """Intervals of the mean from all events."""
    e = T.table(spark, sf_dir, "events")
    return stats.poisson_bootstrap(e, ["event_type"], "event_id", "value", 100).select("event_type", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("with d as (select user_id, avg(value) filter (event_type = 'click') - avg(value) filter (event_type = 'view') as d from events group by 1), f as (select * from d where d is not null), s as (select abs(avg(d)) as o, count(*) as n from f), b as (select b, abs(avg(case when ('0x' || substr(md5('42|' || b || '|' || user_id), 1, 8))::bigint / 4294967296.0 < 0.5 then -d else d end)) as m from f, range(200) t(b) group by 1) select n, round(avg((m >= o - 1e-12)::int), 6) as p from b, s group by 1")
def permutation_hash(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    m = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    d = e.groupBy("user_id").agg((m("click") - m("view")).alias("d")).where("d is not null").withColumn("all", F.lit(1))
    return stats.permutation(d, ["all"], "user_id", "d").select("n", F.round("p", 6).alias("p"))


_LADDER = "ladder as (select event_type as condition, user_id as utt_id, event_id % 3 as model, case event_id % 3 when 0 then 39.0::double when 1 then 74.0 else 244.0 end as params_m, abs(value) / 500 * pow(case event_id % 3 when 0 then 39.0::double when 1 then 74.0 else 244.0 end / 39, -0.5) + 0.001 as wer from events), pts as (select condition, model, params_m, count(*) as n, avg(wer) as w, avg((wer <= 0.3)::int) as asr_sr from ladder group by all)"


@query(f"with {_LADDER} select p.condition, p.model, p.n, round(p.w, 6) as wer, round(p.w - b.w, 6) as delta, round(p.asr_sr, 6) as asr_sr from pts p left join pts b on b.condition = 'view' and b.model = p.model")
def capacity_points(spark, sf_dir):
    c = stats.capacity_points(T.ladder(spark, sf_dir), "view")
    return c.select("condition", "model", "n", *(F.round(x, 6).alias(x) for x in ("wer", "delta", "asr_sr")))


_FIT = _LADDER + ", fit as (select condition, count(*) as n, exp(regr_intercept(ln(w), ln(params_m))) as a, -regr_slope(ln(w), ln(params_m)) as b, regr_r2(ln(w), ln(params_m)) as r2 from pts group by 1)"


@query(f"with {_FIT} select condition, n, round(a, 5) as a, round(b, 5) as b, round(r2, 5) as r2 from fit")
def power_law_fit(spark, sf_dir):
    f = stats.power_law(stats.capacity_points(T.ladder(spark, sf_dir), "view"), ["condition"], "params_m", "wer")
    return f.select("condition", "n", *(F.round(c, 5).alias(c) for c in ("a", "b", "r2")))


@query(f"with {_FIT}, c as (select condition, exp((ln(a) - ln(0.01::double)) / b) as c from fit) select condition, round(c, 2) as capacity, round(case when c <= 244 then 0 else 8 * log2(c / 244) end, 4) as months from c")
def break_capacity_months(spark, sf_dir):
    f = stats.power_law(stats.capacity_points(T.ladder(spark, sf_dir), "view"), ["condition"], "params_m", "wer")
    c = stats.break_capacity(F.col("a"), F.col("b"), 0.01)
    return f.select("condition", F.round(c, 2).alias("capacity"), F.round(stats.months(c, 244.0, 8.0), 4).alias("months"))


@query("with d as (select event_type, user_id, avg(value) as v from events group by all), x as (select event_type, v, b, ('0x' || substr(md5('42|' || b || '|' || user_id), 1, 8))::bigint / 4294967296.0 as u from d, range(50) t(b)), w as (select *, case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 else 4 end as w from x), m as (select b, event_type, round(sum(w * v) / sum(w), 9) as m from w group by all), r as (select event_type, rank() over (partition by b order by m desc) as r from m) select event_type, quantile_cont(r, 0.05)::double as low, quantile_cont(r, 0.5)::double as mid, quantile_cont(r, 0.95)::double as high from r group by 1")
def rank_stability_hash(spark, sf_dir):
    d = T.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return stats.rank_stability(d, "event_type", "user_id", "v")


_WEIGHT = "case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 else 4 end"


@query(f"with {_LADDER}, x as (select *, ('0x' || substr(md5('42|' || b || '|' || utt_id), 1, 8))::bigint / 4294967296.0 as u from ladder, range(50) t(b)), m as (select condition, b, model, params_m, sum({_WEIGHT} * wer) / sum({_WEIGHT}) as m from x group by all), f as (select condition, b as draw, exp(regr_intercept(ln(m), ln(params_m))) as a, -regr_slope(ln(m), ln(params_m)) as b from m group by all), c as (select *, exp((ln(a) - ln(0.01::double)) / b) as c from f) select condition, round(quantile_cont(b, 0.025), 5) as b_low, round(quantile_cont(b, 0.975), 5) as b_high, round(quantile_cont(c, 0.025), 1) as c_low, round(quantile_cont(c, 0.975), 1) as c_high from c group by 1")
def fit_intervals_hash(spark, sf_dir):
    """Intervals of the scaling fit from utterances drawn anew."""
    f = stats.fit_intervals(T.ladder(spark, sf_dir), 0.01)
    return f.select("condition", F.round("b_low", 5).alias("b_low"), F.round("b_high", 5).alias("b_high"), F.round("c_low", 1).alias("c_low"), F.round("c_high", 1).alias("c_high"))


@query(f"with {SUMMARY}{_ROUNDED} select a.condition_id, count(b.condition_id) as dominated_by from rs a left join rs b on b.stoi_mean >= a.stoi_mean and b.cross_delta_wer >= a.cross_delta_wer and (b.stoi_mean > a.stoi_mean or b.cross_delta_wer > a.cross_delta_wer) group by 1")
def dominance_rank(spark, sf_dir):
    return summary.dominance_rank(_rounded(spark, sf_dir), "condition_id", ["stoi_mean", "cross_delta_wer"])


@query(f"with {_TWO}" + " select transform_key, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) * case when n_a + n_b - 2 > 150 then 1 else 1 - 3 / (4.0::double * (n_a + n_b - 2)) - 7 / (32.0::double * pow(n_a + n_b - 2, 2)) + 9 / (128.0::double * pow(n_a + n_b - 2, 3)) end, 6) as g from t")
def hedges_g(spark, sf_dir):
    return _two(spark, sf_dir).select("transform_key", F.round(stats.hedges_g(stats.cohen_d()), 6).alias("g"))


@query()
def p_values(spark, sf_dir):
    """p-values of Welch's t and the rank-sum score (incomplete beta and normal functions aren't in SQL)."""
    t, df = stats.welch()
    return _two(spark, sf_dir).select("transform_key", F.round(stats.t_p_value(t, df), 6).alias("p_welch"), F.round(stats.z_p_value(t), 6).alias("p_normal"))


@query("with g as (select event_type, count(*) as n, count(*) filter (value > 50) as s from events group by 1) select event_type, n, s, round((s / n + 3.8416 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as low, round((s / n + 3.8416 / (2 * n) + 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as high from g")
def wilson_ci(spark, sf_dir):
    g = T.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("s"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return g.select("event_type", "n", "s", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def rate_limit(spark, sf_dir):
    """Requests accepted within a limit a client and week; accepted ones only count, so SQL windows can't say it."""
    e = T.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return select.rate_limited(e, "user_id", "ts", 3, 7 * 24 * 3600)


@query(f"with {FACTS}, u as (select condition_id, utt_id, avg(m) as w from (select condition_id, utt_id, lineage, avg(wer) as m from lf where status = 'ok' group by all) group by all), d as (select a.condition_id, a.w - b.w as d from u a join u b using (utt_id) where a.condition_id <> 'c1' and b.condition_id = 'c1') select condition_id, count(*) as n, round(avg(d), 6) as effect, round(1.96 * stddev_samp(d) / sqrt(count(*)), 6) as half from d group by 1 having count(*) >= 5 order by effect desc, condition_id limit 20")
def forest_effects(spark, sf_dir):
    """The largest paired effects with their intervals."""
    f = T.long_facts(T.facts(spark, sf_dir).where("status = 'ok'"))
    u = f.groupBy("condition_id", "utt_id", "lineage").agg(F.avg("wer").alias("m")).groupBy("condition_id", "utt_id").agg(F.avg("m").alias("w"))
    base = u.where(F.col("condition_id") == T.ORIGINAL).select("utt_id", F.col("w").alias("w0"))
    d = u.where(F.col("condition_id") != T.ORIGINAL).join(base, "utt_id").withColumn("d", F.col("w") - F.col("w0"))
    e = d.groupBy("condition_id").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("effect"), F.round(1.96 * F.stddev_samp("d") / F.sqrt(F.count("*")), 6).alias("half"))
    return e.where("n >= 5").orderBy(F.desc("effect"), "condition_id").limit(20)


@query(f"with {FACTS} select transform_key, margin_db, round(avg(w), 6) as wer, round(avg((w <= 0.3)::int), 6) as asr_sr, round(0.6 + 0.4 * avg(stoi_proxy), 6) as hsr from (select transform_key, margin_db, stoi_proxy, unnest([wer_whisper_tiny, wer_whisper_small, wer_vosk_small_en, wer_wav2vec2_base]) as w from facts where kind = 'sweep' and status = 'ok') group by 1, 2")
def sweep_pooled(spark, sf_dir):
    """Error and success of all engines together, by key and margin."""
    f = T.facts(spark, sf_dir).where("kind = 'sweep' and status = 'ok'")
    w = f.select("transform_key", "margin_db", "stoi_proxy", F.explode(F.array(*(f"wer_{e}" for e in T.ENGINES))).alias("w"))
    return w.groupBy("transform_key", "margin_db").agg(F.round(F.avg("w"), 6).alias("wer"), F.round(gap.success(F.col("w"), strict=False), 6).alias("asr_sr"), F.round(gap.hsr_proxy(F.avg("stoi_proxy")), 6).alias("hsr"))


@query(f"with {FACTS}, a as (select family, count(distinct condition_id) as run from facts group by 1), r as (select unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H']) as family, unnest([11, 16, 11, 24, 20, 9, 10, 18])::bigint as registered) select coalesce(a.family, r.family) as family, coalesce(registered, 0) as registered, coalesce(run, 0) as run from a full join r on a.family = r.family")
def registry_against_runs(spark, sf_dir):
    """Registered transforms and conditions run, by family."""
    runs = T.facts(spark, sf_dir).groupBy("family").agg(F.countDistinct("condition_id").alias("run"))
    counts = grid.family_counts(spark).select("family", F.col("n").alias("registered"))
    return counts.join(runs, "family", "full").select("family", F.coalesce("registered", F.lit(0)).cast("long").alias("registered"), F.coalesce("run", F.lit(0)).cast("long").alias("run"))


@query("select user_id, strftime(ts, '%Y-%m-%d %H') as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_hourly(spark, sf_dir):
    """Tumbling windows of an hour."""
    e = T.table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("with l as (select doc_id, quality, n_chars, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as rn, rank() over (order by quality) + (count(*) over (partition by quality) - 1) / 2.0 as rq from labels join documents using (doc_id)) select count(*) as n, round(corr(quality, n_chars), 6) as pearson, round(corr(rq, rn), 6) as spearman from l")
def rating_correlation(spark, sf_dir):
    """Ratings against a proxy: Pearson and Spearman."""
    j = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents"), "doc_id").select("quality", "n_chars")
    ranked = summary.rank_pairs(j, "quality", "n_chars")
    return ranked.agg(F.sum("_n").alias("n"), F.round(summary.weighted_corr("quality", "n_chars", "_n"), 6).alias("pearson"), F.round(summary.weighted_corr("ra", "rb", "_n"), 6).alias("spearman"))


@query("select source, count(*) as n, count(distinct lang) as languages, round(avg((quality = 1)::int), 6) as good from documents left join labels using (doc_id) group by 1")
def ratings_by_source(spark, sf_dir):
    j = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("languages"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("good"))


@query("with r as (select event_type, user_id, value, row_number() over (partition by user_id order by ts, event_id) as k, lag(value) over (partition by user_id order by ts, event_id) as before, avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as recent, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as running, event_id from events) select event_id, k, round(value - before, 6) as step, round(recent, 6) as recent, round(running, 4) as running from r")
def running_windows(spark, sf_dir):
    """Onset differences, trailing means and running sums of each user's series."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return T.table(spark, sf_dir, "events").select(
        "event_id", F.row_number().over(w).cast("long").alias("k"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"),
        F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("recent"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"),
    )


# what SQL can't express: rows are checked by unit tests.


def _family(letter: str) -> Query:
    def run(spark, sf_dir):
        from .functions import registry
        from .plans import benchmark

        rows = benchmark.benchmark(spark, T.long_signals(spark, sf_dir), registry.keys(letter), sweep=False)
        return rows.groupBy("transform_key").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.round(F.avg("stoi_proxy"), 4).alias("stoi"), F.round(F.avg("snr_db"), 3).alias("snr"), F.round(F.avg("mbsd"), 4).alias("mbsd"))

    run.__doc__ = f"All transforms of family {letter} over the long signals: metric means."
    return run


for _letter in "ABCDEFGH":
    QUERIES[f"family_{_letter.lower()}_smoke"] = _family(_letter)


@query()
def defense_matrix(spark, sf_dir):
    """Each defence against a strong transform: likeness before and after."""
    from .plans import benchmark

    rows = benchmark.defended(T.long_signals(spark, sf_dir), "novel.captcha_optimal")
    return rows.groupBy("defense").agg(F.count("*").alias("n"), F.round(F.avg("before"), 4).alias("before"), F.round(F.avg("after"), 4).alias("after"))


@query()
def spectral_metrics(spark, sf_dir):
    """All 13 metrics of the long signals against a masked-noise copy."""
    from .plans import benchmark

    return benchmark.benchmark(spark, T.long_signals(spark, sf_dir), ["psychoacoustic.masked_noise"], sweep=False)


@query()
def word_confusion(spark, sf_dir):
    """Aligned words of neighbouring turns that differ."""
    from pyspark.sql import Window

    c = T.dealt(T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").withColumn("t2", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("t2 is not null")
    return text.confusions(c, "text", "t2")


@query()
def detailed_wer(spark, sf_dir):
    """Hits, substitutions, deletions and insertions of the mock recogniser."""
    r = T.table(spark, sf_dir, "benchmark").select("item_id", text.normalize(F.col("text")).alias("r"))
    r = r.withColumn("h", text.mock_transcript(F.col("r"), F.lit(20.0), F.lit(0.0)))
    return text.detailed(r, "r", "h").select("item_id", "wer", "hit_rate", "sub_rate", "del_rate", "ins_rate")


@query()
def transform_catalog(spark, sf_dir):
    return grid.catalog(spark)
