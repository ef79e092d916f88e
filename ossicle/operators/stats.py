"""Effect sizes, tests, corrections, resampling and scaling fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import ROWS, first_digits
from ..functions.kernels import normal_cdf, normal_ppf, t_two_sided
from ..sources.tables import dealt, hashed, uniform
from .summary import value_ranks

def t_p_value(t: Column, df: Column) -> Column:
    return F.pandas_udf(lambda t, df: pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)]), "double")(t, df)


def z_p_value(z: Column) -> Column:
    return F.pandas_udf(lambda z: pd.Series([2 * normal_cdf(-abs(v)) if pd.notna(v) else None for v in z]), "double")(z)


def two_samples(frame: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Moments of two groups side by side: n, mean and variance of each."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    return frame.groupBy(*by).agg(
        *(f(pick(g)).alias(f"{n}_{s}") for g, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var")))
    )


def cohen_d() -> Column:
    n = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.greatest(n, F.lit(1)))
    return F.when((F.col("n_a") < 2) | (F.col("n_b") < 2) | (pooled < 1e-15), 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / F.greatest(pooled, F.lit(1e-300)))


def hedges_g(d: Column) -> Column:
    """d times gamma(m/2) / (sqrt(m/2) gamma((m-1)/2)), the gamma ratio by its asymptotic series; d beyond m = 150."""
    m = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    j = 1 - 3 / (4 * m) - 7 / (32 * m * m) + 9 / (128 * m * m * m)
    return F.when(m > 150, d).otherwise(d * j)


def welch() -> tuple[Column, Column]:
    """(t, degrees of freedom)."""
    a, b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    few = (F.col("n_a") < 2) | (F.col("n_b") < 2) | (a + b < 1e-300)
    t = F.when(few, 0.0).otherwise((F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.greatest(a + b, F.lit(1e-300))))
    df = F.when(few, 1.0).otherwise((a + b) * (a + b) / F.greatest(a * a / F.greatest(F.col("n_a") - 1, F.lit(1)) + b * b / F.greatest(F.col("n_b") - 1, F.lit(1)), F.lit(1e-300)))
    return t, df


def mann_whitney(frame: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """U of the first group and its normal score with tie and continuity corrections."""
    rows = frame.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_t"), F.count_if(F.col(group) == a).alias("_a"))
    t = F.col("_t").cast("double")
    sums = value_ranks(counts, value, "_t", by).groupBy(*by).agg(
        F.sum("_a").alias("n_a"), F.sum(F.col("_t") - F.col("_a")).alias("n_b"), F.sum(F.when(F.col("_a") > 0, F.col("_a") * F.col("_rank"))).alias("_ra"), F.sum(t * t * t - t).alias("_ties"),
    )
    n, na, nb = F.col("n_a") + F.col("n_b"), F.col("n_a"), F.col("n_b")
    u = F.col("_ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("_ties") / (n * F.greatest(n - 1, F.lit(1)))))
    z = F.when(sd > 0, (F.abs(u - na * nb / 2) - 0.5) / sd)
    return sums.select(*by, "n_a", "n_b", u.alias("u"), z.alias("z"))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Signed ranks of the differences that aren't zero: the sums of both signs and the lesser."""
    d = F.col(a) - F.col(b)
    rows = pairs.select(*by, d.alias("_d"), F.abs(d).alias("_abs")).where("_d <> 0")
    counts = rows.groupBy(*by, "_abs").agg(F.count("*").alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    plus, minus = F.sum(F.col("_up") * F.col("_rank")), F.sum((F.col("_n") - F.col("_up")) * F.col("_rank"))
    return value_ranks(counts, "_abs", "_n", by).groupBy(*by).agg(F.sum("_n").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("w"))


def bonferroni(frame: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    return frame.withColumn("reject", F.col(p) < alpha / F.count("*").over(Window.partitionBy()))


def benjamini_hochberg(frame: DataFrame, p: str, key: str, q: float = 0.05) -> DataFrame:
    """frame with adjusted and reject; a p-value table is small."""
    ordered, n = Window.orderBy(p, key), F.count("*").over(Window.partitionBy())
    rn = F.row_number().over(ordered)
    ranked = frame.withColumn("_k", rn).withColumn("_raw", F.col(p) * n / rn).withColumn("_ok", F.col(p) <= q * rn / n)
    adjusted = F.least(F.lit(1.0), F.min("_raw").over(Window.orderBy(F.desc("_k"))))
    top = F.max(F.when(F.col("_ok"), F.col("_k"))).over(Window.partitionBy())
    return ranked.withColumn("adjusted", adjusted).withColumn("reject", F.coalesce(F.col("_k") <= top, F.lit(False))).drop("_k", "_raw", "_ok")


def bootstrap(frame: DataFrame, by: list[str], order: str, value: str, draws: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile intervals of the mean: each draw picks n of a group's n values by hashed places."""
    listed = frame.where(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    drawn = listed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col("b").cast("string"))
    pick = lambda i: F.element_at("v", F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", key, i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0 * F.size("v")).cast("int") + 1)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("v") - 1), pick), F.lit(0.0), lambda s, x: s + x)
    means = drawn.select(*by, (total / F.size("v")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def poisson_bootstrap(frame: DataFrame, by: list[str], unit: str, value: str, draws: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile intervals of the mean of all rows: a row is in a draw as often as a Poisson number from its unit's hash says.

    No group is held together, and no row is made for each draw.  The chances go on until a hash of 32 bits can't tell them apart.
    """
    below, chance, limits = 0.0, math.exp(-1), []
    for k in range(1, 13):
        below, chance = below + chance, chance / k
        limits.append(below)
    marks = np.array([m for m in (math.ceil(x * 2**32) for x in limits) if m < 2**32], np.uint32)
    rows = dealt(frame.where(F.col(value).isNotNull()).select(*by, unit, F.col(value).cast("double").alias(value)), unit)

    def few(most: int) -> Iterator[range]:
        """Runs of draws whose numbers have equally many digits."""
        at = 0
        while at < draws:
            end = min(at + most, draws, 10 ** len(str(at)))
            yield range(at, end)
            at = end

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each batch, its groups' weighted sums and weights by draw: as many rows as groups and draws, whatever the rows."""
        for part in parts:
            groups = part.groupby(by, dropna=False, sort=False)
            code, n = groups.ngroup().to_numpy(), groups.ngroups
            own = part.loc[~pd.Series(code, index=part.index).duplicated(), by]
            texts, lengths = [], {}
            for k, u in enumerate(part["_unit"].tolist()):
                texts.append(b"" if u is None else f"|{u}".encode())
                lengths.setdefault(len(texts[-1]), []).append(k)
            v, total, weight = part[value].to_numpy(), np.zeros((draws, n)), np.zeros((draws, n))
            for size, places in lengths.items():
                for at in range(0, len(places), ROWS):
                    some = np.array(places[at : at + ROWS])
                    tails = np.frombuffer(b"".join([texts[k] for k in some]), np.uint8).reshape(len(some), size)
                    for bs in few(max(1, ROWS // len(some))):  # several draws of a few rows at once
                        heads = np.frombuffer("".join(map(str, bs)).encode(), np.uint8).reshape(len(bs), -1)
                        both = np.concatenate((np.repeat(heads, len(some), axis=0), np.tile(tails, (len(bs), 1))), axis=1)
                        w = np.searchsorted(marks, first_digits(f"{seed}|".encode(), both), side="right").reshape(len(bs), -1)
                        for b, one in zip(bs, w):
                            total[b] += np.bincount(code[some], one * v[some], n)
                            weight[b] += np.bincount(code[some], one, n)
            out = own.loc[own.index.repeat(draws)].reset_index(drop=True)
            yield out.assign(_b=np.tile(np.arange(draws), n), _s=total.T.ravel(), _w=weight.T.ravel())

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    drawn = rows.select(*by, value, F.col(unit).cast("string").alias("_unit")).mapInPandas(sums, f"{kinds}, _b int, _s double, _w double")
    means = drawn.groupBy(*by, "_b").agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def bca(values: list[float], draws: list[float], alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of a mean from its bootstrap draws."""
    n, mean = len(values), sum(values) / len(values)
    jack = [(n * mean - v) / (n - 1) for v in values]
    centre = sum(jack) / n
    num, den = sum((centre - j) ** 3 for j in jack), sum((centre - j) ** 2 for j in jack)
    a = num / (6 * den**1.5) if den > 0 else 0.0
    share = sum(d < mean for d in draws) / len(draws)
    z0 = normal_ppf(min(max(share, 0.5 / len(draws)), 1 - 0.5 / len(draws)))
    ordered, out = sorted(draws), []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal_ppf(q)
        at = normal_cdf(z0 + z / (1 - a * z)) * (len(ordered) - 1)
        k = min(int(at), len(ordered) - 2)
        out.append(ordered[k] + (at - k) * (ordered[k + 1] - ordered[k]))
    return out[0], out[1]


def permutation(pairs: DataFrame, by: list[str], key: str, diff: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """Paired sign flips: the share of draws whose mean is as far from zero as the observed one."""
    flips = pairs.select(*by, key, diff, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    sign = F.when(uniform(seed, F.col("b"), F.col(key)) < 0.5, -1.0).otherwise(1.0)
    drawn = flips.groupBy(*by, "b").agg(F.abs(F.avg(F.col(diff) * sign)).alias("m"))
    seen = pairs.groupBy(*by).agg(F.abs(F.avg(diff)).alias("observed"), F.count("*").alias("n"))
    return drawn.join(seen, by).groupBy(*by).agg(F.max("n").alias("n"), F.avg((F.col("m") >= F.col("observed") - 1e-12).cast("int")).alias("p"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def power_law(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y = a x^-b by least squares of logarithms over positive values; r2 is 1 without variance."""
    full = points.where((F.col(x) > 0) & (F.col(y) > 0))
    lx, ly = F.ln(x), F.ln(y)
    fit = full.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("i"), F.regr_r2(ly, lx).alias("r2"))
    return fit.where("s is not null").select(*by, "n", F.exp("i").alias("a"), (-F.col("s")).alias("b"), F.coalesce("r2", F.lit(1.0)).alias("r2"))


def break_capacity(a: Column, b: Column, w: float) -> Column:
    """Where a x^-b falls to w; null if it never does or only beyond 10^12."""
    c = F.exp(F.when((a > 0) & (b > 0), (F.ln(F.when(a > 0, a).otherwise(1.0)) - math.log(w)) / F.when(b > 0, b).otherwise(1.0)))
    return F.when(c <= 1e12, c)


def months(capacity: Column, reference: float, doubling: float) -> Column:
    return F.when(capacity <= reference, 0.0).when(capacity.isNotNull(), doubling * F.log2(capacity / reference))


def capacity_points(ladder: DataFrame, original: str) -> DataFrame:
    """By condition and model: n, mean error, delta against the original and success rate at the limit."""
    means = ladder.groupBy("condition", "model", "params_m").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"), F.avg((F.col("wer") <= 0.3).cast("int")).alias("asr_sr"))
    base = means.where(F.col("condition") == original).select("model", F.col("wer").alias("base"))
    return means.join(base, "model", "left").select("condition", "model", "params_m", "n", "wer", (F.col("wer") - F.col("base")).alias("delta"), "asr_sr")


def reached(h: str, limits: list[float]) -> Column:
    """How many limits the draw of a hash (see :func:`uniform`) reaches: hexadecimal digits are compared, no number is made."""
    marks = [math.ceil(x * 2**32) for x in limits]
    return sum(((F.col(h) >= f"{m:08x}").cast("int") for m in marks if m < 2**32), F.lit(0))


def poisson_draws(frame: DataFrame, draw: str, weight: str, unit: str, draws: int, seed: int) -> DataFrame:
    """A row of frame for each draw, with how often its unit is in it: 0, 1, 2 ... by Poisson chances from one hash, so that draws need no collecting."""
    drawn = frame.withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_h", hashed(seed, F.col(draw), F.col(unit)))
    return drawn.withColumn(weight, reached("_h", [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462])).drop("_h")


def fit_intervals(ladder: DataFrame, w_break: float, draws: int = 50, seed: int = 42) -> DataFrame:
    """(condition, b_low, b_high, c_low, c_high): 95% intervals of the exponent and the break capacity.

    The utterances are drawn anew, the same ones for every model, and each draw is fitted.
    """
    units = dealt(ladder, "utt_id").groupBy("condition", "model", "params_m", "utt_id").agg(F.count("*").alias("_n"), F.sum("wer").alias("_s"))  # a unit's rows are drawn together
    drawn = poisson_draws(units, "_b", "_w", "utt_id", draws, seed)
    means = drawn.groupBy("condition", "_b", "model", "params_m").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("m"))
    fits = power_law(means, ["condition", "_b"], "params_m", "m").withColumn("_c", break_capacity(F.col("a"), F.col("b"), w_break))
    cuts = [(c, q, n) for c, p in (("b", "b"), ("_c", "c")) for q, n in ((0.025, f"{p}_low"), (0.975, f"{p}_high"))]
    return fits.groupBy("condition").agg(*(F.percentile(c, F.lit(q)).alias(n) for c, q, n in cuts))


def rank_stability(values: DataFrame, item: str, unit: str, value: str, draws: int = 50, seed: int = 42) -> DataFrame:
    """(item, low, mid, high): 5, 50 and 95% of an item's rank when the units are drawn anew.

    A unit is in a draw as often as :func:`poisson_draws` says.
    """
    drawn = poisson_draws(values, "b", "w", unit, draws, seed)
    means = drawn.groupBy("b", item).agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    ranked = means.withColumn("r", F.rank().over(Window.partitionBy("b").orderBy(F.desc_nulls_last(F.round("m", 9)))))
    return ranked.groupBy(item).agg(*(F.percentile("r", F.lit(q)).alias(n) for q, n in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))))
