"""Reductions of fact rows: summaries, deltas against the original, ranks, fronts and pivots."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ENGINES, long_facts


def mean(c: Column) -> Column:
    """The mean, the same in whatever order the rows come: coarse parts and rests are summed on their own.

    Parts in steps of 2^-10 and 2^-36 and what is left add up without rounding for values of common sizes.
    """
    rest = lambda v, steps: F.when(F.abs(v) < float("inf"), v - F.rint(v * steps) / steps).otherwise(0.0)
    low = rest(c, 2.0**10)
    parts = [F.rint(c * 2.0**10) / 2.0**10, F.rint(low * 2.0**36) / 2.0**36, rest(low, 2.0**36)]
    a, b, d = (F.sum(F.when(c.isNotNull(), p)) for p in parts)
    return F.try_divide(a + (b + d), F.count(c))


def settled(c: Column | str, digits: int = 6) -> Column:
    """Rounded, halves up: digits that differ with the order of a sum go first, so that they don't settle a half."""
    return F.round(F.round(c, digits + 6), digits)


def condition_summary(facts: DataFrame) -> DataFrame:
    """A row for each condition, also for those with errors only; deviations divide by n."""
    ok = F.col("status") == "ok"
    when = lambda c: F.when(ok, F.col(c))
    return facts.groupBy("condition_id", "kind", "family").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_err"), F.avg(when("stoi_proxy")).alias("stoi_mean"), F.stddev_pop(when("stoi_proxy")).alias("stoi_std"),
        F.avg(when("snr_db")).alias("snr_mean"), F.avg(when("mbsd")).alias("mbsd_mean"), *(F.avg(when(f"wer_{e}")).alias(f"wer_{e}_mean") for e in ENGINES),
    )


def engine_deltas(facts: DataFrame) -> DataFrame:
    """(condition_id, engine, lineage, wer_mean, delta) against the original's mean of each engine."""
    means = long_facts(facts.where("status = 'ok'")).groupBy("condition_id", "kind", "engine", "lineage").agg(F.avg("wer").alias("wer_mean"))
    base = means.where("kind = 'original'").groupBy("engine").agg(F.avg("wer_mean").alias("base"))  # a row for each engine
    return means.join(F.broadcast(base), "engine", "left").select("condition_id", "kind", "engine", "lineage", "wer_mean", (F.col("wer_mean") - F.col("base")).alias("delta"))


def cross_delta(deltas: DataFrame) -> DataFrame:
    """Mean over lineages of the mean over their engines."""
    by_lineage = deltas.where("delta is not null").groupBy("condition_id", "lineage").agg(F.avg("delta").alias("d"))
    return by_lineage.groupBy("condition_id").agg(F.avg("d").alias("cross_delta_wer"))


def summary(facts: DataFrame) -> DataFrame:
    """The condition summary with cross deltas, success rates, gap and four ranks."""
    base = condition_summary(facts).join(cross_delta(engine_deltas(facts)), "condition_id", "left")
    success = long_facts(facts.where("status = 'ok'")).groupBy("condition_id").agg(F.avg((F.col("wer") < 0.3).cast("int")).alias("asr_sr"))
    base = base.join(success, "condition_id", "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = base.withColumn("hsr", clip(0.6 + 0.4 * F.col("stoi_mean"))).withColumn("hag", clip(F.col("hsr")) - clip(F.col("asr_sr")))
    return four_ranks(base)


def min_rank(value: Column, of: Column) -> Column:
    """Least rank by an order, null where the value is."""
    return F.when(of.isNotNull(), F.rank().over(Window.orderBy(value))).cast("long")


def four_ranks(frame: DataFrame) -> DataFrame:
    """Ranks of a summary's rows (as few as there are conditions), the original left out."""
    rest, original = frame.where("kind <> 'original'"), frame.where("kind = 'original'")
    ranks = {
        "human_rank": ("stoi_mean", False), "attack_rank": ("cross_delta_wer", False), "gap_rank": ("hag", False), "quality_rank": ("mbsd_mean", True),
    }
    for name, (c, up) in ranks.items():
        rest = rest.withColumn(name, min_rank(F.asc_nulls_last(c) if up else F.desc_nulls_last(c), F.col(c)))
    return rest.unionByName(original.withColumns({n: F.lit(None).cast("long") for n in ranks}))


def pareto(frame: DataFrame, keys: list[str], of: list[str], ties: str = "keep") -> DataFrame:
    """frame with ``pareto``: no other row is as good in all of ``of`` and better in one.

    ties='drop': rows equal in all exclude each other.  Nulls are never on the front.
    """
    if ties not in ("keep", "drop"):
        raise ValueError("ties are kept or dropped")
    if len(of) == 2:
        return _front2(frame, of, ties)
    other = frame.select(*(F.col(c).alias(f"o_{c}") for c in keys + of)).dropna(subset=[f"o_{c}" for c in of])
    as_good = [F.col(f"o_{c}") >= F.col(c) for c in of]
    better = [F.col(f"o_{c}") > F.col(c) for c in of]
    different = [F.col(f"o_{k}") != F.col(k) for k in keys]
    beats = reduce(and_, as_good) & reduce(or_, better if ties == "keep" else different)
    full = frame.dropna(subset=of)
    front = full.join(other, beats, "left_anti").select(*keys).withColumn("pareto", F.lit(True))
    return frame.join(front, keys, "left").withColumn("pareto", F.coalesce("pareto", F.lit(False)))


def _front2(frame: DataFrame, of: list[str], ties: str) -> DataFrame:
    """Two objectives: a running maximum in one order instead of comparing all pairs."""
    a, b = of
    full = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = frame.withColumn("_n", F.count("*").over(Window.partitionBy(a, b)))
    best = out.where(full).groupBy(a).agg(F.max(b).alias("_own")).withColumn("_before", F.max("_own").over(Window.orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)))
    out = out.join(best.withColumnRenamed(a, "_a"), F.col(a) == F.col("_a"), "left")
    front = full & (F.col(b) == F.col("_own")) & (F.col("_before").isNull() | (F.col(b) > F.col("_before")))
    if ties == "drop":
        front = front & (F.col("_n") == 1)
    return out.withColumn("pareto", F.coalesce(front, F.lit(False))).drop("_n", "_own", "_before", "_a")


def family_summary(frame: DataFrame) -> DataFrame:
    """(family, n, means, 95% half width of the cross delta, the strongest condition)."""
    rest = frame.where("kind <> 'original'")
    n, sd = F.count("cross_delta_wer"), F.stddev_samp("cross_delta_wer")
    return rest.groupBy("family").agg(
        F.count("*").alias("n"), F.avg("stoi_mean").alias("stoi"), F.avg("cross_delta_wer").alias("delta"), F.when(n > 1, 1.96 * sd / F.sqrt(n)).otherwise(0.0).alias("half"),
        F.avg("hsr").alias("hsr"), F.max_by("condition_id", F.struct("cross_delta_wer", "condition_id")).alias("strongest"),
    )


def sweep_with_control(frame: DataFrame, key: list[str]) -> DataFrame:
    """Sweep rows by margin, and the mean of the controls of the same key as a last row without a margin."""
    sweep = frame.where("kind = 'sweep'").select(*key, "margin_db", "stoi_mean", "cross_delta_wer")
    control = frame.where("kind = 'control'").groupBy(*key).agg(F.avg("stoi_mean").alias("stoi_mean"), F.avg("cross_delta_wer").alias("cross_delta_wer"))
    return sweep.unionByName(control.withColumn("margin_db", F.lit(None).cast("double")))


def speaker_family(facts: DataFrame) -> DataFrame:
    """Mean paired delta (plain mean over engines) by speaker and family."""
    mean = sum((F.col(f"wer_{e}") for e in ENGINES), F.lit(0.0)) / len(ENGINES)
    rows = facts.where("status = 'ok'").groupBy("condition_id", "kind", "family", "spk", "utt_id").agg(F.avg(mean).alias("w"))
    base = rows.where("kind = 'original'").select("utt_id", F.col("w").alias("w0"))
    return rows.where("kind <> 'original'").join(base, "utt_id").groupBy("spk", "family").agg(F.avg(F.col("w") - F.col("w0")).alias("delta"), F.count("*").alias("n"))


def correlations(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r): Pearson over the rows where both are there, one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = frame.agg(*(F.struct(F.count_if(both(a, b)).alias("n"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.n").alias("n"), F.col(f"p{i}.r").alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(cells))


def value_ranks(counts: DataFrame, of: str, n: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """counts (a row for each value of each group, n rows of it) with ``_rank``, the average rank of the value's rows.

    Only values are ordered, not rows, and none are held: the ranks follow from a running sum.
    """
    before = F.sum(n).over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_rank", F.coalesce(before, F.lit(0)) + (F.col(n) + 1) / 2.0)


def rank_pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, _n, ra, rb): the different pairs, how many rows have them and the average ranks of both; for rows without nulls."""
    pairs = frame.groupBy(a, b).agg(F.count("*").alias("_n"))
    for c, name in ((a, "ra"), (b, "rb")):
        ranks = value_ranks(pairs.groupBy(c).agg(F.sum("_n").alias("_c")), c, "_c").select(F.col(c).alias("_v"), F.col("_rank").alias(name))
        pairs = pairs.join(ranks, F.col(c) == F.col("_v")).drop("_v")
    return pairs


def weighted_corr(x: str, y: str, n: str) -> Column:
    """Pearson of rows given as pairs with counts; null without variance."""
    total = lambda c: F.sum(F.col(n) * c)
    k, x, y = F.sum(n).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    side = lambda v: k * total(v * v) - total(v) * total(v)
    spread = side(x) * side(y)
    return F.when(spread > 0, (k * total(x * y) - total(x) * total(y)) / F.sqrt(spread))


def spearman(frame: DataFrame, a: str, b: str) -> DataFrame:
    full = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rank_pairs(full, a, b).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), weighted_corr("ra", "rb", "_n").alias("rho"))


def distribution(frame: DataFrame, by: list[str], metric: str) -> DataFrame:
    m = F.when(~F.isnan(metric) & (F.abs(metric) < float("inf")), F.col(metric))
    return frame.groupBy(*by).agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.median(m).alias("median"), F.min(m).alias("min"), F.max(m).alias("max"))


def best_of(frame: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The name with the largest value of each group, the first name of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), name)
    return frame.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, F.col(name).alias("best"), F.col(value).alias("value"))


def experiment_pairs(frame: DataFrame, experiment: str, on: str, value: str) -> DataFrame:
    """All pairs of experiments on what both have: mean difference, relative to the first in percent."""
    a = frame.select(F.col(experiment).alias("a"), on, F.col(value).alias("va"))
    b = frame.select(F.col(experiment).alias("b"), on, F.col(value).alias("vb"))
    joined = a.join(b, (a[on] == b[on]) & (a.a < b.b)).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    return joined.select("a", "b", "n", diff.alias("diff"), F.when(F.abs("mean_a") > 1e-15, 100 * diff / F.col("mean_a")).otherwise(0.0).alias("relative"))


def dominance_rank(frame: DataFrame, key: str, of: list[str]) -> DataFrame:
    """(key, dominated_by): how many rows are as good in all of ``of`` and better in one; a summary's rows, few."""
    other = frame.select(F.col(key).alias("_k"), *(F.col(c).alias(f"o_{c}") for c in of))
    beats = reduce(and_, (F.col(f"o_{c}") >= F.col(c) for c in of)) & reduce(or_, (F.col(f"o_{c}") > F.col(c) for c in of))
    return frame.join(other, beats, "left").groupBy(key).agg(F.count("_k").alias("dominated_by"))
