"""The human-versus-machine stack: survival, gap, robustness and their composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hsr_proxy(stoi_mean: Column) -> Column:
    return clip(0.6 + 0.4 * stoi_mean)


def gap(hsr: Column, asr_sr: Column) -> Column:
    return clip(hsr) - clip(asr_sr)


def success(wer: Column, limit: float = 0.3, strict: bool = True) -> Column:
    """Share of rows below (or at) a limit."""
    return F.avg((wer < limit if strict else wer <= limit).cast("int"))


def survival(degradation: Column, surviving: Column, epsilon: float = 0.0) -> Column:
    """How much of a degradation survives a defence, within [-0.5, 2]; without one, 1 if nothing is lost."""
    return F.when(F.abs(degradation) < 1e-6, F.when(F.abs(surviving) < 1e-6, 1.0).otherwise(0.0)).otherwise(clip(surviving / (F.when(F.abs(degradation) < 1e-6, 1.0).otherwise(degradation) + epsilon), -0.5, 2.0))


def recovery(dsr: Column) -> Column:
    return clip(1 - dsr)


def common_failures(long: DataFrame, by: list[str], utt: str = "utt_id", limit: float = 0.5) -> DataFrame:
    """Share of utterances on which every model fails."""
    each = long.groupBy(*by, utt).agg(F.min("wer").alias("least"))
    return each.groupBy(*by).agg(F.avg((F.col("least") > limit).cast("int")).alias("cmfr"), F.count("*").alias("n"))


def acceptable(stoi: Column, mbsd: Column, snr: Column) -> Column:
    """Share of rows of good quality; a null SNR is one without noise."""
    return F.avg(((stoi >= 0.7) & (mbsd <= 5) & (snr.isNull() | (snr >= 15))).cast("int"))


def robustness(dsr: Column, cmfr: Column) -> Column:
    return 0.6 * clip(dsr) + 0.4 * clip(cmfr)


def composite(hag: Column, trs: Column, par: Column) -> Column:
    return 0.5 * (hag + 1) / 2 + 0.3 * trs + 0.2 * par


def label(css: Column) -> Column:
    return F.when(css >= 0.7, "EXCELLENT").when(css >= 0.5, "GOOD").when(css >= 0.3, "MODERATE").when(css >= 0.1, "WEAK").otherwise("POOR")


def evaluate(facts: DataFrame, long: DataFrame) -> DataFrame:
    """One row for each condition with the whole stack, rounded to four places; best first."""
    quality = facts.where("status = 'ok'").groupBy("condition_id").agg(F.avg("stoi_proxy").alias("stoi"), acceptable(F.col("stoi_proxy"), F.col("mbsd"), F.col("snr_db")).alias("par"))
    machine = long.where("status = 'ok'").groupBy("condition_id").agg(success(F.col("wer")).alias("asr_sr"))
    failing = common_failures(long.where("status = 'ok'"), ["condition_id"], limit=0.3).select("condition_id", "cmfr")
    all_ = quality.join(machine, "condition_id").join(failing, "condition_id").withColumn("dsr", F.lit(1.0))
    all_ = all_.withColumn("hsr", hsr_proxy(F.col("stoi"))).withColumn("hag", gap(F.col("hsr"), F.col("asr_sr"))).withColumn("prr", recovery(F.col("dsr")))
    all_ = all_.withColumn("trs", robustness(F.col("dsr"), F.col("cmfr"))).withColumn("css", composite(F.col("hag"), F.col("trs"), F.col("par")))
    values = ["hsr", "asr_sr", "hag", "dsr", "prr", "cmfr", "par", "trs", "css"]
    return all_.select("condition_id", *(F.round(c, 4).alias(c) for c in values), label(F.col("css")).alias("label")).orderBy(F.desc("css"), "condition_id")
