"""Selecting, splitting and ordering rows without random generators: draws come from hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..sources.tables import uniform


def corpus_quality(signals: DataFrame, least_s: float = 0.5, most_s: float = 15.0) -> DataFrame:
    w = F.col("waveform")
    seconds = F.size(w) / F.col("sample_rate")
    return signals.where(seconds.between(least_s, most_s) & (arrays.peak(w) < 0.999) & (arrays.rms(w) >= 1e-4))


def balanced(df: DataFrame, speaker: str, utt: str, speakers: int, total: int) -> DataFrame:
    """Round-robin over the first speakers, their utterances in order."""
    first = df.select(speaker).distinct().orderBy(speaker).limit(speakers)
    rn = F.row_number().over(Window.partitionBy(speaker).orderBy(utt))
    picked = df.join(F.broadcast(first), speaker, "left_semi").withColumn("turn", rn).where(F.col("turn") <= total)
    return picked.orderBy("turn", speaker).limit(total)


def random_choice(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.withColumn("draw", uniform(seed, F.col(key))).orderBy("draw", key).limit(n)


def speaker_split(df: DataFrame, speaker: str, train: float = 0.7, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """df with ``split``; all rows of a speaker fall in one part."""
    people = df.select(speaker).distinct().withColumn("_d", uniform(seed, F.col(speaker)))
    rn, n = F.row_number().over(Window.orderBy("_d", speaker)), F.count("*").over(Window.partitionBy())
    a, b = F.bround(n * train), F.bround(n * valid)
    parts = people.withColumn("split", F.when(rn <= a, "train").when(rn <= a + b, "valid").otherwise("test")).drop("_d")
    return df.join(parts, speaker)


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def distractors(answers: DataFrame, words: DataFrame, key: str, answer: str, n: int = 3, seed: int = 7) -> DataFrame:
    """n words other than the answer for each key, by draws; words: a bounded vocabulary with a column word."""
    pool = words.select("word").distinct().agg(F.array_sort(F.collect_set("word")).alias("pool"))
    rows = answers.join(F.broadcast(pool))
    options = F.filter("pool", lambda w: w != F.col(answer))
    keyed = F.array_sort(F.transform(options, lambda w: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), w).cast("binary")).alias("h"), w.alias("w"))))
    return rows.select(key, answer, F.transform(F.slice(keyed, F.lit(1), F.lit(n)), lambda s: s["w"]).alias("distractors"))


def trial_order(trials: DataFrame, participant: str, trial: str, length: int, seed: int = 11) -> DataFrame:
    """Each participant's trials in an order of their own, repeated or cut to a length."""
    ranked = trials.withColumn("_r", F.row_number().over(Window.partitionBy(participant).orderBy(uniform(seed, F.col(participant), F.col(trial)), trial)) - 1)
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(participant)))
    rounds = F.sequence(F.lit(0), F.ceil((F.lit(length) - F.col("_r")) / F.col("_n")).cast("int") - 1)
    return ranked.where(F.col("_r") < length).select(participant, trial, F.explode(rounds).alias("_k"), "_r", "_n").select(participant, trial, (F.col("_r") + F.col("_k") * F.col("_n")).cast("long").alias("position"))


def attention_gate(responses: DataFrame, participant: str, correct: Column, is_check: Column, share: float = 0.5) -> DataFrame:
    """(participant, checks, passed); without checks one passes."""
    checks = F.count_if(is_check)
    right = F.count_if(is_check & correct)
    return responses.groupBy(participant).agg(checks.alias("checks"), F.when(checks == 0, True).otherwise(right >= share * checks).alias("passed"))


def human_success(responses: DataFrame, correct: Column, expired: Column) -> DataFrame:
    return responses.agg(F.count("*").alias("n"), F.avg((correct & ~expired).cast("int")).alias("hsr"))


def answer_matches(answer: Column, given: Column) -> Column:
    return F.lower(F.trim(answer)) == F.lower(F.trim(given))


def rate_limited(requests: DataFrame, client: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """requests with ``accepted``: at most ``limit`` accepted ones in any such span; rejected ones don't count.

    A fold over each client's requests in order that keeps its accepted times; a client's requests form one array.
    """
    if limit <= 0:
        return requests.withColumn("accepted", F.lit(True))
    cols = [c for c in requests.columns if c not in (client,)]
    row = F.struct(F.col(ts), *[c for c in cols if c != ts])
    span = F.expr(f"interval {seconds} seconds")
    listed = requests.groupBy(client).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = dict(requests.dtypes)[ts]
    state = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.array().cast("array<boolean>").alias("ok"))

    def step(s, r):
        live = F.filter(s["kept"], lambda t: t > r[ts] - span)
        fits = F.size(live) < limit
        return F.struct(F.when(fits, F.concat(live, F.array(r[ts]))).otherwise(live).alias("kept"), F.concat(s["ok"], F.array(fits)).alias("ok"))

    folded = listed.select(client, "rows", F.aggregate("rows", state, step, lambda s: s["ok"]).alias("ok"))
    return folded.select(client, F.explode(F.arrays_zip("rows", "ok")).alias("z")).select(client, "z.rows.*", F.col("z.ok").alias("accepted"))
