"""Signals, facts, transcripts and responses as views of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
ENGINES = {"whisper_tiny": "whisper", "whisper_small": "whisper", "vosk_small_en": "kaldi", "wav2vec2_base": "ssl"}
ORIGINAL = "c1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over a number of tasks, where what follows costs far more than the bytes say by which partitions are made."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def short_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, spk, sample_rate, waveform): 64 samples each."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("utt_id"), F.col("label").cast("string").alias("spk"), F.lit(RATE).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("waveform"))


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's prices in order of shipping, centred and scaled: some 600 samples each."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", *order), "l_suppkey")
    rows = rows.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("s"))
    return rows.select(F.col("l_suppkey").alias("utt_id"), (F.col("l_suppkey") % 10).cast("string").alias("spk"), F.lit(RATE).alias("sample_rate"), F.transform("s", lambda r: r["l_extendedprice"] / 50000 - 1).alias("waveform"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows of a benchmark: a condition for each supplier, ``c1`` the original."""
    li = table(spark, sf_dir, "lineitem")
    sup = F.col("l_suppkey")
    kind = F.when(sup == 1, "original").when(sup % 10 == 3, "sweep").when(sup % 10 == 7, "control").otherwise("transform")
    return li.select(
        F.concat(F.lit("c"), sup).alias("condition_id"), kind.alias("kind"), F.concat(F.lit("t"), sup % 7).alias("transform_key"),
        F.when(sup == 1, "O").otherwise(F.char(F.lit(65) + sup % 8)).alias("family"), F.when(kind == "sweep", (sup % 40).cast("double")).alias("margin_db"),
        F.col("l_orderkey").alias("utt_id"), (F.col("l_orderkey") % 10).alias("spk"), F.when(F.col("l_quantity") == 1, "error").otherwise("ok").alias("status"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity")).alias("snr_db"), (1.0 - 3 * F.col("l_discount") - F.col("l_tax")).alias("stoi_proxy"), (F.col("l_tax") * 50).alias("mbsd"),
        (F.col("l_discount") * 5).alias("wer_whisper_tiny"), (F.col("l_discount") * 3).alias("wer_whisper_small"), (F.col("l_tax") * 10).alias("wer_vosk_small_en"), (F.col("l_extendedprice") / 100000).alias("wer_wav2vec2_base"),
    )


def long_facts(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each engine of a fact row, with its lineage."""
    cells = F.array(*(F.struct(F.lit(e).alias("engine"), F.lit(g).alias("lineage"), F.col(f"wer_{e}").alias("wer")) for e, g in ENGINES.items()))
    return wide.select(*(keep or ["condition_id", "kind", "family", "utt_id", "spk", "status"]), F.explode(cells).alias("c")).select("*", "c.*").drop("c")


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(condition, utt_id, model, params_m, wer): error rates of three models of growing size."""
    e = table(spark, sf_dir, "events")
    model = F.col("event_id") % 3
    params = F.when(model == 0, 39.0).when(model == 1, 74.0).otherwise(244.0)
    return e.select(F.col("event_type").alias("condition"), F.col("user_id").alias("utt_id"), model.alias("model"), params.alias("params_m"), (F.abs(F.col("value")) / 500 * F.pow(params / 39, F.lit(-0.5)) + 0.001).alias("wer"))


def hashed(*parts: Column | str | int) -> Column:
    """The hexadecimal md5 of the text of the parts."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1) from the text of its parts: the same wherever it runs, and in other engines."""
    return F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("double") / 4294967296.0
