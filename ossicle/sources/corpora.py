"""Corpora on disk as tables (utt_id, spk, transcript, sample_rate, waveform, error).

Audio comes by Spark's binaryFile source and is decoded next to the data (PCM WAV); a file that can't be
read has an error and no waveform.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
_DECODED = "path string, sample_rate int, waveform array<double>, error string"


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in [-1, 1)), channels averaged."""
    with wave.open(io.BytesIO(data)) as f:
        width, raw = f.getsampwidth(), f.readframes(f.getnframes())
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            x = ((b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) >> 8) / 2.0**23
        else:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
        return f.getframerate(), x.reshape(-1, f.getnchannels()).mean(1)


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 32767 / 32768) * 32768).astype("<i2").tobytes())
    return out.getvalue()


def audio(spark: SparkSession, path: str, rate: int = RATE, pattern: str = "*.wav") -> DataFrame:
    """(path, sample_rate, waveform, error) of all files below a folder, at one rate."""
    from ..functions.kernels import resample_poly

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, data in zip(part["path"], part["content"]):
                try:
                    sr, x = decode_wav(bytes(data))
                    rows.append((p, rate, (resample_poly(x, rate, sr) if sr != rate else x).tolist(), None))
                except Exception as e:  # noqa: BLE001  the row tells
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "waveform", "error"]).astype({"sample_rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, _DECODED)


def _stem(c="path"):
    return F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)


_OUT = ["utt_id", "spk", "transcript", "sample_rate", "waveform", "error"]


def librispeech(spark: SparkSession, root: str) -> DataFrame:
    """Speaker and chapter folders; lines ``id WORDS`` in *.trans.txt."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(root)
    words = lines.select(F.split_part("value", F.lit(" "), F.lit(1)).alias("utt_id"), F.expr("substring(value, instr(value, ' ') + 1)").alias("transcript"))
    a = audio(spark, root).withColumn("utt_id", _stem())
    return a.join(words, "utt_id", "left").withColumn("spk", F.split_part("utt_id", F.lit("-"), F.lit(1))).withColumn("transcript", F.coalesce("transcript", F.lit(""))).select(*_OUT)


def common_voice(spark: SparkSession, tsv: str, clips: str) -> DataFrame:
    """A TSV with path, sentence and client_id; rows without a file are left out."""
    t = spark.read.option("sep", "\t").option("header", "true").csv(tsv).where("path is not null")
    a = audio(spark, clips).withColumn("utt_id", _stem())
    t = t.select(_stem(F.concat(F.lit("/"), F.regexp_replace("path", r"\.mp3$", ".wav"))).alias("utt_id"), F.col("client_id").alias("spk"), F.col("sentence").alias("transcript"))
    return a.join(t, "utt_id").select(*_OUT)


def fleurs(spark: SparkSession, tsv: str, folder: str, language: str | None = None) -> DataFrame:
    """A TSV with id, file, text and language (the filter holds only where the column is filled)."""
    t = spark.read.option("sep", "\t").option("header", "true").csv(tsv)
    if language and "language" in t.columns:
        t = t.where(F.col("language").isNull() | (F.col("language") == "") | (F.col("language") == language))
    a = audio(spark, folder).withColumn("utt_id", _stem())
    t = t.select(_stem(F.concat(F.lit("/"), F.col("file"))).alias("utt_id"), F.coalesce(F.col("speaker_id") if "speaker_id" in t.columns else F.lit(None), F.lit("unknown")).alias("spk"), F.col("text").alias("transcript"))
    return a.join(t, "utt_id").select(*_OUT)


def kaldi(spark: SparkSession, folder: str) -> DataFrame:
    """wav.scp (with pipes), text and spk2utt; a speaker not listed is the id's first four characters."""
    pair = lambda n: spark.read.text(f"{folder}/{n}").select(F.split_part("value", F.lit(" "), F.lit(1)).alias("utt_id"), F.expr("substring(value, instr(value, ' ') + 1)").alias("rest"))
    tokens = F.filter(F.split(F.regexp_replace(F.trim("rest"), r"\|\s*$", ""), r"\s+"), lambda x: (x != "") & ~x.startswith("-"))
    scp = pair("wav.scp").select("utt_id", F.element_at(tokens, -1).alias("wav"))
    words = pair("text").select("utt_id", F.col("rest").alias("transcript"))
    people = pair("spk2utt").select(F.col("utt_id").alias("listed"), F.explode(F.split("rest", r"\s+")).alias("utt_id"))
    a = audio(spark, folder)
    rows = scp.withColumn("wav", _stem("wav")).join(a.withColumn("wav", _stem()), "wav").join(words, "utt_id", "left").join(people, "utt_id", "left")
    first = F.when(F.length("utt_id") >= 4, F.substring("utt_id", 1, 4)).otherwise(F.col("utt_id"))
    return rows.withColumn("spk", F.coalesce("listed", first)).withColumn("transcript", F.coalesce("transcript", F.lit(""))).select(*_OUT)


def loose(spark: SparkSession, folder: str) -> DataFrame:
    """Any wav files, with a text file of the same name beside them if there is one."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    t = t.select(_stem("_metadata.file_path").alias("utt_id"), F.trim("value").alias("transcript"))
    a = audio(spark, folder).withColumn("utt_id", _stem())
    return a.join(t, "utt_id", "left").withColumn("spk", F.lit("unknown")).withColumn("transcript", F.coalesce("transcript", F.lit(""))).select(*_OUT)


def synthetic(spark: SparkSession, n: int = 20, seconds: float = 2.0, seed: int = 42) -> DataFrame:
    """Formant-like tones of three speakers with transcripts of ten words' vocabulary."""
    vocabulary = "river stone cloud maple ember harbor violet canyon meadow lantern".split()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i in part["id"]:
                rng = np.random.default_rng(seed + int(i))
                t = np.arange(int(seconds * RATE)) / RATE
                x = sum(a * np.sin(2 * np.pi * f * t) for a, f in zip((0.5, 0.3, 0.2), (120 + 20 * (i % 3), 500 + rng.uniform(-50, 50), 1500 + rng.uniform(-100, 100))))
                x = 0.5 * x * (1 + 0.5 * np.sin(2 * np.pi * 4 * t))
                rows.append((f"utt_{i:04d}", f"speaker_{i % 3}", " ".join(rng.choice(vocabulary, 4)), RATE, x.tolist(), None))
            yield pd.DataFrame(rows, columns=_OUT)

    return spark.range(n).mapInPandas(run, "utt_id string, spk string, transcript string, sample_rate int, waveform array<double>, error string")


def write_audio(signals: DataFrame, path: str) -> DataFrame:
    """Signals as WAV bytes in Parquet (utt_id, content): files of their own would not scale."""
    pack = F.pandas_udf(lambda w, r: pd.Series([encode_wav(np.asarray(x, float), int(s)) for x, s in zip(w, r)]), "binary")
    signals.select("utt_id", pack("waveform", "sample_rate").alias("content")).write.mode("overwrite").parquet(path)
    return signals.sparkSession.read.parquet(path)
