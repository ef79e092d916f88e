"""The corpus pipeline: each stage works on what the one before kept, written as Parquet in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ossicle.llm import mixing, packing, quality, simhash, suffix
from ossicle.llm.queries import read, tokenizer_path
from ossicle.llm.work import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.deduplicated(docs, words=5, similarity=0.8)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 50-byte strings of earlier documents cover; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = suffix.deduplicated(docs, length=50)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of their sources interleave."""
    mixed = mixing.mix(docs, block_size=16, temperature=0.5)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2,048 tokens, numbered along the mixed order."""
    return packing.packed_documents(docs, tokenizer_path(), capacity=2048, end_id=0, ordered=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("mixed sources", mixed_sources),
    ("packed sequences", packed_sequences),
]

#: The stages are tested against brute force: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), str(i))
        if i:
            work.drop(str(i - 1))
    return docs
