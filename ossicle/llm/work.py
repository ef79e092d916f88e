"""Intermediate tables in the folder that a cluster shares, and small helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

#: Words of 64 bits that the bitmap of :func:`likely` has, a power of two.
WORDS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="ossicle-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


class Workspace:
    """Written tables of one run of an operator, which cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the table that reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that is no longer needed (all of them without a name)."""
        delete(self.spark, self.path(name) if name else self.folder)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what allocators keep of finished work: workers live on, several beside a full heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable, keep_encoder: bool = False) -> Callable:
    """For mapInArrow: run, after which its worker gives memory back.  An encoder that the worker has kept from other work goes first, unless asked to stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_encoder:
            tokens.forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable) -> Callable:
    """For applyInArrow: run(key, table), after which its worker gives memory back."""

    def task(key, table):
        tokens.forget()
        try:
            return run(key, table)
        finally:
            give_back()

    return task


def likely(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose columns may be among the keys, and those whose certainly aren't; no row moves.

    Hashes of keys set bits of a bitmap of WORDS words at most, which is broadcast.  The more keys, the
    more other rows are in the first part, where a join has to tell; results of that don't depend on it.
    """
    word = F.expr(f"shiftrightunsigned(xxhash64({', '.join(columns)}), 6) & {WORDS - 1}L").alias("_word")
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(columns)}) & 63 as int))").alias("_bit")
    words = keys.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.select("*", word, bit).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    some, none = met.where(hit), met.where(~hit)
    return some.select(*rows.columns), none.select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: str) -> Column:
    """A text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, data binary), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"))
