"""Sharding by a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4099


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """The shard (its place in ``shards``) of each slot.

    Each shard has its own order of the slots, slot ``offset + j * skip`` modulo the
    prime size; the shards take turns, and each claims its first slot that is still free.
    So shares differ by one slot at most, and few slots change hands when a shard comes or goes.
    """
    if not _is_prime(size) or not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("the table needs a prime size and that many distinct shards at most")
    offset = [_number(f"offset {s}") % size for s in shards]
    skip = [_number(f"skip {s}") % (size - 1) + 1 for s in shards]
    step = [0] * len(shards)
    table = [-1] * size
    filled = 0
    while True:
        for i in range(len(shards)):
            while table[c := (offset[i] + step[i] * skip[i]) % size] >= 0:
                step[i] += 1
            table[c] = i
            filled += 1
            if filled == size:
                return table


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key, from the first 15 hex digits of the md5 of its text; a null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: int | list[str] = 64, size: int = SIZE) -> DataFrame:
    """df with columns slot and shard (int), both replaced if there.

    The table has ``size`` entries whatever the input, so it is sent as a literal array, and a
    row's shard is one array access: no shuffle.  Null keys share one slot, repeated
    rows share theirs, and an empty table stays empty.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else shards
    table = F.expr("array(" + ",".join(map(str, lookup_table(names, size))) + ")")
    df = df.withColumn("slot", slot(F.col(key), size))
    return df.withColumn("shard", F.element_at(table, F.col("slot") + 1))


def write(df: DataFrame, path: str, shard: str = "shard", files: int = 1) -> None:
    """A folder for each shard; a large shard is spread over ``files`` tasks by a hash of its rows."""
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(files))
    df.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(path)


def sql(table: str, key: str, shards: int, size: int = SIZE) -> str:
    """The assignment of integer keys in DuckDB."""
    cells = ",".join(map(str, lookup_table([f"shard-{i}" for i in range(shards)], size)))
    return (
        f"with t as materialized (select [{cells}] as cells), "
        f"s as (select {key}, (('0x' || substr(md5(coalesce(cast({key} as varchar), '')), 1, 15))::bigint % {size})::integer as slot from {table}) "
        f"select {key}, slot, cells[slot + 1]::integer as shard from s, t"
    )
