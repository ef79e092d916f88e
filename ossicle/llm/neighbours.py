"""Approximate nearest neighbours by shifted space-filling curves.

Several random projections of the vectors, each shifted at random, are ordered along a
Hilbert curve, by Spark's range partitioning.  In each ordering a query meets a window of the rows before and
after it; rows are held in blocks of bounded size, past which the queries stream, and the
finds of all orderings are merged and ranked by their exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

#: Vectors that the projections are fitted on, and rows of a block.
SAMPLE, BLOCK = 4096, 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (n, m) with coordinates below 2**bits (Skilling, 2004)."""
    x = cells.T.astype(np.uint64)
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(m):
            has = (x[i] & bit) != 0
            swap = np.where(has, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(has, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[m - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


@dataclass
class Curves:
    """Fitted projections: a key of each vector in each ordering."""

    centre: np.ndarray
    axes: np.ndarray  # curves, dimensions, projected dimensions
    low: np.ndarray
    unit: np.ndarray
    bits: int = 8

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, dims: int, seed: int = 2) -> Curves:
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        axes = np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dims] for _ in range(curves)])
        centre = sample.mean(0)
        y = np.einsum("nd,cdm->cnm", sample - centre, axes)
        unit = np.maximum(y.std(1), 1e-12) * 8 / 256
        low = -128 * unit + rng.uniform(-16, 16, (curves, dims)) * unit  # the shift
        return cls(centre, axes, low, unit)

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        y = np.einsum("nd,cdm->cnm", vectors - self.centre, self.axes)
        cells = np.clip((y - self.low[:, None]) / self.unit[:, None], 0, 255)
        return [hilbert(c.astype(np.uint64), self.bits) for c in cells]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors that come as the bytes of their doubles."""
    data = [x.as_py() for x in column]
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1) if data else np.empty((0, 1))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.asarray(x, "<f8").tobytes() for x in batch.column("vector").to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), pa.array(vectors, pa.binary())], ["row", "ids", "vector"])


def _keyed(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.stack(curves.keys(_matrix(batch.column(1))), 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["row", "keys"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range partition with its number and their places in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [batch.column("curve"), batch.column("row"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        yield pa.RecordBatch.from_arrays(columns, ["curve", "row", "part", "at"])
        at += n


def ranks(keys: DataFrame, n: int, work: Workspace) -> DataFrame:
    """(curve, row, rank): the places of n rows along each curve, from (row, keys).

    Spark orders all keys of all curves by range partitions; a place is the rows of the partitions before
    and the place in the own one.
    """
    each = keys.select("row", F.posexplode("keys").alias("curve", "key"))
    ordered = each.repartitionByRange("curve", "key", "row").sortWithinPartitions("curve", "key", "row")
    numbered = work.write(ordered.mapInArrow(_numbered, "curve int, row long, part int, at long"), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    base = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return numbered.join(base, "part").select("curve", "row", (F.col("base") + F.col("at") - F.col("curve") * F.lit(n)).alias("rank"))


def nearest(query: np.ndarray, rows: np.ndarray, square: np.ndarray, k: int) -> np.ndarray:
    """The places of all rows that may be among a query's k nearest, ties included; square: the rows' squared lengths."""
    if len(rows) <= k:
        return np.arange(len(rows))
    rough = square - 2 * (rows @ query)
    slack = 1e-12 * (square.max() + query @ query) * rows.shape[1]
    return np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + slack)


def _score(k: int):
    """Candidates of the queries of each block, which follow the block's rows: rows of one block are all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, ranks_, parts, ready = None, [], [], [], None
        for batch in batches:
            where = list(zip(batch.column("curve").to_pylist(), batch.column("block").to_pylist()))
            kind, x = batch.column("kind").to_pylist(), _matrix(batch.column("vector"))
            own, rank, low, high = (batch.column(c).to_pylist() for c in ("ids", "rank", "low", "high"))
            out = ([], [], [])
            for i, at in enumerate(where):
                if at != block:
                    block, ids, ranks_, parts, ready = at, [], [], [], None
                if kind[i] == 0:
                    ids.append(own[i])
                    ranks_.append(rank[i])
                    parts.append(x[i])
                    continue
                if ready is None:
                    matrix = np.array(parts)
                    ready = matrix, (matrix**2).sum(1), np.array(ranks_)
                matrix, square, places = ready
                a, b = np.searchsorted(places, (low[i], high[i] + 1))
                query = own[i][0]
                near = a + nearest(x[i], matrix[a:b], square[a:b], k + 1)  # its own vector may be one
                difference = matrix[near] - x[i]
                score = np.sqrt((difference * difference).sum(1))
                best = sorted((s, j) for s, p in zip(score.tolist(), near.tolist()) for j in ids[p] if j != query)[:k]
                out[0].extend([query] * len(best))
                out[1].extend(j for _, j in best)
                out[2].extend(s for s, _ in best)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part, each once."""
    v = F.col("vector")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound).distinct()


def search(
    table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    curves: int = 8, dims: int = 4, share: float = 0.125, least: int = 128, exact_below: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id ``every`` divides.

    Candidates are all rows but those with the query's own id; score is the Euclidean distance in
    double precision, ties go to the smaller id.  Rows with a null id and vectors that are
    null, zero or hold null or non-finite components take no part, nor do vectors of
    another length than most have (of lengths as frequent, the smallest).  Repeated rows count
    once.  Equal vectors are one row of the index with their k + 1 smallest ids, which are all that can be among k
    nearest, so that no vector is too common.  Along each curve a query meets the rows up to ``share`` of all, and
    ``least`` at any rate, before and after it.  Callers may ask for all rows to meet up to ``exact_below`` different vectors.
    """
    work = Workspace(table.sparkSession, "neighbours")
    rows = vectors(table, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = lengths[0].n if lengths else 0
    rows = work.write(rows.where(F.size("vector") == size), "rows")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    classes = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    classes = work.write(classes, "classes")
    asked = rows.where(F.col("vec_id") % every == 0).join(classes.select("row", "vector"), "vector").select("row", F.array("vec_id").alias("query"))
    packed = work.write(classes.select("row", "ids", "vector").mapInArrow(_as_bytes, "row long, ids array<long>, vector binary"), "packed")
    n = packed.count()
    order = F.xxhash64("vector")
    part = 1.1 * SAMPLE / max(n, 1)  # of the hashes, so that few more rows than needed reach the driver
    sample = packed.where(order.cast("double") <= (2 * part - 1) * 2.0**63).orderBy(order).limit(SAMPLE).select("vector").toArrow()
    x = _matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((1, max(size, 1)))
    keys = work.write(packed.select("row", "vector").mapInArrow(_keyed(Curves.fit(x, curves, dims)), "row long, keys array<long>"), "keys")
    placed = work.write(ranks(keys, n, work), "placed")
    reach = n if n <= exact_below else max(least, math.ceil(share * n))
    block = lambda c: F.floor(c / BLOCK).cast("long")
    held = placed.join(packed, "row").select("curve", block(F.col("rank")).alias("block"), F.lit(0).alias("kind"), "rank", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "ids", "vector")
    windows = asked.join(placed, "row").join(packed.select("row", "vector"), "row")
    windows = windows.withColumns({"low": F.greatest(F.col("rank") - reach, F.lit(0)), "high": F.least(F.col("rank") + reach, F.lit(n - 1))})
    windows = windows.withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))))
    windows = windows.select("curve", "block", F.lit(1).alias("kind"), "rank", "low", "high", F.col("query").alias("ids"), "vector")
    met = held.unionByName(windows).repartition("curve", "block").sortWithinPartitions("curve", "block", "kind", "rank")
    found = met.mapInArrow(_score(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
