"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream where the content says so, and every
distinct chunk is written once, under its SHA-256.  Files, all Parquet, in one folder:

``chunks``    digest, payload: a byte 2 or 4, then the ids as little-endian integers of that width.
``recipes``   ``kind=0``: shard, pos, doc_id, n_tokens, chunks (a document's digests in order); shards
              are ranges of doc_id (null first) in ascending order, pos counts within one.
              ``kind=2``: the manifest, a row for each shard: n_tokens of it and its Merkle root, whose
              leaves are the SHA-256 of the documents' digests in order.
Readers check every payload against its digest and every shard against its root.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import anchors
from .tokens import encoded
from .work import Workspace, sweep, texts

WINDOW, BITS, LEAST, MOST = 16, 9, 64, 4096
#: The mixed values of narrow ids.
_MIXED = anchors.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
_STAGED = "kind int, doc_id long, n_tokens long, chunks array<binary>, digest binary, payload binary"
_RECIPES = "shard int, pos long, doc_id long, n_tokens long, chunks array<binary>, root binary, kind int"


def breaks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids cuts."""
    found = []
    for at in range(0, max(len(ids) - WINDOW + 1, 0), anchors.SLAB - WINDOW):
        part = ids[at : at + anchors.SLAB]
        sums = anchors.prefix(_MIXED[part] if part.max() < len(_MIXED) else anchors.mix(part.astype(np.uint64) + np.uint64(1)), 0)
        ends = np.arange(WINDOW, len(part) + 1)
        rolled = anchors.mix(anchors.spans(sums, 0, ends - WINDOW, ends))
        found.append(at + ends[(rolled >> np.uint64(64 - BITS)) == 0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def cuts(n: int, candidates: list[int]) -> list[int]:
    """Chunk ends of a document of n ids: candidates at least LEAST apart, forced ends every MOST ids."""
    out, at = [], 0
    for c in [*candidates, n]:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST or c == n and c > at:
            out.append(at := c)
    return out


def payload(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return b"\2" + ids.astype("<u2").tobytes() if narrow else b"\4" + ids.astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def merkle(leaves: list[bytes]) -> bytes:
    """The root: pairs are hashed level by level, an odd one out moves up; no leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256().digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def leaf(doc_id: int | None, digests: list[bytes]) -> bytes:
    head = b"n" if doc_id is None else b"i" + struct.pack("<q", doc_id)
    return hashlib.sha256(b"\0" + head + b"".join(digests)).digest()


def _staged(tokenizer: str, end_id: int):
    def flush(docs: list, parts: list[np.ndarray], seen: set[bytes]) -> pa.RecordBatch:
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        stops = np.cumsum([len(p) for p in parts])
        marks = breaks(ids)
        narrow = ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else None
        rows = []
        for doc, part, stop in zip(docs, parts, stops):
            start = stop - len(part)
            mine = marks[np.searchsorted(marks, start + WINDOW) : np.searchsorted(marks, stop)] - start
            digests, at = [], 0
            for end in cuts(len(part), mine.tolist()):
                data = payload(part[at:end]) if narrow is None else b"\2" + narrow[2 * (start + at) : 2 * (start + end)]
                digests.append(digest := hashlib.sha256(data).digest())
                at = end
                if digest not in seen:
                    seen.add(digest)
                    rows.append((1, None, None, None, digest, data))
            rows.append((0, doc, len(part), digests, None, None))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        names = ["kind", "doc_id", "n_tokens", "chunks", "digest", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, docs, parts, size = batch.column(0).to_pylist(), [], [], 0
            for i, x in encoded(batch.column(1), tokenizer):
                docs.append(ids[i])
                parts.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                size += len(parts[-1])
                if size > 400_000:
                    yield flush(docs, parts, seen)
                    docs, parts, size = [], [], 0
            yield flush(docs, parts, seen)
            if len(seen) > 300_000:  # other copies meet in the shuffle
                seen.clear()

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's recipes with their places, and the shard's row of the manifest after them."""
    shard, pos, total, leaves = TaskContext.get().partitionId(), 0, 0, []
    names = ["shard", "pos", "doc_id", "n_tokens", "chunks", "root", "kind"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.int32()]
    for batch in batches:
        n = batch.num_rows
        leaves += [leaf(d, c) for d, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        total += sum(batch.column(1).to_pylist())
        columns = [[shard] * n, range(pos, pos + n), batch.column(0), batch.column(1), batch.column(2), [None] * n, [0] * n]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names)
        pos += n
    if pos:
        row = [[shard], [pos], [None], [total], [None], [merkle(leaves)], [2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append end_id to each and write the store to path.

    Rows with a null id come first; repeated rows are all kept, in the order of their content.
    """
    work = Workspace(docs.sparkSession, "store")
    encoded_docs = texts(docs, id_col, text_col).mapInArrow(_staged(tokenizer, end_id), _STAGED)
    encoded_docs.write.option("compression", "zstd").partitionBy("kind").parquet(work.path("staged"))
    staged = docs.sparkSession.read.schema(_STAGED).parquet(work.path("staged"))
    once = staged.where("kind = 1").groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/chunks")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    recipes = staged.where("kind = 0").select("doc_id", "n_tokens", "chunks", F.xxhash64("chunks").alias("_tie"))
    ordered = recipes.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ordered.mapInArrow(_number, _RECIPES).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    work.drop()
    sweep(docs.sparkSession)


def _recipes(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes").where(F.col("kind") == kind).drop("kind")


def root(spark: SparkSession, path: str) -> bytes:
    """The Merkle root of the whole store, from the roots in the manifest (a row for each shard)."""
    return merkle([bytes(r.root) for r in _recipes(spark, path, 2).orderBy("shard").select("root").collect()])


def verify(spark: SparkSession, path: str) -> bool:
    """Whether every shard's recipes give the root in the manifest; one task a shard."""

    def run(key, table):
        table = table.sort_by("pos")
        found = merkle([leaf(d, c) for d, c in zip(table.column("doc_id").to_pylist(), table.column("chunks").to_pylist())])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "found": pa.array([found], pa.binary()), "n": pa.array([table.num_rows], pa.int64())})

    found = _recipes(spark, path, 0).groupBy("shard").applyInArrow(run, "shard int, found binary, n long")
    both = _recipes(spark, path, 2).join(found, "shard", "full")
    return both.where("not (root <=> found and pos <=> n)").isEmpty()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums = [], []
        for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if hashlib.sha256(data).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ids = unpack(data)
            sizes.append(len(ids))
            sums.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["digest", "n", "crc"])


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, in its reflected form."""
    out = np.zeros_like(a)
    b = b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(_POLY), b >> np.uint64(1))
    return out


def crc_of_joined(crcs: np.ndarray, after: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """CRC-32 of each document from those of its parts and the bytes that follow each part in it."""
    shift = np.full(len(crcs), 1 << 31, np.uint64)  # the polynomial 1
    power = np.full(1, 1 << 23, np.uint64)  # x**8: one zero byte
    left = after.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            shift[odd] = _times(shift[odd], np.broadcast_to(power, odd.sum()))
        power = _times(power, power)
        left >>= np.uint64(1)
    out = np.zeros(n_docs, np.uint64)
    np.bitwise_xor.at(out, docs, _times(shift, crcs.astype(np.uint64)))
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, pos, doc_id, n_tokens, crc) from each document's parts in order."""
    for batch in batches:
        parts = batch.column("parts")
        rows = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        if flat.field("n").null_count:
            raise ValueError("a chunk of a recipe is missing")
        order = np.lexsort((flat.field("i").to_numpy(), rows))
        n, crc = flat.field("n").to_numpy()[order], flat.field("crc").to_numpy()[order]
        total = np.bincount(rows, weights=n, minlength=batch.num_rows).astype(np.int64)
        upto = np.cumsum(n)
        after = np.cumsum(total)[rows] - upto
        crcs = crc_of_joined(crc, 4 * after, rows, batch.num_rows)
        names = ["shard", "pos", "doc_id", "n_tokens", "crc"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(total), pa.array(crcs.astype(np.int64))], names)


def _exploded(spark: SparkSession, path: str) -> DataFrame:
    return _recipes(spark, path, 0).select("shard", "pos", "doc_id", F.posexplode("chunks").alias("i", "digest"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Every chunk file is read and checked, and a document's checksum is put together from
    those of its chunks, so that no payload is shuffled.
    """
    info = spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks").mapInArrow(_checked, "digest binary, n long, crc long")
    parts = _exploded(spark, path).join(info, "digest", "left").groupBy("shard", "pos", "doc_id").agg(F.collect_list(F.struct("i", "n", "crc")).alias("parts"))
    docs = parts.mapInArrow(_joined, "shard int, pos long, doc_id long, n_tokens long, crc long")
    shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over the manifest: a row for each shard
    base = _recipes(spark, path, 2).select("shard", F.coalesce(F.sum("n_tokens").over(shards), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    return docs.join(base, "shard").select("doc_id", start.alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, pos, doc_id, ids array<long>): the documents put together again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"]) for p in sorted(x, key=lambda p: p["i"])]).astype(np.int64) for x in batch.column("parts").to_pylist()]
            names = ["shard", "pos", "doc_id", "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(ids, pa.list_(pa.int64()))], names)

    chunks = spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks")
    parts = _exploded(spark, path).join(chunks, "digest").groupBy("shard", "pos", "doc_id").agg(F.collect_list(F.struct("i", "payload")).alias("parts"))
    return parts.mapInArrow(run, "shard int, pos long, doc_id long, ids array<long>")


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store and return what its files say of each document; see :func:`digests`."""
    path = path or Workspace(docs.sparkSession, "token-store").path("files")
    write(docs, path, tokenizer, end_id, id_col, text_col)
    if not verify(docs.sparkSession, path):
        raise ValueError("the recipes don't give the roots in the manifest")
    return digests(docs.sparkSession, path)
