"""Texts whose word shingles overlap enough, found exactly by prefixes of their rarest shingles.

If two sets have a Jaccard similarity of t or more, each shares t of its members with the other.  So if all
sets are put in one order, the first ``n - ceil(t n) + 1`` of each have a member in common
(prefix filtering; Chaudhuri, Ganti and Kaushik, 2006).  The order puts rare shingles first: buckets count in how
many texts each of ``slots`` values of a shingle's hash is found, and only shingles of several texts come back to their texts.  A text
whose prefix has none of these is like no other.

The first member that two sets share is at places i and j, before which they share nothing: they differ in i + j members
or more.  Alike sets differ in no more than ``(1 - t) / (1 + t)`` of the sum of their sizes.  So a text has at each
place a slack, its part of that less the place, and two that are alike meet where their slacks add up to no less than 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .work import lean, lean_group

#: Values that shingles are counted by, shingles a flush, shingles a bucket, and the fewest buckets and bits of a text's marks.
SLOTS, FLUSH, BUCKET, BUCKETS, MARKS = 1 << 40, 1 << 20, 1 << 20, 256, 512
#: Marks folded to MARKS bits, as columns that a join compares.
FOLDED = [f"m{i}" for i in range(MARKS // 64)]
_ENTRIES = "key int, chunk long, size int, body binary, marks array<binary>"
_EPS = 1e-6
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_shingles(data: bytes, size: int) -> np.ndarray:
    """64-bit values of the word shingles of ASCII-lower-cased text, repeats included; fewer words are one shingle."""
    found = data.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out += words[i : i + len(out)] * _ODD[i]
    return mix(out)


def shingle_set(data: bytes, words: int) -> np.ndarray:
    return np.unique(word_shingles(data, words))


def least_common(n: int, similarity: float) -> int:
    """The fewest shingles that a set of n shares with one that is alike."""
    return math.ceil(similarity * n - 1e-9)


def differ_share(similarity: float) -> float:
    """The most members in which alike sets differ, as a share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


def marks(shingles: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of a set's members fall on it, so that sets differ in no fewer members than bits.

    There are about as many bits as members, a power of two: marks of larger sets fold onto those of smaller ones.
    """
    size = max(MARKS, 1 << max(len(shingles) - 1, 0).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts & 1 == 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The bits in which marks differ, on as many as the shorter ones have."""
    x, y = (np.frombuffer(m, np.uint64) for m in (a, b))
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum(dtype=np.int64))


def folded(marks: bytes) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(marks, np.int64).reshape(-1, len(FOLDED)))


def _packed(size: int, *arrays: np.ndarray) -> tuple[int, bytes]:
    return size, pa.compress(b"".join(x.tobytes() for x in arrays), codec="zstd", asbytes=True)


def _unpacked(body: bytes, *counts_types: tuple[int, str]) -> list[np.ndarray]:
    data = pa.decompress(body, sum(n * np.dtype(t).itemsize for n, t in counts_types), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, t in counts_types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _batch(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
    return {name: pa.array(c, t) for name, c, t in zip(["key", "chunk", "size", "body", "marks"], zip(*rows) if rows else [[]] * 5, kinds)}


def _asked(words: int, buckets: int, slots: int):
    """From (doc, tag, data): a row with the texts of each chunk (its size is negative), and one with its shingles in each bucket."""

    def flush(chunk: int, nodes: list[tuple[int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in found])
        slot = mix(np.concatenate(found)) % np.uint64(slots)
        key, sub = (slot & np.uint64(buckets - 1)).astype(np.int64), slot >> np.uint64(buckets.bit_length() - 1)
        order = np.argsort(key.astype(np.uint64) << np.uint64(32) | sub, kind="stable")
        key, sub, which = key[order], sub[order].astype("<u4"), np.repeat(np.arange(len(found), dtype="<u4"), sizes)[order]
        rows = [(chunk % buckets, chunk, *_packed(-len(nodes), np.array(nodes, "<i8").T, sizes.astype("<u4")), [marks(x) for x in found])]
        ends = np.searchsorted(key, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(ends)):
            a, b = ends[k], ends[k + 1]
            rows.append((k, chunk, *_packed(b - a, np.diff(sub[a:b], prepend=np.uint32(0)), which[a:b]), None))
        return pa.RecordBatch.from_pydict(_batch(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, nodes, found, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, tag, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = shingle_set(data.as_py(), words)
                if len(own):
                    nodes.append((doc, tag))
                    found.append(own)
                    size += len(own)
                if size >= FLUSH:
                    yield flush(chunk, nodes, found)
                    chunk, nodes, found, size = chunk + 1, [], [], 0
        if nodes:
            yield flush(chunk, nodes, found)

    return run


def _counted(key, table: pa.Table) -> pa.Table:
    """A bucket's entries of slots that several texts hold, with their number; the chunks' own rows go on."""
    heads, rows, parts = [], [], []
    for row in table.to_pylist():
        if row["size"] < 0:
            heads.append(tuple(row.values()))
        else:
            rows.append(row)
            sub, which = _unpacked(row["body"], (row["size"], "<u4"), (row["size"], "<u4"))
            parts.append((np.cumsum(sub, dtype="<u4"), which))
    if rows:
        _, place, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        ends = np.cumsum([row["size"] for row in rows])
        for row, (sub, which), end in zip(rows, parts, ends):
            held = counts[place[end - row["size"] : end]]
            several = held > 1
            if several.any():
                sub, which = sub[several], which[several]
                heads.append((row["key"], row["chunk"], *_packed(len(sub), np.diff(sub, prepend=np.uint32(0)), which, held[several].astype("<u4")), None))
    return pa.table(_batch(heads))


def _ordered(similarity: float, buckets: int):
    """A chunk's texts that share shingles of their prefixes: those, the slack at each, and the texts' marks."""

    def run(key, table: pa.Table) -> pa.Table:
        head, slots, texts, counts = None, [], [], []
        for row in table.to_pylist():
            if row["size"] < 0:
                head = row
            else:
                sub, which, held = _unpacked(row["body"], *[(row["size"], "<u4")] * 3)
                slots.append(np.cumsum(sub, dtype="<u4").astype(np.int64) * buckets + row["key"])
                texts.append(which)
                counts.append(held)
        docs, tags, n = _unpacked(head["body"], (-head["size"], "<i8"), (-head["size"], "<i8"), (-head["size"], "<u4"))
        n = n.astype(np.int64)
        slot, doc, held = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (slots, texts, counts))
        doc = doc.astype(np.int64)
        order = np.lexsort((slot, held, doc))
        slot, doc = slot[order], doc[order]
        several = np.bincount(doc, minlength=len(n))
        place = n[doc] - several[doc] + np.arange(len(doc)) - (np.cumsum(several) - several)[doc]  # shingles of one text come first
        size = n - np.array([least_common(int(x), similarity) for x in n]) + 1
        kept = place < size[doc]
        slot, doc, place = slot[kept], doc[kept], place[kept]
        own, starts = np.unique(doc, return_index=True)
        offsets = pa.array(np.append(starts, len(doc)).astype(np.int32), pa.int32())
        slack = differ_share(similarity) * n[doc] - place
        some = [head["marks"][i] for i in own]
        folds = np.array([folded(m) for m in some], np.int64).reshape(-1, len(FOLDED))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (slot, slack)]
        columns = {"doc": pa.array(docs[own]), "tag": pa.array(tags[own]), "n": pa.array(n[own]), "sigs": lists[0], "slacks": lists[1], "marks": pa.array(some, pa.binary())}
        return pa.table(columns | {m: pa.array(folds[:, i]) for i, m in enumerate(FOLDED)})

    return run


def prefixes(rows: DataFrame, words: int, similarity: float, total: int, slots: int = SLOTS) -> DataFrame:
    """(doc, tag, n, sigs, slacks, marks, FOLDED) of the texts whose prefixes hold a shingle that is not theirs alone.

    rows: (doc, tag, data), each text once.  total: about how many shingles they hold.
    """
    buckets = 1 << max(BUCKETS.bit_length() - 1, (total // BUCKET).bit_length())
    asked = rows.select("doc", "tag", "data").mapInArrow(lean(_asked(words, buckets, min(slots, buckets << 32))), _ENTRIES)
    counted = asked.groupBy("key").applyInArrow(lean_group(_counted), _ENTRIES)
    schema = "doc long, tag long, n long, sigs array<long>, slacks array<double>, marks binary, " + ", ".join(f"{m} long" for m in FOLDED)
    return counted.groupBy("chunk").applyInArrow(lean_group(_ordered(similarity, buckets)), schema)


def sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) from (node, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return rows.select("node", "data").mapInArrow(lean(run), "node long, shingles binary")


def members(prefixes: DataFrame) -> DataFrame:
    """(sig, node, n, slack, FOLDED): the prefixes' shingles that another text holds with slack enough."""
    each = prefixes.select("node", "n", *FOLDED, F.explode(F.arrays_zip("sigs", "slacks")).alias("at")).select(F.col("at.sigs").alias("sig"), "node", "n", F.col("at.slacks").alias("slack"), *FOLDED)
    shared = each.groupBy("sig").agg(F.count("*").alias("held"), F.max("slack").alias("most")).where("held > 1").select("sig", "most")
    return each.join(shared.hint("merge"), "sig").where(F.col("slack") + F.col("most") >= -_EPS).drop("most")


def _sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _bits(a: str, b: str) -> Column:
    """The bits in which folded marks differ: columns of FOLDED after the prefixes a and b."""
    return sum((F.bit_count(F.col(a + m).bitwiseXOR(F.col(b + m))) for m in FOLDED[1:]), F.bit_count(F.col(a + FOLDED[0]).bitwiseXOR(F.col(b + FOLDED[0]))))


def _fit(a: str, b: str, similarity: float) -> Column:
    """Whether sizes, slacks and marks of two members let them be alike."""
    bound = differ_share(similarity) * (F.col(f"{a}n") + F.col(f"{b}n")) + _EPS
    return _sizes(f"{a}n", f"{b}n", similarity) & (F.col(f"{a}slack") + F.col(f"{b}slack") >= -_EPS) & (_bits(a, b) <= bound)


def with_centres(named: DataFrame, turn: int, similarity: float, most: int = 8) -> DataFrame:
    """(u, v): members of other groups than their bucket's centre, each with ``most`` of its buckets' centres; every turn draws others.

    named: members with the columns root.
    """
    own = ["node", "n", "root", "slack", *FOLDED]
    pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *own))
    centres = named.groupBy("sig").agg(pick.alias("centre")).select("sig", *(F.col(f"centre.{c}").alias(f"c_{c}") for c in own))
    met = named.withColumnsRenamed({c: f"o_{c}" for c in own}).join(centres.hint("merge"), "sig").where((F.col("o_root") != F.col("c_root")) & _fit("o_", "c_", similarity))
    drawn = F.array_sort(F.collect_set(F.struct(F.xxhash64("c_node", F.lit(turn)).alias("h"), "c_node")))
    pairs = met.groupBy("o_node").agg(F.slice(drawn, 1, most).alias("drawn")).select("o_node", F.explode("drawn.c_node").alias("c_node"))
    return pairs.select(F.greatest("o_node", "c_node").alias("u"), F.least("o_node", "c_node").alias("v")).distinct()


def across_groups(named: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all that meet in a bucket, fit and are in different groups.

    Groups meet first, by what holds for all their members there, so what is in one makes no pairs; then the smaller
    one's members look for fitting ones of the larger.
    """
    own = ["node", "n", "slack", *FOLDED]
    groups = named.groupBy("sig", "root").agg(F.count("*").alias("many"), F.max("slack").alias("slack"), F.min("n").alias("low"), F.max("n").alias("high"), *(F.min(m).alias(m) for m in FOLDED))
    counted = groups.groupBy("sig").agg(F.count("*").alias("held")).where("held > 1").select("sig")
    groups = groups.join(counted.hint("merge"), "sig")
    a, b = (groups.withColumnsRenamed({c: f"{side}_{c}" for c in groups.columns if c != "sig"}) for side in "ab")
    near = (F.col("a_low") <= F.col("b_high") / similarity + _EPS) & (F.col("b_low") <= F.col("a_high") / similarity + _EPS)
    single = (F.col("a_many") == 1) & (F.col("b_many") == 1)  # then the least of a column is the member's
    bound = differ_share(similarity) * (F.col("a_low") + F.col("b_low")) + _EPS
    first = F.struct("a_many", "a_root") < F.struct(F.col("b_many").alias("a_many"), F.col("b_root").alias("a_root"))
    both = a.join(b.hint("merge"), "sig").where(first & near & (F.col("a_slack") + F.col("b_slack") >= -_EPS) & (~single | (_bits("a_", "b_") <= bound)))
    left = named.select("sig", F.col("root").alias("a_root"), *(F.col(c).alias(f"l_{c}") for c in own))
    right = named.select("sig", F.col("root").alias("b_root"), *(F.col(c).alias(f"r_{c}") for c in own))
    met = both.select("sig", "a_root", "b_root").join(left.hint("merge"), ["sig", "a_root"]).join(right.hint("merge"), ["sig", "b_root"]).where(_fit("l_", "r_", similarity))
    return met.select(F.greatest("l_node", "r_node").alias("u"), F.least("l_node", "r_node").alias("v")).distinct()


def possible(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that sizes and marks don't rule out; marked: (node, n, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = differ_share(similarity) * batch.column(2).to_numpy()  # differing members of alike sets
            bits = [differing(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(np.array(bits, np.int64) <= most + 1e-6))

    left, right = (marked.withColumnsRenamed({"node": end, "n": f"n{end}", "marks": f"m{end}"}) for end in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), "mu", "mv")
    return both.mapInArrow(lean(run), "u long, v long")


def alike(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least that Jaccard similarity; shingles: (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common + 1e-9 >= similarity * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (shingles.withColumnsRenamed({"node": end, "shingles": name}) for end, name in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long")
