"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant within
``radius / 2`` flips of each.  So every distinct fingerprint emits all variants
within half the radius, and equal variants meet in the shuffle.  All fingerprints
that meet at one variant lie within half the radius of it and hence within the radius of
each other: a star to the least of them has all their links.  A variant has at most as
many fingerprints as the ball has members (65 for radius 2), so no group is large,
however many documents share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import overlap, repeats
from .components import components
from .work import Workspace, lean, likely, sweep, texts

SEED = 42


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 of the word shingles of ASCII-lower-cased UTF-8 text, repeats included."""
    words = data.lower().split()  # for bytes: A-Z, and white space \x20\x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row, nulls included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(x.as_py(), words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def ball(flips: int) -> list[int]:
    """Signed 64-bit masks with at most that many bits set."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that connect what lies within radius bits of each other; distinct: one column fp."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*map(F.lit, ball(radius // 2)))
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("v"))
    return met.where((F.col("fp") > F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius)).select(F.col("fp").alias("u"), "v")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lower-case hex digits.  component_id: the smallest doc_id that links of
    at most ``radius`` differing bits reach, the row's own included.  Null and wordless
    texts have fingerprint zero and are linked like any other; a row whose doc_id is null
    keeps it and still counts as a link, and its component_id is null only if no row with an id
    is reached.  Repeated rows are returned as often as they come; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.write(fingerprints(docs, words, id_col, text_col), "rows")
    distinct = work.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius), work)
    labelled = distinct.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = work.write(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = work.write(labelled.join(smallest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketched(words: int):
    """The digest, fingerprint and number of shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, sizes = [], [], []
            for x in batch.column(3):
                data = x.as_py()
                hashes = overlap.word_shingles(data, words)
                digests.append(xxhash.xxh3_128_digest(b" ".join(data.lower().split())))
                prints.append(fingerprint(hashes))
                sizes.append(len(np.unique(hashes)))
            columns = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "tag", "digest", "fp", "n"])

    return run


def _ball_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v) that connect the nodes whose fingerprints are within radius bits of each other: see :func:`links`."""
    centres = nodes.groupBy("fp").agg(F.min("node").alias("centre"))
    same = nodes.join(centres.hint("merge"), "fp").where("node > centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    ends = (centres.withColumnsRenamed({"fp": a, "centre": b}).hint("merge") for a, b in (("u", "cu"), ("v", "cv")))
    met = links(centres.select("fp"), radius).join(next(ends), "u").join(next(ends), "v").select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v"))
    return same.unionByName(met)


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, turns: int = 2, slots: int = overlap.SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, tag, root): rows by id and text, with the group that near copies form.

    Texts of the same lower-cased words are one; wordless ones, too.  Two texts are alike if the Jaccard similarity
    of their word shingles is at least ``similarity``, and a group is what such links connect.  No link between
    groups is lost: texts whose fingerprints are within ``radius`` bits meet first, by ball
    hashing, and are verified on their shingles; ball hashing can't reach a similarity of 0.8, some 10 of
    64 bits, so exact prefixes (see :mod:`overlap`) complete it.  There, ``turns`` times each text is compared with a few
    of its buckets' centres only, which joins most of them, and at last all that still meet in different groups.
    """
    work = Workspace(docs.sparkSession, "alike")
    keyed = repeats.keyed(docs, id_col, text_col)
    rows = work.write(keyed.mapInArrow(lean(_sketched(words)), "doc_id long, doc long, tag long, digest binary, fp long, n long"), "sketched")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "tag", "fp", "n"))
    nodes = rows.groupBy("digest").agg(least.alias("own")).select("digest", "own.*").withColumn("node", F.monotonically_increasing_id())
    nodes = work.write(nodes, "nodes")
    times = rows.groupBy("doc", "tag").agg(F.count("*").alias("times"))
    repeated = not times.where("times > 1").isEmpty()
    once = (lambda df, *by: df.dropDuplicates([*by])) if repeated else (lambda df, *by: df)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    places = nodes.select("doc", "tag", "node").hint("merge")
    copies = times.join(places, ["doc", "tag"], "left").where("node is null or times > 1")
    some, alone = likely(keyed.select("doc", "tag", "data"), copies, ["doc", "tag"])
    own = alone.unionByName(once(some.join(places, ["doc", "tag"]).select("doc", "tag", "data"), "doc", "tag"))
    found = overlap.prefixes(own, words, similarity, total, slots)
    prefixes = work.write(found.join(places, ["doc", "tag"]).drop("doc", "tag"), "prefixes")
    del copies, some, alone, own, found
    sweep(docs.sparkSession)
    members = work.write(overlap.members(prefixes), "members")
    sweep(docs.sparkSession)

    def linked(pairs: DataFrame, turn: int) -> DataFrame:
        """The pairs that are alike: sizes and marks rule out most others, and what is left compares its shingles."""
        left = work.write(overlap.possible(pairs, prefixes.select("node", "n", "marks"), similarity), f"left{turn}")
        if left.isEmpty():
            return left
        wanted = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node").select("node", "doc", "tag")
        some, _ = likely(keyed.select("doc", "tag", "data"), wanted, ["doc", "tag"])
        shingles = work.write(once(overlap.sets(some.join(wanted, ["doc", "tag"]), words), "node"), "shingles")
        del wanted, some, _
        sweep(docs.sparkSession)
        found = work.write(overlap.alike(left, shingles, similarity), f"found{turn}")
        work.drop("shingles")
        sweep(docs.sparkSession)
        return found

    def named(roots: DataFrame) -> DataFrame:
        found = members.join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
        return work.write(found.select(*members.columns, F.coalesce("root", "node").alias("root")), "named")

    first = overlap.with_centres(members.withColumn("root", F.col("node")), 0, similarity)
    sharing = nodes.join(prefixes.select("node").hint("merge"), "node").select("node", "fp")  # the others are like none
    roots = components(linked(first.unionByName(_ball_pairs(sharing, radius)).distinct(), 0), work)
    for turn in range(1, turns + 1):
        now = named(roots)
        edges = linked(overlap.across_groups(now, similarity) if turn == turns else overlap.with_centres(now, turn, similarity), turn)
        if not edges.isEmpty():
            roots = components(roots.unionByName(edges), Workspace(docs.sparkSession, "alike-groups"))
    for table in ("named", "members", "prefixes"):
        work.drop(table)
    grouped = nodes.select("digest", "node").join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
    grouped = work.write(grouped.select("digest", F.coalesce("root", "node").alias("root")), "grouped")
    return rows.select("doc_id", "doc", "tag", "digest").join(grouped, "digest").drop("digest")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, null ids last.

    Of rows with one id, that of the smallest hash of its text stays, and one of rows that are equal in both.
    """
    work = Workspace(docs.sparkSession, "near-copies")
    groups = alike(docs, words, similarity, id_col=id_col, text_col=text_col, **more)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc", "tag"))
    winners = groups.groupBy("root").agg(best.alias("own")).select("own.doc", "own.tag", "own.none")
    counted = groups.groupBy("doc", "tag", F.col("doc_id").isNull().alias("none")).agg(F.count("*").alias("n"))
    winners = work.write(winners.join(counted, ["doc", "tag", "none"]), "winners")
    others = work.write(counted.join(winners.where("n = 1"), ["doc", "tag"], "left_anti").select("doc", "tag"), "others")
    key = repeats.keyed(docs.select(F.col(id_col), F.col(text_col), F.struct(*docs.columns).alias("_row")), id_col, text_col, ["_row"])
    some, alone = likely(key.select("doc", "tag", "_row"), others, ["doc", "tag"])
    chosen = some.join(winners.hint("merge"), ["doc", "tag"]).select("doc", "tag", "n", "_row")
    once = alone.select("_row.*").unionByName(chosen.where("n = 1").select("_row.*"))
    if winners.where("n > 1").isEmpty():
        return once
    return once.unionByName(chosen.where("n > 1").dropDuplicates(["doc", "tag"]).select("_row.*"))
