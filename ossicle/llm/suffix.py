"""Suffix-array deduplication of bytes by deep-shallow sorting (after Manzini and Ferragina, 2004).

A document loses each byte that a ``length``-byte string covers which also starts in a document with a
smaller id.  Candidates come from :mod:`repeats`; a shard sorts the suffixes at its window places:
multikey quicksort to a shallow depth, eight bytes a step and all groups at once, then blind
tries for the groups whose common prefix is longer.  Suffixes whose neighbours share ``length`` bytes
are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .work import Workspace, lean

SHALLOW = 24


class BlindTrie:
    """A Patricia trie of byte strings of one length: nodes hold only where their children branch.

    A search follows branching bytes alone, compares once with the leaf it reaches, and
    thus learns the common prefix with the nearest string.
    """

    def __init__(self):
        self.root = None  # a leaf (bytes), or [depth, {byte: node}]

    def insert(self, text: bytes) -> None:
        node = self.root
        if node is None:
            self.root = text
            return
        while type(node) is list:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node == text:
            return
        common = 0
        while text[common] == node[common]:
            common += 1
        above, node = None, self.root
        while type(node) is list and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if type(node) is list and node[0] == common:
            node[1][text[common]] = text
            return
        other = node
        while type(other) is list:
            other = next(iter(other[1].values()))
        fresh = [common, {other[common]: node, text[common]: text}]
        if above is None:
            self.root = fresh
        else:
            above[1][text[above[0]]] = fresh

    def ordered(self) -> list[tuple[bytes, int]]:
        """The strings in order, each with the length of its common prefix with the one before (-1 for the first)."""
        out, todo = [], [(self.root, -1)] if self.root is not None else []
        while todo:
            node, shared = todo.pop()
            if type(node) is list:
                children = sorted(node[1].items())
                todo += [(child, node[0]) for _, child in children[:0:-1]]
                todo.append((children[0][1], shared))
            else:
                out.append((node, shared))
        return out


def words(text: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the text."""
    padded = np.concatenate((text, np.zeros(beyond + 8, np.uint8))).astype(np.uint64)
    out = padded[: len(padded) - 7].copy()
    for j in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[j : len(padded) - 7 + j]
    return out


def sort(text: np.ndarray, places: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): places by their first ``depth`` bytes, and the common prefix with the one before, up to depth.

    The text has at least depth bytes from each place on.
    """
    n = len(places)
    at = words(text, depth)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    shallow = min(shallow, depth // 8 * 8)
    for d in range(0, shallow, 8):
        where = np.flatnonzero(open_)
        if not len(where):
            break
        key = at[places[order[where]] + d]
        by = np.lexsort((key, group[where]))
        order[where] = order[where][by]
        key, g = key[by], group[where]
        same = g[1:] == g[:-1]
        differ = key[1:] ^ key[:-1]
        lcp[where[1:][same]] = d + np.where(differ[same] == 0, 8, _equal_bytes(differ[same]))
        new = ~same | (differ != 0)
        first = np.concatenate(([True], new))
        group[where] = where[np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))]
        single = first & np.append(new, True)
        open_[where] = ~single
    where = np.flatnonzero(open_)
    if not len(where) or shallow >= depth:
        return order, lcp
    # deep: what is equal throughout needs no trie
    start = places[order[where]] + shallow
    rest = np.stack([at[start + d] for d in [*range(0, depth - shallow - 7, 8), depth - shallow - 8] if d >= 0] or [at[start] >> np.uint64(64 - 8 * (depth - shallow))])
    g = group[where]
    heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    sizes = np.diff(np.append(heads, len(where)))
    equal = (rest == np.repeat(rest[:, heads], sizes, axis=1)).all(0)
    uniform = np.logical_and.reduceat(equal, heads)
    inner = np.ones(len(where), bool)
    inner[heads] = False
    lcp[where[inner & np.repeat(uniform, sizes)]] = depth
    raw = text.tobytes()
    for h, size in zip(heads[~uniform], sizes[~uniform]):
        mine = order[where[h : h + size]]
        tails = [raw[p : p + depth - shallow] for p in (places[mine] + shallow).tolist()]
        holders: dict[bytes, list[int]] = {}
        for tail, i in zip(tails, mine.tolist()):
            holders.setdefault(tail, []).append(i)
        trie = BlindTrie()
        for tail in holders:
            trie.insert(tail)
        to = where[h]
        for tail, shared in trie.ordered():
            members = holders[tail]
            order[to : to + len(members)] = members
            lcp[to + 1 : to + len(members)] = depth
            if shared >= 0:
                lcp[to] = shallow + shared
            to += len(members)
    return order, lcp


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero numbers."""
    out = np.zeros(len(differ), np.int64)
    for j in range(1, 8):
        out += differ < (np.uint64(1) << np.uint64(64 - 8 * j))
    return out


def groups(text: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of the runs, the same where its ``length`` bytes are the same."""
    places = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    order, lcp = sort(text, places, length)
    number = np.empty(len(places), np.int64)
    number[order] = np.cumsum(lcp < length) - 1
    return number


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for data, start, count in zip(*(batch.column(i) for i in (1, 2, 3))):
                data = data.as_py()
                removed = runs = 0
                if start.is_valid:
                    covered = repeats.mask(start.as_py(), count.as_py(), len(data), length)
                    removed = int(covered.sum())
                    runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                for x, v in zip(out, (len(data), removed, runs, hashlib.sha256(kept if removed else data).hexdigest())):
                    x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names)

    return run


def _with_spans(docs: DataFrame, length: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, tag, data, start, count) with packed spans or nulls."""
    rows = repeats.keyed(docs, id_col, text_col)
    search = repeats.Search(length, k, words=False, earlier=True)
    found = repeats.spans(rows, search, groups, Workspace(docs.sparkSession, "suffix"))
    return rows.join(found.hint("merge"), ["doc", "tag"], "left")


def removed_digests(docs: DataFrame, length: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Null texts are empty.  Rows with a null id keep all and take nothing from others; rows with one
    id take nothing from each other.  Other columns are ignored.
    """
    joined = _with_spans(docs, length, k, id_col, text_col).select("doc_id", "data", "start", "count")
    return joined.mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 50, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from its texts; null texts stay null.

    A character of which a byte goes is dropped whole, so that the text stays valid UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, start, count in zip(*(batch.column(i) for i in (0, 1, 2))):
                data = data.as_py()
                if start.is_valid:
                    data = np.frombuffer(data, np.uint8)[~repeats.mask(start.as_py(), count.as_py(), len(data), length)].tobytes()
                texts.append(data.decode("utf-8", "ignore"))
            rest = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *rest], ["_cut", *batch.schema.names[3:]])

    others = [c for c in docs.columns if c != text_col]
    rows = docs.withColumn("_row", F.struct(F.lit(1).alias("_one"), *others)).withColumn("_none", F.col(text_col).isNull())
    search = repeats.Search(length, k, words=False, earlier=True)
    found = repeats.spans(repeats.keyed(docs, id_col, text_col), search, groups, Workspace(docs.sparkSession, "suffix"))
    carried = repeats.keyed(rows.select(F.col(id_col), F.col(text_col), "_row", "_none"), id_col, text_col, ["_row", "_none"])
    joined = carried.join(found.hint("merge"), ["doc", "tag"], "left").select("data", "start", "count", "_row", "_none")
    kinds = f"_cut string, _row {dict(joined.dtypes)['_row']}, _none boolean"
    cut = joined.mapInArrow(lean(run), kinds)
    text = F.when(F.col("_none"), F.lit(None)).otherwise(F.col("_cut"))
    return cut.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
