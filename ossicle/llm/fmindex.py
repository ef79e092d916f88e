"""Removal of repeated word windows by compressed FM-indexes.

A document loses each word that a window of ``length`` words covers whose word sequence
also starts anywhere else, in the same document or another.  Candidates come from :mod:`repeats`; each
shard builds an FM-index of its runs, and streams them through backward search: the matching
statistic of a window is how far it reaches, from its last word back, while the index still holds two
places or more; windows that reach ``length`` are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .work import Workspace


class WaveletTree:
    """Ranks of symbols in a sequence, level by level of their bits (a wavelet matrix).

    Each level holds one bit a symbol, packed, and a count before each 64 bits.
    """

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        x = sequence.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros(-(-(len(x) + 1) // 64) * 64, np.uint8)
            padded[: len(x)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate((x[bit == 0], x[bit == 1]))
        symbols = np.arange(sigma, dtype=np.int64)
        self.origin = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            block = places >> 6
            inside = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][block] + np.bitwise_count(self.bits[i][block] & inside)
            up = (symbols >> (self.levels - 1 - i)) & 1
            places = np.where(up == 1, self.zeros[i] + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, places) - self.origin[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text by what follows, up to depth symbols at least (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    have = 1
    order = np.argsort(rank, kind="stable")
    while have < depth:
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        have *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Backward search of patterns up to ``depth`` symbols; symbols are 0 (a separator) to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        order = suffix_order(text, depth + 1)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]))
        self.size = len(text)

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(reach, low): how many symbols back from each end (exclusive) match at two places or more, up to
        depth, and where the interval of that match begins."""
        reach, low = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(1, depth + 1):
            symbol = text[ends[live] - step].astype(np.int64)
            both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
            lo, hi = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
            on = hi - lo >= 2
            live, lo, hi = live[on], lo[on], hi[on]
            reach[live], low[live] = step, lo
            if not len(live):
                break
        return reach, low


def groups(text: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of the runs, the same where its words are the same."""
    lens = count + length - 1
    starts = np.cumsum(lens + 1) - (lens + 1)
    inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    names, ids = np.unique(text[np.repeat(begin, lens) + inner], return_inverse=True)
    joined = np.zeros(int((lens + 1).sum()), np.int64)
    joined[np.repeat(starts, lens) + inner] = ids + 1  # a separator follows each run
    index = FMIndex(joined, len(names) + 1, length)
    n = int(count.sum())
    ends = np.arange(n) + np.repeat(starts - (np.cumsum(count) - count), count) + length
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 17):
        reach, low = index.statistics(joined, ends[at : at + (1 << 17)], length)
        out[at : at + (1 << 17)] = np.where(reach >= length, low, -1)
    alone = np.flatnonzero(out < 0)
    out[alone] = len(joined) + np.arange(len(alone))
    return np.unique(out, return_inverse=True)[1]


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for data, start, count in zip(*(batch.column(i) for i in (1, 2, 3))):
                words = data.as_py().split()
                kept = words
                if start.is_valid:
                    covered = repeats.mask(start.as_py(), count.as_py(), len(words), length)
                    kept = [w for w, gone in zip(words, covered.tolist()) if not gone]
                for x, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, [pa.int64(), pa.int64(), pa.string()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def removed_digests(docs: DataFrame, length: int = 35, k: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    Words are runs of other characters than \\x20 and \\x09-\\x0D, unchanged; null texts have none.  Rows with a null
    id and repeated rows count like any other: a repeated row loses all its windows.  Other columns are ignored.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    search = repeats.Search(length, k, words=True, earlier=False)
    found = repeats.spans(rows, search, groups, Workspace(docs.sparkSession, "fmindex"))
    joined = rows.join(found.hint("merge"), ["doc", "tag"], "left").select("doc_id", "data", "start", "count")
    return joined.mapInArrow(_digest(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
