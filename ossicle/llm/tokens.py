"""Token ids of whole texts, as the tokenizers library gives them for a tokenizer file.

All ids come from the library.  For byte-level BPE files of the common kind (no normaliser, the usual
split pattern) a text is first cut at places that no token can span, and every distinct unit
is encoded once and then looked up, which is several times as fast.  Such places are

* before a space or line end after an ASCII sign, letter or digit or a letter of Latin-1: tokens hold white space only
  in front, and the pattern looks ahead but never back, so what follows does not depend on what came before;
* between a Latin letter and an ASCII sign after it other than the apostrophe, which are of no common class.

Units of up to 15 bytes are looked up many at a time in a table under their very bytes, longer ones in a dict.
Texts that hold a special token of the file, and all texts under other kinds of files, go to the library whole.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_encoders: dict[tuple, Encoder] = {}
#: Slots of a process's table of short units, a power of two, of which FULL may be taken; bytes of text handled at once.
SLOTS, FULL, GROUP = 1 << 20, 0.75, 1 << 18
#: Longer units held by a process, and the longest that is.
MOST_UNITS, LONGEST = 1 << 16, 64
#: One piece of the split, or a line end and one.
_PLAIN = re.compile(rb"[ \n]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The letters that stand for the bytes in such files: their own, or those from U+0100 on in turn.
_LETTERS = "".join(chr(b if b in _SHOWN else 256 + sum(c not in _SHOWN for c in range(b))) for b in range(256))


def _bytes(of: str) -> np.ndarray:
    """Whether a byte is among those of a class of ASCII."""
    return np.array([bool(re.match(f"[{of}]", chr(b))) and b < 128 for b in range(256)])


_GAP, _SHOWING, _LATIN, _SIGN = _bytes(" \n"), _bytes("!-~"), _bytes("A-Za-z"), _bytes(r"!-&(-/:-@\[-`{-~")
#: Masks of the first n bytes of a word of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether a unit starts at a byte, from the bytes before it."""
    at = np.zeros(len(data), bool)
    two = np.zeros(len(data), bool)  # the second byte of a character from U+00C0 to U+00FF
    two[1:] = data[:-1] == 0xC3
    letter = _LATIN[data] | (two & (data != 0x97) & (data != 0xB7))
    at[1:] = (_GAP[data[1:]] & (_SHOWING[data] | two)[:-1]) | (_SIGN[data[1:]] & letter[:-1])
    return at


class _Library:
    """The ids that the library gives for a unit."""

    def __init__(self, tokenizer):
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.line_end = self.encode("\n", add_special_tokens=False).ids

    def __call__(self, unit: bytes) -> list[int]:
        if not _PLAIN.match(unit):
            return self.encode(unit.decode(), add_special_tokens=False).ids
        if unit[0] == 10:
            return self.line_end + self(unit[1:])
        return [t.id for t in self.tokenize(codecs.charmap_decode(unit, "strict", _LETTERS)[0])]


class _Units(dict):
    """The ids of long units; what is missing is encoded by the library."""

    def __init__(self, library: _Library):
        super().__init__()
        self.library = library

    def __missing__(self, unit: bytes) -> np.ndarray:
        found = np.array(self.library(unit), "<u4")
        if len(unit) <= LONGEST:
            if len(self) >= MOST_UNITS:
                self.clear()
            self[unit] = found
        return found


class _Table:
    """Short units by open addressing: two words hold a unit's bytes and, in the last byte, their number.

    A value is 16 times the place of its ids in the pool, plus their number, which is at most that of the bytes.
    """

    def __init__(self, library: _Library):
        self.library, self.bits = library, SLOTS.bit_length() - 1
        self.keys, self.values = np.zeros(SLOTS, np.complex128), np.zeros(SLOTS, np.int64)  # complex: 16 bytes that move at once
        self.pool, self.used, self.taken = np.empty(1 << 12, "<u4"), 0, 0

    def room(self, n: int) -> None:
        """See that n more ids fit the pool."""
        if self.used + n > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(self.used // 2 + n, "<u4")))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        out, left, at = np.full(len(first), -1, np.int64), None, self.slots(first, second)
        while len(at):
            held = self.keys.take(at).view(np.uint64)
            hit = (held[::2] == first) & (held[1::2] == second)
            where = np.flatnonzero(hit)
            out[where if left is None else left[where]] = self.values.take(at[where])
            on = np.flatnonzero(~hit & (held[1::2] != 0))
            left, at, first, second = on if left is None else left[on], (at[on] + 1) & (SLOTS - 1), first[on], second[on]
        return out

    def put(self, first: np.ndarray, second: np.ndarray, values: np.ndarray) -> None:
        """Add different units that are not there."""
        self.taken += len(first)
        keys, at = self.keys.view(np.uint64).reshape(-1, 2), self.slots(first, second)
        while len(at):
            free = np.flatnonzero(keys[at, 1] == 0)
            self.values[at[free]] = free  # one of those that meet stays
            won = free[self.values[at[free]] == free]
            keys[at[won], 0], keys[at[won], 1], self.values[at[won]] = first[won], second[won], values[won]
            lost = np.ones(len(at), bool)
            lost[won] = False
            at, first, second, values = (at[lost] + 1) & (SLOTS - 1), first[lost], second[lost], values[lost]

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = self.taken = 0


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units, self.special = None, []
        spec = json.loads(self.tokenizer.to_str())
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if usual and model["type"] == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and not spec.get("truncation"):
            library = _Library(self.tokenizer)
            self.units, self.table = _Units(library), _Table(library)
            self.special = [x["content"].encode() for x in spec["added_tokens"]]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text.encode()])[0]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of some UTF-8 texts."""
        data = b"".join(texts)
        try:
            data.decode()
            sound = not any(0x80 <= x[0] < 0xC0 for x in texts if x)
        except UnicodeDecodeError:
            sound = False
        if not sound:
            texts = [x.decode("utf-8", "replace").encode() for x in texts]
            data = b"".join(texts)
        if self.units is not None and not any(s in data for s in self.special):
            return self._by_units(texts)
        whole = [self.units is None or any(s in x for s in self.special) for x in texts]
        cut = iter([] if all(whole) else self._by_units([x for x, w in zip(texts, whole) if not w]))
        return [np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, "<u4") if w else next(cut) for x, w in zip(texts, whole)]

    def _by_units(self, texts: list[bytes]) -> list[np.ndarray]:
        table, data = self.table, b"".join(texts)
        if not data:
            return [np.empty(0, "<u4") for _ in texts]
        if table.taken >= FULL * SLOTS:
            table.clear()
        sizes = np.array([len(x) for x in texts])
        ends = np.cumsum(sizes)
        padded = data + bytes(16)
        at = _cuts(np.frombuffer(data, np.uint8))
        at[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(at)
        stops = np.append(starts[1:], len(data))
        lengths = stops - starts
        words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        first = words[starts] & _FIRST[np.minimum(lengths, 8)]
        second = (words[starts + 8] & _FIRST[np.clip(lengths - 8, 0, 7)]) | (lengths.astype(np.uint64) << np.uint64(56))
        short = lengths <= 15
        if short.all():
            values = table.find(first, second)
        else:
            values = np.full(len(starts), -1, np.int64)
            values[short] = table.find(first[short], second[short])
        place, count = values >> 4, values & 15
        missing = np.flatnonzero(values < 0)
        missing = np.concatenate((missing[short[missing]], missing[~short[missing]]))  # what is kept goes first
        if len(missing):
            new: dict[bytes, int] = {}
            which = np.array([new.setdefault(data[i:j], len(new)) for i, j in zip(starts[missing].tolist(), stops[missing].tolist())])
            parts = [table.library(u) if len(u) <= 15 else self.units[u] for u in new]
            n = np.array([len(x) for x in parts])
            table.room(int(n.sum()))
            places = table.used + np.cumsum(n) - n
            table.pool[table.used : table.used + n.sum()] = np.fromiter((i for x in parts for i in x), "<u4", int(n.sum()))
            place[missing], count[missing] = places[which], n[which]
            example = np.empty(len(new), np.int64)
            example[which[::-1]] = missing[::-1]
            kept = np.flatnonzero(short[example])[: max(int(FULL * SLOTS) - table.taken, 0)]
            if len(kept):
                table.put(first[example[kept]], second[example[kept]], 16 * places[kept] + n[kept])
                table.used = int(places[kept[-1]] + n[kept[-1]])
        upto = np.cumsum(count)
        ids = table.pool[np.repeat(place - (upto - count), count) + np.arange(upto[-1])]
        if len(table.pool) > 2 * table.used + (1 << 20):  # long units took most of it
            table.pool = table.pool[: table.used].copy()
        tokens = np.concatenate(([0], upto))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return [ids[i:j] for i, j in zip(tokens[:-1].tolist(), tokens[1:].tolist())]


def encoder(path: str) -> Encoder:
    key = (path, os.path.getmtime(path))
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def forget() -> None:
    """Drop the encoders that this process has kept."""
    _encoders.clear()


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of a column of UTF-8 texts."""
    enc, texts, size, done = encoder(path), [], 0, 0
    for x in column:
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= GROUP:
            yield from enumerate(enc.encode_all(texts), done)
            texts, size, done = [], 0, done + len(texts)
    yield from enumerate(enc.encode_all(texts), done)
