"""Content-chosen anchors for finding windows that repeat across a corpus.

A *window* is ``length`` consecutive symbols (bytes, or words) of one text.
Each window picks one of its ``k``-symbol grams, the leftmost of smallest
hash, as its anchor.  The choice depends on the window's content alone, so two
equal windows always pick equal anchors at the same place; consecutive
windows mostly share one, so a text has about ``2 / (length - k + 2)`` anchors
per symbol.  A *run* is a maximal stretch of windows with one anchor.  Comparing
runs instead of windows makes the exact search for repeated windows cheap
enough to shuffle.
"""

from __future__ import annotations

import numpy as np

#: Symbols handled at once; the place in a slab takes the low bits of a sort key.
SLAB_BITS = 19
SLAB = 1 << SLAB_BITS
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for arrays of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2**64, up to a slab."""
    if which not in _powers:
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        size = SLAB + 1
        both = []
        for b in (base, inverse):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:  # doubling: out[done:2*done] = out[:done] * b**done
                take = min(done, size - done)
                out[done : done + take] = out[:take] * np.uint64(pow(b, done, 1 << 64))
                done += take
            both.append(out)
        _powers[which] = (both[0], both[1])
    return _powers[which]


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values * base**i, for :func:`spans`; values: one slab at most."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(which)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, stop): equal content gives equal hashes wherever it stands."""
    return (sums[stop] - sums[start]) * powers(which)[1][start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def runs(first: np.ndarray, second: np.ndarray, ends: np.ndarray, length: int, k: int):
    """The runs of a slab of concatenated texts.

    first, second: two independent random 64-bit values for each symbol.  ends: where
    each text ends.  Returns arrays (text, start, count, anchor hash, content hash, lead):
    the windows start, start + 1, ... start + count - 1 (places in the slab) share the anchor at
    start + lead, and the content hash covers all their symbols and the lead.
    """
    n = len(first)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    sums = prefix(first, 0)
    grams = mix((sums[k:] - sums[:-k]) * powers(0)[1][: n - k + 1])
    low = np.uint64(SLAB - 1)
    keys = (grams & ~low) | np.arange(n - k + 1, dtype=np.uint64)
    best = (sliding_min(keys, length - k + 1) & low).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    usable = np.maximum(ends - starts - length + 1, 0)
    held = usable > 0
    # the windows that lie in one text, as one array of places
    texts = np.flatnonzero(held)
    sizes = usable[held]
    before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(sizes.sum()) + np.repeat(starts[held] - before, sizes)
    anchor = best[place]
    new = np.empty(len(place), bool)
    if len(place):
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[before] = True
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(place)))
    start = place[at]
    text = texts[np.searchsorted(before, at, side="right") - 1] if len(at) else np.empty(0, np.int64)
    lead = anchor[at] - start
    content = mix(spans(prefix(second, 1), 1, start, start + count - 1 + length) + (count + (lead << 20)).astype(np.uint64))
    return text, start, count, grams[anchor[at]], content, lead
