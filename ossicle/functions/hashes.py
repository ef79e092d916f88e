"""md5 of many short texts at once on numpy: the first eight hexadecimal digits as a number."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Rows worked on together: what a step needs stays in a core's cache.
ROWS = 4096


def _block(words: list, n: int) -> np.ndarray:
    """The first word of the digests of one block each; a word is a number for all rows or an array."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif part == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif part == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[part] % 16]
        np.add(f, a, out=f)
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f), np.add(f, np.uint32(_K[i]), out=f)
        else:
            np.add(f, np.uint32((w + _K[i]) & 0xFFFFFFFF), out=f)
        s = _TURNS[part][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


def first_digits(head: bytes, tails: np.ndarray) -> np.ndarray:
    """uint32 of md5(head + tail)'s first eight digits; tails: (rows, bytes) uint8, all of one length."""
    n, size = tails.shape
    whole = len(head) + size
    if whole > 55:
        return np.array([int(hashlib.md5(head + t.tobytes()).hexdigest()[:8], 16) for t in tails], np.uint32)
    block = np.zeros((n, -(-(whole + 1) // 4) * 4), np.uint8)
    block[:, : len(head)], block[:, len(head) : whole], block[:, whole] = np.frombuffer(head, np.uint8), tails, 0x80
    parts = block.view("<u4")
    first = len(head) // 4  # the words before are the same for all rows
    words: list = [int(parts[0, i]) if i < first and n else np.ascontiguousarray(parts[:, i]) for i in range(parts.shape[1])]
    words += [0] * (14 - len(words)) + [whole * 8, 0]
    return _block(words, n)
