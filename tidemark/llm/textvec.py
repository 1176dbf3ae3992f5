"""Words of whole texts as arrays: vectorised splitting and hashing of Arrow text columns.

Words are the longest runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z
lower-cased. A word's hash is the sum of table[byte] * B**position, computed for
all words of a block by one running sum and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text in one block, unless a single text is longer.
BLOCK = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.ones(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = _TABLE[_LOWER]
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and its inverse for i < n, mod 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 17))
        out = []
        for b in (_B, pow(_B, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Block:
    """Some rows of a batch and their words."""

    lo: int  # first row
    hi: int  # after the last row
    data: np.ndarray  # bytes of these rows
    offs: np.ndarray  # where each row's bytes begin in data, and the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray  # of each word, uint64
    first: np.ndarray  # index of each row's first word, and the end
    run: np.ndarray  # the running sum that hashes come from, one longer than data

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more than k bytes, and the hashes of their first k."""
        at = np.flatnonzero(self.end - self.start > k)
        s = self.start[at]
        return at, mix((self.run[s + k] - self.run[s]) * _power(len(self.data))[1][s])

    def row_words(self, i: int) -> tuple[int, int]:
        return int(self.first[i]), int(self.first[i + 1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets; null is the empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def _words(d: np.ndarray, offs: np.ndarray, lo: int, hi: int, space: np.ndarray) -> Block:
    n = len(d)
    if not n:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Block(lo, hi, d, offs, z, z, u, np.zeros(hi - lo + 1, np.int64), u)
    word = ~space[d]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = np.flatnonzero(word & (cut[:n] | ~np.concatenate(([False], word[:-1]))))
    end = np.flatnonzero(word & (cut[1:] | ~np.concatenate((word[1:], [False])))) + 1
    up, down = _power(n)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_WORD[d] * up[:n], out=run[1:])
    h = mix((run[end] - run[start]) * down[start])
    return Block(lo, hi, d, offs, start, end, h, np.searchsorted(start, offs), run)


def blocks(column: pa.Array, size: int = BLOCK, space: np.ndarray = _SPACE) -> Iterator[Block]:
    """The column's rows in blocks of about size bytes; a longer text is a block of its own.

    space tells which bytes part words; LETTERS parts at all ASCII but letters.
    """
    d, o = text_buffers(column)
    lo, n = 0, len(o) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield _words(d[o[lo] : o[hi]], (o[lo : hi + 1] - o[lo]).astype(np.int64), lo, hi, space)
        lo = hi


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.uint64(0xD6E8FEB86659FD93)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * c + h[j : j + n]
    return mix(out)


def distinct(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of row (ascending, below 2**20) and hash, sorted by row and then by hash."""
    if not len(h):
        return rows, h
    key = (rows.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    order = np.argsort(key)
    key, r, x = key[order], rows[order], h[order]
    same = key[1:] == key[:-1]
    if (same & (x[1:] != x[:-1])).any() or rows[-1] >= 1 << 20:  # rows that share the upper bits: sort by all of them
        order = np.lexsort((h, rows))
        r, x = rows[order], h[order]
        same = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
    new = np.concatenate(([True], ~same))
    return r[new], x[new]


def row_numbers(b: Block) -> np.ndarray:
    """Of each word of a block, the row counted from the block's first."""
    return np.repeat(np.arange(b.hi - b.lo), np.diff(b.first))
