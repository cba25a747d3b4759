"""Word and span hashing of whole Arrow string columns with numpy (used inside tasks).

Texts stay one byte buffer; a hash of any span comes from prefix sums of
``byte * B**-i`` (mod 2**64), so that nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes spans of a byte array; keeps the powers of its base between calls."""

    def __init__(self, base: int = BASE):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(base, 2 * BLOCK), _powers(self.inv, 2 * BLOCK)

    def spans(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of b[starts[i]:ends[i]], spans ascending and not overlapping."""
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            at, stop = int(starts[i]), int(ends[j - 1])
            n = stop - at
            if n + 1 > len(self.up):
                self.up, self.down = _powers(self.base, n + 1), _powers(self.inv, n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((b[at:stop].astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[e] - sums[s]) * self.up[e] + (e - s).astype(np.uint64))
            i = j
        return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, max_bytes: int):
    """(i, j) ranges of texts with at most ``max_bytes`` together, or a single text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the words of texts b[offsets[i]:offsets[i + 1]]."""
    n = len(b)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~SPACE[b]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that begin at words 0 .. len(h) - k."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j:j + n]
    return mix(out)


def gather_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the spans one after the other, their offsets)."""
    lens = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lens, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lens)
    return b[index], offsets
