"""Vectorised words and n-gram hashes over Arrow string batches.

Words are runs of bytes that a 256-entry table marks; multi-byte UTF-8 characters are kept whole as all their bytes
are 0x80 or more. A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed.
Byte-wide work goes in pieces of at most 2**18 bytes, so a very long text needs little more than its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in separators:
        t[a : b + 1] = False
    return t


#: Words of letters a-z, digits and all that is not ASCII (after lower-casing A-Z).
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words between white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(PIECE + 1, base, dtype=_U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Words:
    """The words of a batch of texts. first[d]:first[d + 1] are those of text d; starts and ends are byte places in buf."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        if n == 0:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        else:
            m = table[buf]
            edge = np.zeros(n + 1, dtype=bool)
            edge[offsets] = True
            before = np.empty(n, dtype=bool)
            before[0] = False
            before[1:] = m[:-1]
            before[edge[:n]] = False
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = m[1:]
            after[edge[1:]] = False
            self.starts = np.flatnonzero(m & ~before)
            self.ends = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        up, down = _tables()
        out = np.empty(len(self.starts), dtype=_U)
        i, n = 0, len(out)
        while i < n:
            a = int(self.starts[i])
            j = int(np.searchsorted(self.ends, a + PIECE, "right"))
            if j <= i:  # one word of over a piece
                out[i] = xxhash.xxh64_intdigest(self.buf[a : self.ends[i]].tobytes())
                i += 1
                continue
            b = int(self.ends[j - 1])
            sums = np.zeros(b - a + 1, dtype=_U)
            np.cumsum((self.buf[a:b].astype(_U) + _U(1)) * up[: b - a], out=sums[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out)

    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words (across texts too; callers mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = np.full(n, k, dtype=_U)
    for i in range(k):
        h *= _U(0x9FB21C651E98DF25)
        h += hashes[i : i + n]
    return mix(h)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    a, b = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(raw, dtype=np.uint8)[a:b] if raw is not None and b > a else np.zeros(0, dtype=np.uint8)
    return LOWER[buf], offsets - a


def cuts(column: pa.Array, most: int = 1 << 20):
    """(start, length) of runs of rows with about `most` bytes of text each, at least a row."""
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
        yield start, stop - start
        start, total = stop, int(ends[stop - 1])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch with about `most` bytes of text each, at least a row."""
    for start, length in cuts(batch.column(column), most):
        yield batch.slice(start, length)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words within a text."""
    h = fold(words.hashes, k)
    if not len(h):
        return h, np.zeros(0, dtype=np.int64)
    docs = words.docs()
    keep = np.flatnonzero(docs[: len(h)] == docs[k - 1 :])
    return h[keep], keep
