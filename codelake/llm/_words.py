"""Words of whole texts as numpy arrays, for code that runs inside Spark tasks.

A column of an Arrow batch is one byte buffer with offsets, so a batch is
split into words and every word fingerprinted with a few vector operations
and no Python object per word.  Words never cross a row.  A fingerprint is
64 bits of a mixing hash over the word's bytes and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20          # a task works on about so much text at a time
_LONG_WORD = 256               # longer words are hashed one by one

K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xBF58476D1CE4E5B9)
K3 = np.uint64(0x94D049BB133111EB)

#: bytes that separate words: blank, tab, newline, vertical tab, form feed, return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: all ASCII but digits and letters
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x41:0x5B] = False
NOT_ALNUM[0x61:0x7B] = False
#: A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= K2
    x ^= x >> np.uint64(27)
    x *= K3
    x ^= x >> np.uint64(31)
    return x


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in ``column`` (always at least one row)."""
    n = batch.num_rows
    if not n:
        return
    ln = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(ln)
    i = 0
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(i, j - i)
        i = j


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) \
        if offs is not None else np.zeros(len(arr) + 1, np.int64)
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


class Words:
    """The words of some rows: ``start``/``end`` byte offsets in ``buf``; row r has words ``first[r]:first[r+1]``."""

    def __init__(self, arr: pa.Array, lower: bool = False, separators: np.ndarray = SPACE) -> None:
        self.buf, self.offsets = text_bytes(arr)
        if lower:
            self.buf = LOWER[self.buf]
        n = len(self.buf)
        inside = ~separators[self.buf]
        begins, closes = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            cut = self.offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            begins[cut] = inside[cut]
            closes[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.rows = len(self.offsets) - 1
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        return hash_spans(self.buf, self.start, self.end)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    keep = np.array([0] + [(1 << 8 * i) - 1 for i in range(1, 8)] + [2 ** 64 - 1], np.uint64)
    length = end - start
    h = mix(length.astype(np.uint64) * K1 ^ (eight[start] & keep[np.minimum(length, 8)]))
    more = np.flatnonzero((length > 8) & (length <= _LONG_WORD))
    at = 8
    while len(more):
        left = length[more] - at
        h[more] = mix((h[more] + K1) ^ (eight[start[more] + at] & keep[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    for i in np.flatnonzero(length > _LONG_WORD):
        import xxhash

        h[i] = xxhash.xxh3_64_intdigest(buf[start[i]:end[i]].tobytes())
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each run of ``k`` words, by its first word (``len(h) - k + 1`` of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    s = h[:m].copy()
    for j in range(1, k):
        s = (s ^ (s >> np.uint64(29))) * K2 + h[j:j + m]
    return mix(s)
