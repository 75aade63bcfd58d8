"""Words, word hashes and word n-grams of Arrow text columns, computed with numpy over whole batches.

Separators are ASCII bytes in both word definitions used here, so splitting
the UTF-8 bytes gives the same words as splitting the code points.  Hashes
are 64 bits; two different words or n-grams of one corpus are taken as
different (a clash has a chance of about 2^-64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 4 << 20

#: Word bytes of `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (text already in lower case).
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the bounds of each row in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of the rows of one slice: byte spans, and the first word of each row in ``first`` (one more at the end)."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, table: np.ndarray = PLAIN, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        rows = len(bounds) - 1
        inside = table[self.buf]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[edges] = False
        after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.rows = rows

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[:len(self.buf)] = self.buf
        eight = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        h = left.astype(np.uint64) * _M3
        h = mix(h ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        todo = np.flatnonzero(left > 8)
        at, left = at[todo] + 8, left[todo] - 8
        while len(todo):
            h[todo] = mix(h[todo] * _M3 ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return h


def span_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, a sum over its pieces of eight bytes; a long span costs no more than many short ones."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    pieces = (b - a + 7) // 8
    ends = np.cumsum(pieces)
    j = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - pieces, pieces)
    at = np.repeat(a, pieces) + 8 * j
    x = eight[at] & _KEEP[np.minimum(np.repeat(b, pieces) - at, 8)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x * _M3 + mix(j.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)])
    return mix(total[ends] - total[ends - pieces] + (b - a).astype(np.uint64) * _M1)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` positions are left out.

    Positions whose words reach into the next row are the caller's to drop.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = mix(h[:n] + np.uint64(size))
    for j in range(1, size):
        g = mix(g * _M3 + h[j:j + n])
    return g


def row_slices(batch: pa.RecordBatch, text: str, table: np.ndarray = PLAIN,
               lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """The words of a record batch's text column, slice by slice: (first row, end row, words)."""
    buf, bounds = text_bytes(batch.column(text))
    for lo, hi in slices(bounds):
        at = bounds[lo:hi + 1]
        yield lo, hi, Words(buf[at[0]:at[-1]], at - at[0], table, lower)
