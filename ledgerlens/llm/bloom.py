"""Bloom filters over 64-bit hashes that Spark tasks fill in parts and merge by segment.

A filter has 2^bits cells in segments of 2^16; a hash has two cells, both in
the segment that its upper bits name.  A task sends only the segments that it
touched, as cell lists or bitmaps, so the shuffle holds about four bytes a
hash.  A filter has at most ``MOST_BITS`` (64 MiB) however many hashes it
takes: a fuller filter lets more through and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.scratch import lean

SEGMENT = 16
SEGMENT_BYTES = 1 << (SEGMENT - 3)
MOST_BITS = 29
#: Cells of a filter for each expected hash.
CELLS = 16


def bits_for(hashes: int, most: int = MOST_BITS) -> int:
    """log2 of the cells for so many hashes."""
    return min(most, max(SEGMENT, int(max(1, hashes) * CELLS - 1).bit_length()))


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash."""
    segment = (h >> np.uint64(64 - (bits - SEGMENT))).astype(np.int64) << SEGMENT if bits > SEGMENT else np.zeros(len(h), np.int64)
    return segment | (h & np.uint64(0xFFFF)).astype(np.int64), segment | ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


def has(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether both cells of each hash are set."""
    a, b = cells(h, bits)
    first = (bitmap[a >> 3] >> (a & 7).astype(np.uint8)) & 1
    return (first & (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _bytes_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct cells as (bytes, their set bits)."""
    if not len(at):
        return at, np.zeros(0, np.uint8)
    byte = at >> 3
    head = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    return byte[head], np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), head)


class Twice:
    """Two filters: cells seen once or more, and cells seen twice or more."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        """Hashes of one addition each; equal ones count as several."""
        at = np.concatenate(cells(h, self.bits))
        at.sort()
        same = at[1:] == at[:-1]
        byte, mask = _bytes_of(at[np.concatenate([[True], ~same])] if len(at) else at)
        self.twice[byte] |= self.once[byte] & mask
        self.once[byte] |= mask
        byte, mask = _bytes_of(np.unique(at[1:][same]))
        self.twice[byte] |= mask

    def segments(self) -> Iterator[pa.RecordBatch]:
        """(segment, once, twice) of the touched segments."""
        shape = (-1, SEGMENT_BYTES)
        once, twice = self.once.reshape(shape), self.twice.reshape(shape)
        touched = np.flatnonzero(once.any(axis=1))
        for lo in range(0, len(touched), 256):
            part = touched[lo:lo + 256]
            yield pa.RecordBatch.from_pydict({"segment": pa.array(part.astype(np.int32)), "once": pa.array([_packed(once[k]) for k in part], pa.binary()),
                                              "twice": pa.array([_packed(twice[k]) for k in part], pa.binary())})


def _packed(bitmap: np.ndarray) -> bytes:
    """A segment's cell list if it is shorter than the bitmap, else the bitmap."""
    at = np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
    return at.astype("<u2").tobytes() if 2 * len(at) < SEGMENT_BYTES else bitmap.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT_BYTES:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(1 << SEGMENT, np.uint8)
    out[np.frombuffer(data, "<u2")] = 1
    return np.packbits(out, bitorder="little")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of several tasks as one: a cell in both 'once' filters is in the 'twice' filter of the sum."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
            o, t = held.setdefault(k, (np.zeros(SEGMENT_BYTES, np.uint8), np.zeros(SEGMENT_BYTES, np.uint8)))
            other = _unpacked(once)
            t |= _unpacked(twice) | (o & other)
            o |= other
    for k, (o, t) in held.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "once": pa.array([_packed(o)], pa.binary()),
                                          "twice": pa.array([_packed(t)], pa.binary())})


def filters(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], column: str) -> np.ndarray:
    """The merged filter ``column`` ('once' or 'twice') of the hashes that ``hashes`` finds in each batch of ``rows``.

    What reaches the driver is at most 2^bits cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Twice(bits)
        for batch in batches:
            for h in hashes(batch):
                seen.add(h)
        yield from seen.segments()

    schema = "segment int, once binary, twice binary"
    parts = max(1, min(1 << (bits - SEGMENT), 64))
    merged = rows.mapInArrow(lean(run), schema).repartition(parts, "segment").mapInArrow(lean(_merge), schema)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in merged.select("segment", column).filter(f"length({column}) > 0").collect():
        out[r[0] * SEGMENT_BYTES:(r[0] + 1) * SEGMENT_BYTES] = _unpacked(bytes(r[1]))
    return out
