"""Byte-level BPE encoding and decoding of whole texts.

A text is split by the vocabulary's pattern; each distinct piece is encoded
once.  Pieces go, by length, into padded matrices of token ids; each round
looks up the rank of every neighbouring pair in a hash table, merges in every
row its leftmost pair of the smallest rank, closes the gap and drops rows
without a known pair.  Ids and bytes equal those of the tiktoken library
without special tokens.

A piece longer than ``MATRIX_BYTES`` would need as many rounds as it has
bytes; it is merged by a heap of its pairs instead, in the same order.

Null texts count as empty: no ids, empty bytes.  Rows are independent, so
repeated rows and equal ids give equal rows, an empty table gives none, and
other columns are left out unless ``keep`` names them; a kept column called
like a new one gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, lean

#: Longest piece, in bytes, that is merged in a matrix.
MATRIX_BYTES = 1024
#: Cells of one matrix; more rows go to the next one.
MATRIX_CELLS = 1 << 20
#: Bytes of pieces (as UTF-8, and 150 more each) that a task remembers; it starts anew beyond that.
CACHE_BYTES = 32 << 20
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Token bytes by id, and the rank of the token that each pair of ids makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for t, i in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self._fill(np.array(left, np.uint64), np.array(right, np.uint64), np.array(made, np.int32))

    def _fill(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        keys = left << np.uint64(32) | right
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.made = np.full(size, 2**64 - 1, np.uint64), np.full(size, NO_RANK, np.int32)
        self.tries, todo, step = 0, np.arange(len(keys)), np.uint64(0)
        while len(todo):  # linear probing: of those that want the same free slot, one gets it
            slot = (W.mix(keys[todo]) + step) & self.mask
            free = self.keys[slot] == 2**64 - 1
            self.keys[slot[free]] = keys[todo[free]]
            got = self.keys[slot] == keys[todo]
            self.made[slot[got]] = made[todo[got]]
            todo, step, self.tries = todo[~got], step + np.uint64(1), self.tries + 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token made of each pair, NO_RANK where there is none (or an id is negative)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        home = W.mix(keys)
        slot = home & self.mask
        found = self.keys[slot]
        out = np.where(found == keys, self.made[slot], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != 2**64 - 1))
        for step in range(1, self.tries):
            if not len(todo):
                break
            slot = (home[todo] + np.uint64(step)) & self.mask
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.made[slot[hit]]
            todo = todo[~hit & (found != 2**64 - 1)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit integers) of pieces of similar length."""
        width = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        filled = np.arange(width + 1) < sizes[:, None]
        ids[filled] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NO_RANK, np.int32)
        pairs = filled[:, 1:]
        ranks[pairs] = self.pair_ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = np.flatnonzero(best == NO_RANK)
            for k in done:
                out[row[k]] = ids[k, :sizes[k]].astype("<u4").tobytes()
            if len(done):
                left = best != NO_RANK
                row, sizes, at, best = row[left], sizes[left], at[left], best[left]
                width = int(sizes.max()) if len(row) else 0
                ids, ranks = ids[left, :width + 1], ranks[left, :width]
                if not len(row):
                    break
            own, cols = np.arange(len(row)), np.arange(width)
            after = cols >= at[:, None]
            ids[:, :-1] = np.where(cols > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[own, at] = best
            ids[own, sizes - 1] = -1
            shifted = np.full_like(ranks, NO_RANK)
            shifted[:, :-1] = ranks[:, 1:]
            ranks = np.where(after, shifted, ranks)
            sizes = sizes - 1
            for col, ok in ((at, at < sizes - 1), (at - 1, at > 0)):
                r, c = own[ok], col[ok]
                ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
            last = own[at >= sizes - 1]
            ranks[last, at[last]] = NO_RANK
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece: a heap of (rank, place) over a linked list of tokens."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NO_RANK)]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get(self.token[ids[i]] + self.token[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces."""
        out, by_length = {}, {}
        for p in pieces:
            if (i := self.rank.get(p)) is not None:
                out[p] = i.to_bytes(4, "little")
            elif len(p) > MATRIX_BYTES:
                out[p] = self.merge_long(p)
            else:
                by_length.setdefault(max(2, (len(p) - 1).bit_length()), []).append(p)
        for bits, own in by_length.items():
            rows = max(1, MATRIX_CELLS >> bits)
            for lo in range(0, len(own), rows):
                out.update(zip(own[lo:lo + rows], self.merge_rows(own[lo:lo + rows])))
        return out


class Cache(dict):
    """Ids of pieces, and about how many bytes they take."""

    bytes = 0


def encode_texts(texts: list[str], vocabulary: Vocabulary, find, cache: Cache) -> list[bytes]:
    """Ids of each text, as bytes; ``cache`` maps pieces to ids and grows."""
    split = [find(t) for t in texts]
    if cache.bytes > CACHE_BYTES:
        cache.clear()
        cache.bytes = 0
    new = list({p for pieces in split for p in pieces if p not in cache})
    if new:
        raw = [p.encode() for p in new]
        ids = vocabulary.encode_pieces(raw)
        cache.update((p, ids[r]) for p, r in zip(new, raw))
        cache.bytes += sum(map(len, raw)) + 150 * len(raw)
    return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]


def _kept(df: DataFrame, keep: list[str], new: list[str]) -> list[str]:
    return [c for c in dict.fromkeys(keep) if c not in new and c in df.columns]


class Decoder:
    """Token bytes side by side, and where each begins."""

    def __init__(self, vocabulary: Vocabulary):
        token = vocabulary.token
        self.size = np.zeros(max(token) + 1, np.int32)
        self.size[list(token)] = [len(t) for t in token.values()]
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.content = np.frombuffer(b"".join(token[i] for i in sorted(token)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - n - self.begin[ids], n)
        return self.content[place].tobytes()


def _encoded(texts: pa.Array, vocabulary: Vocabulary, find, cache: Cache) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, ids of each) of each slice."""
    _, bounds = W.text_bytes(texts)
    for lo, hi in W.slices(bounds, SLICE_BYTES):
        yield lo, hi, encode_texts([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], vocabulary, find, cache)


def _id_columns(ids: list[bytes]) -> list[pa.Array]:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4"))),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())]


_ID_FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType())]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``n_tokens`` long, ``ids`` array<int> and ``ids_sha256`` of each row's text.

    path: a rank file (token in base64 and rank on each line), readable on every
    worker; pattern: what splits a text into pieces.
    """
    return _rows(docs, path, pattern, text, keep, _ID_FIELDS)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode``, and ``decoded_sha256`` of the bytes that the ids decode to: one pass, one vocabulary a worker."""
    return _rows(docs, path, pattern, text, keep, [*_ID_FIELDS, T.StructField("decoded_sha256", T.StringType())])


def _rows(docs: DataFrame, path: str, pattern: str, text: str, keep: tuple[str, ...], fields: list[T.StructField]) -> DataFrame:
    new = [f.name for f in fields]
    own = _kept(docs, list(keep), new)
    bound_batches(docs.sparkSession)
    source = docs.select(*own, docs[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, find, cache = Vocabulary(path), regex.compile(pattern).findall, Cache()
        decoder = Decoder(vocabulary) if "decoded_sha256" in new else None
        for batch in batches:
            for lo, hi, ids in _encoded(batch.column("__text"), vocabulary, find, cache):
                told = _id_columns(ids)
                if decoder:
                    told.append(pa.array([hashlib.sha256(decoder.decode(np.frombuffer(x, "<i4"))).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in own] + told, names=[*own, *new])

    return source.mapInArrow(lean(run), T.StructType([source.schema[c] for c in own] + fields))


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``decoded`` binary: the bytes of each row's ids (null: empty)."""
    own = _kept(encoded, list(keep), ["decoded"])
    bound_batches(encoded.sparkSession)
    source = encoded.select(*own, encoded[ids].alias("__ids"))
    schema = T.StructType([source.schema[c] for c in own] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(path))
        for batch in batches:
            column = batch.column("__ids")
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            flat = column.flatten().to_numpy()
            for lo, hi in W.slices(bounds, SLICE_BYTES // 4):
                decoded = [decoder.decode(flat[a:b]) for a, b in zip(bounds[lo:hi], bounds[lo + 1:hi + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in own]
                                                 + [pa.array(decoded, pa.binary())], names=[*own, "decoded"])

    return source.mapInArrow(lean(run), schema)
