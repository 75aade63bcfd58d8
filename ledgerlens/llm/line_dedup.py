"""Line dedup: lines whose key many documents share go, found through two Bloom filters.

A line's key is the line without white space at its ends and with A-Z in
lower case.  Each task adds its documents' distinct keys to a filter of keys
seen once and one of keys seen twice; filters add up by segment (what is in
two 'once' filters is in the sum's 'twice').  Only lines in the 'twice'
filter are suspected; their keys, summed up by task, are all that is shuffled.
They are counted by their text, so the filters' false alarms end here, and
the first document and line of each key is chosen there as well.

The filters' size follows the number of lines up to ``bloom.MOST_BITS``;
beyond, more lines are suspected and the result is the same.  The confirmed
keys go to the tasks as 64-bit hashes while there are at most ``MOST_KEYS``
of them, checked; beyond that, the suspected lines join the keys in Spark and
each document joins the list of its dropped lines.  (A line whose hash equals
a confirmed key's without being it has a chance of about 2^-64 a pair.)

Null and empty texts are one empty line, as is a line of white space only: the
empty key never counts when ``min_chars`` is 1 or more.  Every row is a
document, whatever its id; rows that repeat an id and a text both count, and
with ``keep_first`` both keep the first occurrence.  Ties for the first
occurrence go to the smallest id (nulls first), then hash of the text, then
line.  An empty table gives no rows; columns other than id and text are left
out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bloom
from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, release
from ledgerlens.session import materialize

#: Documents that a key must be found in.
DOCUMENTS = 10
#: Confirmed keys that go to the tasks: 20 bytes each, 40 MB.
MOST_KEYS = 2_000_000


class Lines:
    """The lines of a slice's rows: spans, spans of their keys, hashes of the keys, and the first line of each row."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, min_chars: int = 1):
        breaks = np.flatnonzero(buf == 0x0A)
        owner = np.searchsorted(bounds[1:], breaks, "right")
        self.counts = 1 + np.bincount(owner, minlength=len(bounds) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        n = int(self.first[-1])
        self.starts, self.ends = np.empty(n, np.int64), np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.first[:-1]] = False
        self.starts[self.first[:-1]], self.starts[inner] = bounds[:-1], breaks + 1
        inner[:] = True
        inner[self.first[1:] - 1] = False
        self.ends[self.first[1:] - 1], self.ends[inner] = bounds[1:], breaks
        ink = np.flatnonzero(W.PLAIN[buf])
        lo, hi = np.searchsorted(ink, self.starts), np.searchsorted(ink, self.ends)
        full = lo < hi
        a, b = self.starts.copy(), self.starts.copy()
        a[full], b[full] = ink[lo[full]], ink[hi[full] - 1] + 1
        self.hashes = W.span_hashes(W.LOWER[buf], a, b)
        self.a, self.b = a, b
        if min_chars > 1:
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            self.counted = chars[b] - chars[a] >= min_chars
        else:
            self.counted = (b > a) if min_chars == 1 else np.ones(n, bool)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.counts)

    def distinct(self, some: np.ndarray | None = None) -> np.ndarray:
        """The lines that are the first of their key in their row, among the counted ones (and ``some``)."""
        at = np.flatnonzero(self.counted if some is None else self.counted & some)
        order = np.lexsort((self.hashes[at], self.row[at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (self.hashes[at][1:] != self.hashes[at][:-1]) | (self.row[at][1:] != self.row[at][:-1])
        return at[new]


def _sliced(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, int, np.ndarray, Lines]]:
    buf, bounds = W.text_bytes(batch.column("__text"))
    for lo, hi in W.slices(bounds):
        at = bounds[lo:hi + 1]
        own = buf[at[0]:at[-1]]
        yield lo, hi, own, Lines(own, at - at[0], min_chars)


def _twice(read: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, found in _sliced(batch, min_chars):
            yield found.hashes[found.distinct()]

    return bloom.filters(read.select("__text"), bits, hashes, "twice")


def _suspects(read: DataFrame, shared, bits: int, min_chars: int) -> DataFrame:
    """Of each slice and suspected key: key, hash, documents, and the slice's first place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("__order"), batch.column("__hash").to_numpy()
            place = ids.to_numpy(zero_copy_only=False)
            for lo, _, buf, found in _sliced(batch, min_chars):
                at = found.distinct(bloom.has(shared.value, found.hashes, bits))
                if not len(at):
                    continue
                row = lo + found.row[at]
                line = at - found.first[found.row[at]]
                order = np.lexsort((line, marks[row], place[row], found.hashes[at]))
                at, row, line = at[order], row[order], line[order]
                h = found.hashes[at]
                head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                low = W.LOWER[buf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low[found.a[k]:found.b[k]].tobytes() for k in at[head]], pa.binary()), pa.array(h[head].view(np.int64)),
                     pa.array(np.diff(np.append(head, len(at))).astype(np.int64)), pa.array(place[row[head]]), pa.array(marks[row[head]]),
                     pa.array(line[head].astype(np.int32))], names=["key", "hash", "docs", "place", "mark", "line"])

    return read.select("__order", "__hash", "__text").mapInArrow(run, "key binary, hash long, docs long, place long, mark long, line int")


def _suspect_lines(read: DataFrame, shared, bits: int, min_chars: int) -> DataFrame:
    """(hash, mark, line) of every suspected line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("__hash").to_numpy()
            for lo, _, _, found in _sliced(batch, min_chars):
                at = np.flatnonzero(found.counted & bloom.has(shared.value, found.hashes, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.hashes[at].view(np.int64)), pa.array(marks[lo + found.row[at]]),
                     pa.array((at - found.first[found.row[at]]).astype(np.int32))], names=["hash", "mark", "line"])

    return read.select("__hash", "__text").mapInArrow(run, "hash long, mark long, line int")


def _cut(read: DataFrame, kind: str, min_chars: int, keys=None, keep_first: bool = False) -> DataFrame:
    """id, n_lines, n_dropped and the text left; dropped lines come from ``keys`` (sorted hashes, first marks, first lines) or the column __lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("__hash").to_numpy()
            for lo, hi, buf, found in _sliced(batch, min_chars):
                n = len(found.starts)
                if keys is not None:
                    known, mark, line = keys.value
                    at = np.minimum(np.searchsorted(known, found.hashes), max(0, len(known) - 1))
                    gone = found.counted & (known[at] == found.hashes) if len(known) else np.zeros(n, bool)
                    if keep_first and len(known):
                        gone &= (mark[at] != marks[lo + found.row]) | (line[at] != np.arange(n) - found.first[found.row])
                else:
                    told = batch.column("__lines").slice(lo, hi - lo)
                    sizes = np.diff(told.offsets.to_numpy())
                    gone = np.zeros(n, bool)
                    gone[told.flatten().to_numpy() + np.repeat(found.first[:-1], sizes)] = True
                dropped = np.add.reduceat(gone, found.first[:-1]).astype(np.int64) if n else np.zeros(0, np.int64)
                texts = []
                for r in range(hi - lo):
                    a, b = found.first[r], found.first[r + 1]
                    if not dropped[r]:
                        texts.append(buf[found.starts[a]:found.ends[b - 1]].tobytes())
                    else:
                        left = a + np.flatnonzero(~gone[a:b])
                        texts.append(b"\n".join(buf[x:y].tobytes() for x, y in zip(found.starts[left], found.ends[left])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(found.counts.astype(np.int64)), pa.array(dropped),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_lines", "n_dropped", "kept"])

    columns = ["id", "__hash", "__text"] + ([] if keys is not None else ["__lines"])
    return read.select(*columns).mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, min_chars: int = 1,
          keep_first: bool = False, most_keys: int = MOST_KEYS) -> DataFrame:
    """The id column, ``n_lines``, ``n_dropped`` long and the text left of each row; ``keep_first`` leaves each key's first line."""
    spark = docs.sparkSession
    bound_batches(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    read = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(-2**63)).alias("__order"),
                       F.xxhash64(docs[id_col], t).alias("__hash"), t.alias("__text"))
    kind = read.schema["id"].dataType.simpleString()
    lines = read.agg(F.sum(F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = bloom.bits_for(lines)
    shared = spark.sparkContext.broadcast(_twice(read, bits, min_chars))
    sums = _suspects(read, shared, bits, min_chars).groupBy("key", "hash").agg(
        F.sum("docs").alias("docs"), F.min(F.struct("place", "mark", "line")).alias("first"))
    keys = materialize(sums.filter(F.col("docs") >= documents).select("hash", "first.mark", "first.line"), "keys")
    if keys.count() <= most_keys:
        rows = keys.toPandas().sort_values("hash", key=lambda s: s.to_numpy().view(np.uint64))
        own = spark.sparkContext.broadcast((rows["hash"].to_numpy(np.int64).view(np.uint64), rows["mark"].to_numpy(np.int64), rows["line"].to_numpy(np.int64)))
        release(spark, keys)
        shared.unpersist()
        out = _cut(read, kind, min_chars, own, keep_first)
    else:
        found = materialize(_suspect_lines(read, shared, bits, min_chars).distinct(), "suspects")
        told = found.join(keys.withColumnsRenamed({"mark": "first_mark", "line": "first_line"}), "hash")
        if keep_first:
            told = told.filter("mark != first_mark OR line != first_line")
        told = materialize(told.groupBy("mark").agg(F.collect_list("line").alias("__lines")), "lines")
        joined = read.join(told, read["__hash"] == told["mark"], "left").withColumn("__lines", F.coalesce("__lines", F.array().cast("array<int>")))
        out = _cut(joined, kind, min_chars)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").alias(text))
