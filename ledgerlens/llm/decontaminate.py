"""Benchmark decontamination: which documents hold a run of words of a benchmark item.

A window is ``size`` consecutive words of an item, or the whole of a shorter
one.  A document contains a window only if it contains every shingle of it;
so one shingle, the rarest in the documents, is the window's necessary prefix
token.  Occurrences of prefix tokens in the documents are joined with the
windows they stand for, the window's place follows from the shingle's offset,
places outside the document are dropped, and the rest are compared word by
word.

The windows are the smaller side: they are joined in blocks of at most
``BLOCK_WINDOWS``, one pass over the documents each, so what a task holds is
bounded however large the benchmark is.  A block has the windows' words and
numbers only; which items hold a window is told by a written table of (window,
item) rows, joined in Spark after the distinct windows of each document are
known, so a sentence that many items share is one window there.

Null and empty texts have no words and no windows.  Rows of one document id
and text are one document, and each gets the same result; rows that share
only the id are documents of their own.  Items that share an id are one item;
an item without an id has the empty one.  An empty benchmark hits nothing, an
empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, lean
from ledgerlens.session import materialize, with_dense_ids

#: Words of a window.
SIZE = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: Windows that are joined in one pass: about 50 MB in each task.
BLOCK_WINDOWS = 200_000
#: Bits of the map that drops most shingles of a document before they are looked up.
FILTER_BITS = 22

KEY = ["__id", "__hash"]


def windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (words, item) rows: the words of a window (hashes, 8 bytes each) and an item that holds it."""
    read = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"), items[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.row_slices(batch, "text", W.ALNUM, True):
                h = w.hashes()
                for r in range(hi - lo):
                    own = h[w.first[r]:w.first[r + 1]]
                    found = [own[i:i + size].tobytes() for i in range(max(1, len(own) - size + 1))] if len(own) else []
                    yield pa.RecordBatch.from_pydict({"item": pa.array([batch.column("item")[lo + r].as_py()] * len(found), pa.string()),
                                                      "words": pa.array(found, pa.binary())})

    return read.mapInArrow(lean(run), "item string, words binary").distinct()


class Index:
    """One block of windows: padded word hashes, and by prefix token the windows with the token's offset."""

    def __init__(self, rows: list, size: int, shingle: int):
        self.number = np.array([r["window"] for r in rows], np.int64)
        self.lengths = np.array([len(r["words"]) // 8 for r in rows], np.int64)
        self.words = np.zeros((len(rows), size), np.uint64)
        for k, r in enumerate(rows):
            self.words[k, :self.lengths[k]] = np.frombuffer(r["words"], np.uint64)
        self.sizes = sorted({min(shingle, n) for n in self.lengths.tolist()})
        # every shingle of every window
        token, window, offset, kind = [], [], [], []
        for n in np.unique(self.lengths):
            own, k = np.flatnonzero(self.lengths == n), min(shingle, int(n))
            for o in range(int(n) - k + 1):
                token.append(_row_grams(self.words[own, o:o + k]))
                window.append(own), offset.append(np.full(len(own), o)), kind.append(np.full(len(own), k))
        self.token, self.window, self.offset, self.kind = (
            np.concatenate(x) if x else np.zeros(0, np.uint64 if x is token else np.int64) for x in (token, window, offset, kind))

    def keep_rarest(self, tokens: np.ndarray, n: np.ndarray) -> None:
        """Of each window's shingles, only the one with the fewest occurrences stays (ties: the smallest hash); ``tokens`` are in order."""
        seen = np.zeros(len(self.token), np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, self.token), len(tokens) - 1)
            seen = np.where(tokens[at] == self.token, n[at], 0)
        order = np.lexsort((self.offset, self.token, seen, self.window))
        first = np.ones(len(order), bool)
        first[1:] = self.window[order][1:] != self.window[order][:-1]
        rare = order[first]
        # a shingle that no document holds can't lead to its window
        rare = rare[seen[rare] > 0]
        self.token, self.window, self.offset, self.kind = self.token[rare], self.window[rare], self.offset[rare], self.kind[rare]

    def ready(self) -> None:
        order = np.argsort(self.token, kind="stable")
        self.token, self.window, self.offset, self.kind = self.token[order], self.window[order], self.offset[order], self.kind[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.token >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in g, entry) of every occurrence of a token."""
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.token, g[at]), np.searchsorted(self.token, g[at], "right")
        n = hi - lo
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(at, n), entry


def _row_grams(rows: np.ndarray) -> np.ndarray:
    """The hash ``words.grams`` gives the words of each row."""
    g = W.mix(rows[:, 0] + np.uint64(rows.shape[1]))
    for j in range(1, rows.shape[1]):
        g = W.mix(g * W._M3 + rows[:, j])
    return g


def _count(read: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a block that the documents hold, in order, and their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        tokens = np.unique(index.token)
        totals = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, _, w in W.row_slices(batch, "__text", W.ALNUM, True):
                h, row = w.hashes(), w.row_of()
                for k in index.sizes:
                    g = W.grams(h, k)
                    g = g[row[:len(g)] == row[k - 1:]]
                    g = g[index.seen[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(tokens, g), len(tokens) - 1)
                    totals += np.bincount(at[tokens[at] == g], minlength=len(tokens))
        some = totals > 0
        yield pa.RecordBatch.from_pydict({"token": tokens[some].view(np.int64), "n": totals[some]})

    # at most ``BLOCK_WINDOWS * SIZE`` rows of two numbers
    found = read.select("__text").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    tokens, n = (np.asarray(found.column(c).combine_chunks(), np.int64) for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], n[order]


def _hits(read: DataFrame, shared) -> DataFrame:
    """Of documents that hold windows: KEY, spans array<struct<a,b>> (words, merged, in order) and windows array<long>, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for lo, hi, w in W.row_slices(batch, "__text", W.ALNUM, True):
                h, row = w.hashes(), w.row_of()
                starts, found = [], []
                for k in index.sizes:
                    place, entry = index.lookup(W.grams(h, k))
                    fits = (index.kind[entry] == k) & (row[np.minimum(place + k - 1, len(row) - 1)] == row[place]) if len(place) else np.zeros(0, bool)
                    place, entry = place[fits], entry[fits]
                    window, start = index.window[entry], place - index.offset[entry]
                    length = index.lengths[window]
                    fits = (start >= w.first[row[place]]) & (start + length <= w.first[row[place] + 1])
                    start, window, length = start[fits], window[fits], length[fits]
                    for j in range(index.words.shape[1]):
                        same = (j >= length) | (h[np.minimum(start + j, len(h) - 1)] == index.words[window, j])
                        start, window, length = start[same], window[same], length[same]
                    starts.append(start), found.append(window)
                start, window = np.concatenate(starts), np.concatenate(found)
                if not len(start):
                    continue
                owner = row[start]
                out = {"__id": [], "__hash": [], "spans": [], "windows": []}
                order = np.lexsort((start, owner))
                start, window, owner = start[order], window[order], owner[order]
                for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(owner)) + 1):
                    r = int(owner[part[0]])
                    a, b = start[part] - w.first[r], start[part] - w.first[r] + index.lengths[window[part]]
                    b = np.maximum.accumulate(b)
                    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
                    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
                    out["__id"].append(batch.column("__id")[lo + r].as_py())
                    out["__hash"].append(batch.column("__hash")[lo + r].as_py())
                    out["spans"].append([{"a": int(x), "b": int(y)} for x, y in zip(a[first], b[last])])
                    out["windows"].append(index.number[np.unique(window[part])])
                yield pa.RecordBatch.from_arrays([pa.array(out["__id"], pa.int64()), pa.array(out["__hash"], pa.int64()),
                                                  pa.array(out["spans"], spans_type), pa.array(out["windows"], pa.list_(pa.int64()))],
                                                 names=[*KEY, "spans", "windows"])

    return read.select(*KEY, "__text").mapInArrow(lean(run), "__id long, __hash long, spans array<struct<a:int,b:int>>, windows array<long>")


def _word_counts(read: DataFrame, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [w.counts for _, _, w in W.row_slices(batch, "__text", W.ALNUM, True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", *KEY)]
                                             + [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())],
                                             names=["id", *KEY, "n_words"])

    kind = read.schema[id_col].dataType.simpleString()
    return read.select(F.col(id_col).alias("id"), *KEY, "__text").mapInArrow(lean(run), f"id {kind}, __id long, __hash long, n_words long")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = SIZE, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The id column, ``text_hash`` (of id and text), ``n_words``, ``n_hit``, ``n_items`` long and ``items`` array<string> (sorted) of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    read = docs.select(docs[id_col], F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("__id"),
                       F.xxhash64(docs[id_col], t).alias("__hash"), t.alias("__text"))
    held = materialize(windows(items, item_id, item_text, size), "held")
    found = materialize(with_dense_ids(held.select("words").distinct(), ["words"], "window"), "windows")
    blocks = max(1, -(-found.count() // block))
    told = None
    for k in range(blocks):
        rows = found.filter(F.pmod("window", F.lit(blocks)) == k).collect()  # at most ``block`` rows of 90 bytes
        if not rows:
            continue
        index = Index(rows, size, shingle)
        index.ready()
        index.keep_rarest(*_count(read, spark.sparkContext.broadcast(index)))
        index.ready()
        part = materialize(_hits(read, spark.sparkContext.broadcast(index)), f"hits-{k}")
        told = part if told is None else told.unionByName(part)
    counted = _word_counts(read, id_col)
    if told is None:
        return counted.select(F.col("id").alias(id_col), F.col("__hash").alias("text_hash"), "n_words", F.lit(0).cast("long").alias("n_hit"),
                              F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))
    # documents with the same windows, such as those that hold the same passage, have their items looked up once
    spans, places = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "windows"))
    one = materialize(told.groupBy(*KEY).agg(spans, places), "places")
    holders = held.join(found, "words").select("window", "item")
    named = one.select("windows").distinct().withColumn("window", F.explode("windows")).join(holders, "window").select("windows", "item").distinct()
    one = one.join(named.groupBy("windows").agg(F.array_sort(F.collect_list("item")).alias("items")), "windows")
    union = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"),
                                              F.greatest(s["to"], x["b"]).alias("to")), lambda s: s["n"])
    one = one.select(*KEY, union.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return counted.join(one, KEY, "left").select(
        F.col("id").alias(id_col), F.col("__hash").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
