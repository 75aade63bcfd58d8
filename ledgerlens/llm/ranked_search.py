"""Ranked lexical search: the best documents of each item, by summed term impacts in whole numbers.

One pass over the documents writes an index that holds only terms of items:
of each document its length and the items' terms with their occurrences.  Sums
over it give N, L and the terms' document frequencies, hence weights.

Each task then loads its part of the index in chunks of documents and answers
every item from inverted lists with a hybrid of two orders.  Term at a time:
the item's short lists are summed into accumulators, (document, sum) in
document order.  Document at a time: the accumulators and the long lists are
iterators over windows of documents, each with the largest value that it
holds in a window.  A window whose bounds sum up to less than the item's
worst result so far is skipped.  In other windows iterators of small bounds
only probe the documents that the others found and that can still get in.
The results of the tasks are ranked once more in Spark.

The items are the smaller side: they are searched for in blocks of about
``BLOCK_TERMS`` terms, so that what goes to the tasks is bounded however many
there are; each block is one pass.

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case.
Null and empty texts have none: such a document is never found, and such an
item finds nothing.  Every row is a document, so a repeated row is found twice;
equal scores go by ascending id (nulls first).  Item rows that repeat an id
and a text are one; items that share only the id are ranked apart.  Ids of
documents are read as longs.  Very long texts are cut into slices of terms
like any other.  Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, release
from ledgerlens.session import materialize

#: Results of an item.
TOP = 50
#: Terms of the items of one block, about; 8 bytes each.
BLOCK_TERMS = 500_000
#: A chunk's documents and postings at most: about 100 MB with its lists.
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 15, 1 << 21
#: Documents of a window.
WINDOW = 1 << 10
#: Short lists of an item: as many postings together as a chunk has documents, divided by this.
SHORT_SHARE = 4

_NO_ID = -2**63


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, item (a number) and the distinct terms' hashes (8 bytes each) of every item that has any."""
    kind = items.schema[item_id].dataType.simpleString()
    read = items.select(items[item_id].alias("item_id"), F.coalesce(items[text].cast("string"), F.lit("")).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.row_slices(batch, "text", W.ALNUM, True):
                h = w.hashes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(lo, hi - lo),
                     pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(w.first, w.first[1:])], pa.binary())], names=["item_id", "terms"])

    found = read.mapInArrow(run, f"item_id {kind}, terms binary").filter("length(terms) > 0")
    return materialize(found.withColumn("item", F.monotonically_increasing_id()), "items")


def _postings(docs: DataFrame, shared) -> DataFrame:
    """Of each document with terms: id, n (its terms with repeats), and of the vocabulary's terms their numbers and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, hi, w in W.row_slices(batch, "__text", W.ALNUM, True):
                h = w.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                key = w.row_of()[hit] * len(known) + at[hit]
                key, tf = np.unique(key, return_counts=True)
                row, term = key // len(known), (key % len(known)).astype(np.int32)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                tf = tf.astype(np.int64)
                some = np.flatnonzero(w.counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__doc").slice(lo, hi - lo).take(pa.array(some)), pa.array(w.counts[some].astype(np.int64)),
                     pa.array([term[cut[r]:cut[r + 1]].tobytes() for r in some], pa.binary()),
                     pa.array([tf[cut[r]:cut[r + 1]].tobytes() for r in some], pa.binary())], names=["doc", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc long, n long, terms binary, tfs binary")


def _frequencies(index: DataFrame, terms: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "df": total[some]})

    return index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _length_parts(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document: 100 - 50 + (50 * n * N) div L, exact also where the product passes 64 bits."""
    if len(n) and 50 * int(n.max()) * documents >= 2**63:
        return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)
    return 50 + 50 * n * documents // terms


class Chunk:
    """Inverted lists of a chunk's documents, which are numbered by id, with their impacts and window bounds."""

    def __init__(self, docs: np.ndarray, n: np.ndarray, terms: list[bytes], tfs: list[bytes], weights: np.ndarray, stats: tuple[int, int]):
        order = np.argsort(docs, kind="stable")
        self.docs = docs[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        sizes = np.array([len(t) // 4 for t in terms], np.int64)
        term, tf = np.frombuffer(b"".join(terms), np.int32).astype(np.int64), np.frombuffer(b"".join(tfs), np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        m = _length_parts(n, *stats)[owner]
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        key = term * len(docs) + number[owner]
        by = np.argsort(key)
        self.doc, self.impact = (key[by] % max(1, len(docs))).astype(np.int64), impact[by]
        term = term[by]
        self.windows = -(-len(docs) // WINDOW)
        # where each list's part of each window begins, and the largest impact in it
        cell = term * self.windows + self.doc // WINDOW
        self.begin = np.searchsorted(cell, np.arange(len(weights) * self.windows + 1)).astype(np.int64)
        self.bound = np.zeros(len(weights) * self.windows, np.int64)
        full = np.flatnonzero(self.begin[:-1] < self.begin[1:])
        if len(full):
            self.bound[full] = np.maximum.reduceat(self.impact, self.begin[full])
        self.bound = self.bound.reshape(len(weights), self.windows)

    def span(self, term: int, window: int = 0, windows: int | None = None) -> slice:
        k = term * self.windows + window
        return slice(self.begin[k], self.begin[k + (self.windows if windows is None else windows)])

    def accumulate(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents of the short lists in order, and their sums."""
        spans = [self.span(t) for t in short]
        doc = np.concatenate([self.doc[s] for s in spans]) if spans else np.zeros(0, np.int64)
        impact = np.concatenate([self.impact[s] for s in spans]) if spans else doc
        order = np.argsort(doc, kind="stable")
        doc, impact = doc[order], impact[order]
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
        return doc[head], np.add.reduceat(impact, head) if len(doc) else impact

    def search(self, terms: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores of at least ``floor`` that hold the chunk's best ``top``, and perhaps more."""
        first, last = self.begin[terms * self.windows], self.begin[(terms + 1) * self.windows]
        terms, sizes = terms[last > first], (last - first)[last > first]
        order = np.argsort(sizes, kind="stable")
        terms, sizes = terms[order], sizes[order]
        n_short = int(np.searchsorted(np.cumsum(sizes), max(1, len(self.docs) // SHORT_SHARE), "right"))
        acc, sums = self.accumulate(terms[:n_short])
        long = terms[n_short:]
        if len(sums) >= top:
            floor = max(floor, int(np.partition(sums, len(sums) - top)[len(sums) - top]))
        cut = np.searchsorted(acc, np.arange(self.windows + 1) * WINDOW)
        acc_bound = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(cut[:-1] < cut[1:])
        if len(full):
            acc_bound[full] = np.maximum.reduceat(sums, cut[full])
        bounds = np.vstack([acc_bound, self.bound[long]])  # iterator 0 is the accumulators
        reach = bounds.sum(axis=0)
        found, scores, kept = [], [], 0
        for window in np.flatnonzero((reach >= floor) & (reach > 0)):
            if reach[window] < floor:
                continue
            base, own = window * WINDOW, bounds[:, window]
            order = np.argsort(own, kind="stable")
            order = order[own[order] > 0]
            ahead = np.cumsum(own[order])  # what the iterators up to this one can add
            probing = int(np.searchsorted(ahead, floor, "left"))  # a document of these alone stays below the floor
            probing = min(probing, len(order) - 1)
            score = np.zeros(WINDOW, np.int64)
            for k in order[probing:]:
                doc, add = self._part(k, window, long, acc, sums, cut)
                score[doc - base] += add
            live = np.flatnonzero(score)
            for j in range(probing - 1, -1, -1):
                live = live[score[live] + ahead[j] >= floor]
                if not len(live):
                    break
                doc, add = self._part(order[j], window, long, acc, sums, cut)
                at = np.minimum(np.searchsorted(doc, live + base), len(doc) - 1)
                score[live] += np.where(doc[at] == live + base, add[at], 0)
            live = live[score[live] >= floor]
            found.append(live + base), scores.append(score[live])
            kept += len(live)
            if kept > 2 * top:  # the floor rises to the worst of the best ``top``
                every = np.concatenate(scores)
                floor = max(floor, int(np.partition(every, len(every) - top)[len(every) - top]))
                doc = np.concatenate(found)
                found, scores = [doc[every >= floor]], [every[every >= floor]]
                kept = len(found[0])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(scores)

    def _part(self, k: int, window: int, long: np.ndarray, acc: np.ndarray, sums: np.ndarray, cut: np.ndarray):
        if k == 0:
            return acc[cut[window]:cut[window + 1]], sums[cut[window]:cut[window + 1]]
        s = self.span(long[k - 1], window, 1)
        return self.doc[s], self.impact[s]


def best(docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores above 0, equal ones by ascending id."""
    order = np.lexsort((docs, -scores))[:top]
    order = order[scores[order] > 0]
    return docs[order], scores[order]


def _answers(index: DataFrame, shared, top: int) -> DataFrame:
    """Each task's best documents of each item."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(lo, 1 << 12)
                size = sum(map(len, part.column("terms").to_pylist())) // 4
                if held and (docs + part.num_rows > CHUNK_DOCS or postings + size > CHUNK_POSTINGS):
                    yield held
                    held, docs, postings = [], 0, 0
                held.append(part)
                docs, postings = docs + part.num_rows, postings + size
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, stats = shared.value
        state = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item in items}
        for held in chunks(batches):
            table = pa.Table.from_batches(held)
            chunk = Chunk(table.column("doc").to_numpy(), table.column("n").to_numpy(), table.column("terms").to_pylist(),
                          table.column("tfs").to_pylist(), weights, stats)
            for item, terms in items.items():
                docs, scores = state[item]
                floor = int(scores[-1]) if len(scores) == top else 1
                own, add = chunk.search(terms, top, floor)
                if len(own):
                    state[item] = best(np.concatenate([docs, chunk.docs[own]]), np.concatenate([scores, add]), top)
        for item, (docs, scores) in state.items():
            if len(docs):
                yield pa.RecordBatch.from_pydict({"item": np.full(len(docs), item, np.int64), "doc": docs, "score": scores})

    return index.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank int, the id column, score long: each item's ``top`` documents."""
    spark = docs.sparkSession
    bound_batches(spark)
    read = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("__doc"), docs[text].cast("string").alias("__text"))
    asked = _item_terms(items, item_id, item_text)
    blocks = max(1, -(-(asked.agg(F.sum(F.length("terms"))).first()[0] or 0) // (8 * block)))
    told = None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()  # about ``block`` terms
        if not rows:
            continue
        own = {r["item"]: np.frombuffer(bytes(r["terms"]), np.uint64) for r in rows}
        known = np.unique(np.concatenate(list(own.values())))
        vocabulary = spark.sparkContext.broadcast(known)
        index = materialize(_postings(read, vocabulary), "index")
        stats = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if stats[0]:
            weights = np.zeros(len(known), np.int64)
            for r in _frequencies(index, len(known)).collect():  # at most the block's terms
                weights[r["term"]] = math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * r["df"] + 1)))
            shared = spark.sparkContext.broadcast(({i: np.searchsorted(known, t) for i, t in own.items()}, weights, (stats[0], stats[1])))
            part = materialize(_answers(index, shared, top), f"answers-{k}")
            told = part if told is None else told.unionByName(part)
            shared.unpersist()
        vocabulary.unpersist()
        release(spark, index)
    if told is None:
        told = spark.createDataFrame([], "item long, doc long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc")))
    ranked = told.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select(
        "item_id", "rank", F.when(F.col("doc") != _NO_ID, F.col("doc")).alias(id_col), "score")
