"""Quality classifier by importance resampling: documents that look like the target text, drawn by Gumbel top-k.

Two generative models over hashed n-grams are fitted: the target's on a
bounded sample of labelled good documents, the raw one's on all documents.
N-grams are words, pairs of words and word heads (the first 4 and 6 bytes), in
2 ** ``BUCKET_BITS`` buckets.  An n-gram's log ratio is
``log((target + PRIOR) / (expected + PRIOR))``, expected being what the raw
model predicts for as many target n-grams.

A document's log weight is that of its weakest part: the smallest sum over
any ``PASSAGE`` words in a row, or, if smaller, the whole text's mean scaled
to ``TEXT_PASSAGE`` words.  So a few words that the target never uses count
in a long text as well, and length alone doesn't.

Gumbel noise, from a hash of the document, is added to each log weight; the
``k`` largest sums are a sample without replacement by weight.  Without a
``k``, it is set from labelled good documents that the model was not fitted
on: as many documents as reach the noisy weight that a share ``KEEP`` of
those reaches.  The k-th largest sum is found by counting, digit by digit.

A text without words (null, empty) has the log weight ``NO_WORDS`` and is
never drawn before one with words.  Documents labelled twice are good if all
their labels are; labels with nulls or of unknown documents are left out.
Without labels all weights are 0 and, without a ``k``, all documents are
drawn.  Rows that tie with the last one drawn are drawn too; a row that
repeats another, with its id, has the same sum.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, lean
from ledgerlens.session import materialize

#: Labelled good documents that the target model is fitted and the cut is set on, at most.
MAX_LABELLED = 50_000
#: One in so many of them is left out of the model and sets the cut.
HELD_OUT = 3
#: Share of the held-out good documents that the sample's size is set to draw.
KEEP = 0.99
BUCKET_BITS = 20
HEADS = (4, 6)
PRIOR = 1.0
PASSAGE, TEXT_PASSAGE = 8, 32
NO_WORDS = -1e6

_SIDE = 4096  # buckets of a row of counts
_SHIFT = np.uint64(64 - BUCKET_BITS)


def _buckets(w: W.Words) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of each word's own n-grams (word and heads), and of the bigram that it begins (-1: its row's last word)."""
    padded = np.zeros(len(w.buf) + 8, np.uint8)
    padded[:len(w.buf)] = w.buf
    eight = np.ndarray((len(w.buf) + 1,), "<u8", padded, strides=(1,))
    h = w.hashes()
    own = [(h >> _SHIFT).astype(np.int32)]
    for size in HEADS:
        head = eight[w.starts] & W._KEEP[np.minimum(w.ends - w.starts, size)]
        own.append((W.mix(head + W.mix(np.array([size], np.uint64))) >> _SHIFT).astype(np.int32))
    pair = np.full(len(h), -1, np.int32)
    pair[:-1] = (W.grams(h, 2) >> _SHIFT).astype(np.int32)
    pair[w.first[1:][w.counts > 0] - 1] = -1
    return own, pair


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, W.Words]]:
    return W.row_slices(batch, "__text", W.PLAIN, True)


def _models(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by bucket: of all documents, and of the target sample; read: __text, role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(1 << BUCKET_BITS, np.int32) for _ in range(2))
        for batch in batches:
            role = batch.column("role").to_numpy(zero_copy_only=False)
            for lo, hi, w in _words(batch):
                own, pair = _buckets(w)
                wanted = np.repeat(role[lo:hi] == 1, w.counts)
                for x in (*own, pair):
                    raw += np.bincount(x[x >= 0], minlength=len(raw)).astype(np.int32)
                    target += np.bincount(x[(x >= 0) & wanted], minlength=len(raw)).astype(np.int32)
        for lo in range(0, len(raw), _SIDE):
            if raw[lo:lo + _SIDE].any():
                yield _row([lo], [raw[lo:lo + _SIDE]], [target[lo:lo + _SIDE]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cell in enumerate(batch.column("cell").to_pylist()):
                both = np.stack([np.asarray(batch.column(c)[k].values, np.int64) for c in ("raw", "target")])
                total[cell] = total.get(cell, 0) + both
        if total:
            yield _row(list(total), [x[0] for x in total.values()], [x[1] for x in total.values()], pa.int64())

    def _row(cells: list, raw: list, target: list, kind: pa.DataType = pa.int32()) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(raw, pa.list_(kind)), pa.array(target, pa.list_(kind))],
                                          names=["cell", "raw", "target"])

    # a task brings one row for each range of buckets at most
    counted = read.mapInArrow(lean(run), "cell long, raw array<int>, target array<int>")
    summed = counted.repartition("cell").mapInArrow(lean(add), "cell long, raw array<bigint>, target array<bigint>")
    raw, target = (np.zeros(1 << BUCKET_BITS) for _ in range(2))
    for r in summed.toLocalIterator():  # 2 ** BUCKET_BITS numbers of each model
        raw[r["cell"]:r["cell"] + _SIDE], target[r["cell"]:r["cell"] + _SIDE] = r["raw"], r["target"]
    return raw, target


def _weights(read: DataFrame, ratios) -> DataFrame:
    """The columns of ``read`` but the text, and log_weight."""
    own = [c for c in read.columns if c != "__text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratios.value
        for batch in batches:
            for lo, hi, w in _words(batch):
                own_buckets, pair = _buckets(w)
                each = sum(ratio[x] for x in own_buckets) + np.where(pair >= 0, ratio[pair], 0)
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
                weight = np.full(hi - lo, NO_WORDS)
                some = np.flatnonzero(w.counts)
                a, b = w.first[some], w.first[some + 1]
                whole = sums[b] - sums[a]
                weight[some] = np.where(b - a > TEXT_PASSAGE, whole * TEXT_PASSAGE / (b - a), whole)
                # the passage from each word on; one that would reach into the next row ends with its own
                begin = np.arange(len(sums) - 1)
                end = np.minimum(begin + PASSAGE, np.repeat(w.first[1:], w.counts))
                full = (end - begin == PASSAGE) | (begin == np.repeat(w.first[:-1], w.counts))
                passage = np.where(full, sums[end] - sums[begin], 2**62)
                if len(some):
                    weight[some] = np.minimum(weight[some], np.minimum.reduceat(passage, a)) / 2**20
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in own] + [pa.array(weight)], names=[*own, "log_weight"])

    return read.mapInArrow(lean(run), f"{kinds}, log_weight double")


def kth_largest(scored: DataFrame, k: int, column: str = "noisy", bins: int = 4096) -> float | None:
    """The k-th largest value of a double column; None if there are no more than ``k`` rows.

    Each round counts the values of the range in question by ``bins`` equal
    parts and goes on with the part that holds the k-th, between its smallest
    and largest value, until these are one.
    """
    x = F.col(column)
    low, high, n = scored.agg(F.min(x), F.max(x), F.count(x)).first()
    if n <= k or k < 1:
        return None if k >= 1 else float("inf")
    while low < high:
        part = F.floor((x - low) / ((high - low) / bins)) if (high - low) / bins > 0 else (x > low).cast("long")
        counts = scored.filter((x >= low) & (x <= high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r["part"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def _good(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` good documents by a hash of their id: id, role (1: the model's, 2: held out)."""
    good = labels.select(labels[id_col].alias("good"), "quality", "toxic").filter("good is not null").groupBy("good").agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok"),
        F.max(F.col("quality").isNull() | F.col("toxic").isNull()).alias("gap")).filter("ok and not gap")
    role = F.when(F.pmod(F.xxhash64("good", F.lit(1)), F.lit(HELD_OUT)) == 0, 2).otherwise(1)
    return good.orderBy(F.xxhash64("good"), "good").limit(most).select("good", role.alias("role"))


class Sampler:
    """The fitted models and the cut; ``score`` and ``keep`` apply them to the documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text: str = "text",
                 seed: int = 42, max_labelled: int = MAX_LABELLED, keep: float = KEEP):
        self.docs, self.id_col, self.text, self.seed = docs, id_col, text, seed
        spark = docs.sparkSession
        bound_batches(spark)
        sample = materialize(_good(labels, id_col, max_labelled), "labelled")
        read = docs.select(docs[id_col].alias("id"), docs[text].cast("string").alias("__text"))
        known = read.join(F.broadcast(sample), F.col("id") == F.col("good"), "left").select("__text", F.coalesce("role", F.lit(0)).alias("role"))
        raw, target = _models(known)
        expected = raw * (target.sum() / max(1.0, raw.sum()))
        # whole numbers: sums don't depend on where a batch begins
        self.ratios = spark.sparkContext.broadcast(np.round(np.log((target + PRIOR) / (expected + PRIOR)) * 2**20).astype(np.int64))
        scored = materialize(self.score().select("id", "noisy"), "scored")
        rows = scored.count()
        if k is None:
            held = scored.join(F.broadcast(sample.filter("role = 2")), F.col("id") == F.col("good")).select("noisy").limit(max_labelled)
            seen = sorted(r["noisy"] for r in held.collect())  # at most ``max_labelled`` numbers
            k = scored.filter(F.col("noisy") >= seen[int(len(seen) * (1 - keep))]).count() if seen else rows
        self.k = k
        self.cut = kth_largest(scored, k)

    def _noisy(self, df: DataFrame) -> DataFrame:
        uniform = (F.pmod("__noise", F.lit(2**53)).cast("double") + 0.5) / 2**53
        return df.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))

    def score(self) -> DataFrame:
        """id, log_weight and noisy (the log weight with Gumbel noise) of each row."""
        t = self.docs[self.text].cast("string")
        read = self.docs.select(self.docs[self.id_col].alias("id"), F.xxhash64(F.lit(self.seed), self.docs[self.id_col], t).alias("__noise"),
                                t.alias("__text"))
        return self._noisy(_weights(read, self.ratios)).drop("__noise")

    def drawn(self, scored: DataFrame) -> F.Column:
        return F.lit(True) if self.cut is None else scored["noisy"] >= F.lit(self.cut)

    def selected(self) -> DataFrame:
        """The id column, ``log_weight``, ``noisy`` and ``selected`` boolean of each row."""
        scored = self.score()
        return scored.select(F.col("id").alias(self.id_col), "log_weight", "noisy", self.drawn(scored).alias("selected"))

    def keep(self) -> DataFrame:
        """The drawn rows of the documents, all their columns."""
        t = self.docs[self.text].cast("string")
        packed = self.docs.select(F.struct(*self.docs.columns).alias("__row"), F.xxhash64(F.lit(self.seed), self.docs[self.id_col], t).alias("__noise"),
                                  t.alias("__text"))
        scored = self._noisy(_weights(packed, self.ratios))
        return scored.filter(self.drawn(scored)).select("__row.*")
