"""Substring dedup: words covered by a window of words that starts anywhere else too.

Windows are found level by level.  A window of ``words`` words repeats only
if its shorter windows do; so short windows come first, and only where they
repeat are windows of twice the length looked at (9, 18 and 35 words for 35),
until no candidates survive or the full length is reached.  Longer windows
consist of repeated ones, so they would cover nothing more.

On all levels but the last, each full window is represented by one of its
short windows, the one with the smallest hash (the leftmost of equals).  Two
equal full windows choose the same short window at the same distance, so no
repetition is lost, and a fraction of the places is enough.

Whole copies of a text are known by a hash of all their words; all of them
are covered, and one stands for them in the search.  How often a window
occurs is summed before the shuffle, and the places join the repeated windows
from written tables, so that a passage of very many documents can be split.

Null and empty texts have no words.  Every row is a document: a row that
repeats another is a copy of it, whatever the ids.  An empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.scratch import bound_batches, release
from ledgerlens.session import materialize

#: Words of a window.
WORDS = 35
#: Keys of texts with candidates (16 bytes each) that are sent to every task at most, about 5 MB; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words of the shortest windows at least.
FIRST = 8


def levels(words: int, first: int = FIRST) -> list[int]:
    """Window lengths, each at most twice the one before, up to ``words``."""
    out = [words]
    while (half := -(-out[-1] // 2)) >= first:
        out.append(half)
    return out[::-1]


def leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the smallest of the next ``width`` values is (the leftmost of equals)."""
    at, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        if len(v) <= step:
            return at[:0]
        later = v[step:] < v[:-step]
        at = np.where(later, at[step:], at[:-step])
        v = np.where(later, v[step:], v[:-step])
        span += step
    return at


def _starts(w: W.Words, words: int) -> np.ndarray:
    """Which words of a slice begin a full window in their row, of those that any window could begin."""
    room = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts))
    return (room >= words)[:max(0, len(w.starts) - words + 1)]


def _chosen(h: np.ndarray, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``length`` words, and for each full window the place of the one that stands for it."""
    g = W.grams(h, length)
    return g, leftmost_min(g, words - length + 1)


def _facts(read: DataFrame, kind: str, words: int, length: int) -> DataFrame:
    """Of each row: n_words, a 128-bit hash and the digest of its words, and the first level's places and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = W.text_bytes(batch.column("__text"))
            for lo, hi, w in W.row_slices(batch, "__text"):
                h = w.hashes()
                order = W.mix((np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)).astype(np.uint64) + W._M3)
                total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                s1, s2 = total(W.mix(h ^ order)), total(W.mix(h + order))
                s1, s2 = (s[w.first[1:]] - s[w.first[:-1]] for s in (s1, s2))
                g, at = _chosen(h, words, length)
                places = np.unique(at[_starts(w, words)])
                cut = np.searchsorted(places, w.first)
                inner = (places - np.repeat(w.first[:-1], np.diff(cut))).astype(np.int32)
                marks = g[places]
                shas = [hashlib.sha256(b" ".join(buf[a:b].tobytes().split())).hexdigest() for a, b in zip(bounds[lo:hi], bounds[lo + 1:hi + 1])]
                pieces = list(zip(cut.tolist(), cut[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("id", "__id", "__hash")]
                    + [pa.array(w.counts.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(shas, pa.string()),
                       pa.array([inner[a:b].tobytes() for a, b in pieces], pa.binary()),
                       pa.array([marks[a:b].tobytes() for a, b in pieces], pa.binary())],
                    names=["id", "__id", "__hash", "n_words", "s1", "s2", "sha", "places", "marks"])

    return read.mapInArrow(run, f"id {kind}, __id long, __hash long, n_words long, s1 long, s2 long, sha string, places binary, marks binary")


def _unpacked(active: DataFrame) -> DataFrame:
    """(mark, rid, place) of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                places, marks = part.column("places").to_pylist(), part.column("marks").to_pylist()
                n = [len(m) // 8 for m in marks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(marks), np.int64)), pa.array(np.repeat(part.column("rid").to_numpy(), n)),
                     pa.array(np.frombuffer(b"".join(places), np.int32))], names=["mark", "rid", "place"])

    return active.select("rid", "places", "marks").mapInArrow(run, "mark long, rid long, place int")


def _repeated(rows: DataFrame, level: int) -> DataFrame:
    """(rid, places array<int>) of the rows whose mark occurs twice or more."""
    counts = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    marks = materialize(counts, f"marks-{level}")
    found = rows.join(marks, "mark", "left_semi").groupBy("rid").agg(F.collect_list("place").alias("places"))
    return materialize(found, f"places-{level}")


def _next_rows(work: DataFrame, words: int, before: int, length: int) -> DataFrame:
    """(mark, rid, place) of one level where the level ``before`` repeats; work: rid, text, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for lo, hi, w in W.row_slices(batch, "text"):
                h = w.hashes()
                alive = np.flatnonzero(_alive(w, h, batch.column("places").slice(lo, hi - lo), words, before))
                if not len(alive):
                    continue
                if length < words:
                    g, at = _chosen(h, words, length)
                    alive = np.unique(at[alive])
                else:
                    g = W.grams(h, words)
                row = np.searchsorted(w.first, alive, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[alive].view(np.int64)), pa.array(rid[lo + row]), pa.array((alive - w.first[row]).astype(np.int32))],
                    names=["mark", "rid", "place"])

    return work.mapInArrow(run, "mark long, rid long, place int")


def _alive(w: W.Words, h: np.ndarray, places: pa.Array, words: int, length: int) -> np.ndarray:
    """Which full windows of a slice have a repeated window of ``length`` standing for them."""
    marked = np.zeros(len(h) + 1, bool)
    sizes = np.diff(places.offsets.to_numpy())
    flat = places.flatten().to_numpy()
    marked[flat + np.repeat(w.first[:-1], sizes)] = True
    ok = _starts(w, words)
    if length == words:
        return ok & marked[:len(ok)]
    _, at = _chosen(h, words, length)
    return ok & marked[at]


def _covered(work: DataFrame, words: int) -> DataFrame:
    """rid, n_removed and the digest of the words left; work: rid, text, places (starts of repeated full windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for k in range(batch.num_rows):
                own = texts[k].as_py().encode().split()
                change = np.zeros(len(own) + 1, np.int32)
                starts = batch.column("places")[k].values.to_numpy()
                change[starts] += 1
                change[starts + words] -= 1
                gone = np.cumsum(change)[:-1] > 0
                left = [x for x, y in zip(own, gone.tolist()) if not y]
                yield pa.RecordBatch.from_pydict({
                    "rid": [batch.column("rid")[k].as_py()], "removed": pa.array([int(gone.sum())], pa.int64()),
                    "left_sha": [hashlib.sha256(b" ".join(left)).hexdigest()]})

    return work.mapInArrow(run, "rid long, removed long, left_sha string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The id column, ``n_words``, ``n_removed`` long and ``kept_sha256`` of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    read = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("__id"),
                       F.xxhash64(docs[id_col], t).alias("__hash"), t.alias("__text"))
    lengths = levels(words)
    facts = _facts(read, read.schema["id"].dataType.simpleString(), words, lengths[0])
    facts = materialize(facts.withColumn("rid", F.monotonically_increasing_id()), "facts")
    copies = materialize(facts.filter(F.col("n_words") >= words).groupBy("n_words", "s1", "s2").agg(
        F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copies")
    copied = materialize(facts.select("rid", "n_words", "s1", "s2").join(copies, ["n_words", "s1", "s2"]).select("rid", "first"), "copied")
    others = copied.filter("rid != first").select("rid")
    active = materialize(facts.filter("length(places) > 0").select("rid", "places", "marks").join(others, "rid", "left_anti"), "active")
    release(spark)
    places = _repeated(_unpacked(active), 0)
    release(spark, active)
    # the texts that have candidates; rows that repeat an id and a text count once
    keys = materialize(facts.select("rid", "__id", "__hash").join(places, "rid"), "keys")
    wanted = materialize(keys.select("__id", "__hash").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # only texts with candidates are shuffled, once each
    one = read.select("__id", "__hash", F.col("__text").alias("text")).join(wanted, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    work = materialize(one.join(keys, ["__id", "__hash"]).select("rid", "text", "places"), "work")
    release(spark, places)
    for k in range(1, len(lengths)):
        rows = materialize(_next_rows(work, words, lengths[k - 1], lengths[k]), f"rows-{k}")
        places = _repeated(rows, k)
        release(spark, rows)
        narrowed = materialize(work.select("rid", "text").join(places, "rid"), f"work-{k}")
        release(spark, work, places)
        work = narrowed
    whole = copied.select("rid", F.lit(True).alias("whole"))
    part = materialize(_covered(work, words), "covered")
    release(spark, work)
    return facts.select("id", "rid", "n_words", "sha").join(whole, "rid", "left").join(part, "rid", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"))
