"""N-gram Jaccard join by signature trees: groups of texts whose word shingle sets overlap enough.

Two sets link if ``100 * intersection >= percent * union``.  The steps:

1. Equal sets fold into classes, so exact copies cost one row each.
2. Shingles are ordered by how full their bucket of a count sketch is (all
   documents counted), then by hash.  Linked sets share a shingle among the
   first few of either in any such order (prefix filter); the sets that share
   one, with sizes and places that allow a link, form a candidate group.
   Groups of the same sets are kept once.
3. In each group a signature tree is built: a leaf is a set's token bitmap,
   its size and its surplus (tokens less bits), an inner node the OR of its
   children's bitmaps, their size range and largest surplus.  Two nodes can
   share at most the common bits plus the smaller surplus; a pair of nodes
   that can't reach the least overlap its sizes ask for is cut.
4. First, hubs take the sets that they may link to; these pairs are verified
   on the full texts, and links become components.  Then trees over groups
   with more than one component are traversed against themselves: for some
   rounds, only each set's best partner of another component is verified, as
   long as that finds links; at last all pairs of different components are.
   So a group of many near copies needs a few pairs a text, and yet no link
   between components is missed.

A group of more than ``GROUP_ROWS`` sets is cut into blocks of half as many, by
size.  Neighbouring blocks are groups of their own, so hubs join up a large
family along its chain of blocks.  Other pairs of blocks are written as two
numbers each; only those that still hold more than one component are filled
with their sets, by a Spark join, in the rounds of step 4.

Null and empty texts, and those without words, have an empty set, are linked
with nothing and are their own component.  Every row is a document; rows that
repeat a text are in one class, whatever their ids.  A component's id is its
smallest document id (null if it has none).  An empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.components import components
from ledgerlens.llm.scratch import bound_batches, lean, release
from ledgerlens.session import materialize

#: Words of a shingle and the least similarity in percent, unless a caller says otherwise.
SIZE, PERCENT = 5, 80
#: Buckets of the count sketch: 2 to this power.
SKETCH_BITS = 18
#: Bits of a set's token bitmap.
BITMAP_BITS = 2048
#: Children of a tree node.
FANOUT = 8
#: Rounds of best partners before all pairs of different components are looked at; more rounds leave fewer of these.
BEST_ROUNDS = 3
#: Sets of a candidate group that one task handles; larger groups are cut into blocks of half as many.
GROUP_ROWS = 4096

#: Pairs and keys (16 and 24 bytes each) that are sent to every task at most, about 5 MB; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Partners whose texts one task compares with a hub's, about.
CHUNK_PARTNERS = 256

_WORDS64 = BITMAP_BITS // 64
_SIDE = 512  # sketch cells of a row of counts on their way to the driver


def shingle_sets(w: W.Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``size`` are one shingle."""
    h = w.hashes()
    g = W.grams(h, size)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(g[a:b - size + 1])
        elif b > a:
            yield W.grams(h[a:b], b - a)
        else:
            yield h[:0]


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, W.Words]]:
    return W.row_slices(batch, "__text", W.PLAIN, True)


def _sketch(read: DataFrame, size: int) -> np.ndarray:
    """Shingles by bucket over all documents, as 16-bit ranks of the counts' logarithms."""
    cells = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, w in _tokens(batch):
                g = W.grams(w.hashes(), size)
                row = w.row_of()
                g = g[row[:len(g)] == row[size - 1:]]
                counts += np.bincount((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        for lo in range(0, cells, _SIDE):
            part = counts[lo:lo + _SIDE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"cell": [lo], "n": pa.array([part], pa.list_(pa.int64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, n in zip(batch.column("cell").to_pylist(), batch.column("n")):
                total[cell] = total.get(cell, 0) + np.asarray(n.values)
        if total:
            yield pa.RecordBatch.from_pydict({"cell": list(total), "n": pa.array(list(total.values()), pa.list_(pa.int64()))})

    schema = "cell long, n array<bigint>"
    # each task brings at most one row of counts for each cell range, and sums them one by one
    summed = read.select("__text").mapInArrow(lean(run), schema).repartition("cell").mapInArrow(lean(add), schema)
    counts = np.zeros(cells, np.int64)
    for r in summed.collect():  # 2 ** SKETCH_BITS numbers in all
        counts[r["cell"]:r["cell"] + _SIDE] += r["n"]
    logs = np.log1p(counts)
    return (logs * (65535 / max(1e-9, logs.max()))).astype(np.uint16)


def prefix_length(n, percent: int):
    """Shingles, from the rarest on, among which a set of ``n`` shares one with every set it links to."""
    return n + percent * n // -100 + 1


def least_overlap(a, b, percent: int):
    return -(-percent * (a + b) // (100 + percent))


def _facts(read: DataFrame, id_kind: str, size: int, percent: int, ranks) -> DataFrame:
    """Of each row: n, a 128-bit hash of its set, its prefix (shingles, rarest first) and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value.astype(np.uint64)
        for batch in batches:
            for lo, hi, w in _tokens(batch):
                n, h1, h2, prefix, bits = [], [], [], [], []
                for s in shingle_sets(w, size):
                    n.append(len(s))
                    h1.append(int(W.mix(s).sum(dtype=np.uint64)))
                    h2.append(int(W.mix(s ^ W._M3).sum(dtype=np.uint64)))
                    if 100 * len(s) < percent * (len(s) + 1):  # no other set can link to so small a one
                        prefix.append(b""), bits.append(b"")
                        continue
                    order = np.argsort(rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(48) | s >> np.uint64(16), kind="stable")
                    prefix.append(s[order[:prefix_length(len(s), percent)]].tobytes())
                    map_ = np.zeros(BITMAP_BITS, np.uint8)
                    map_[(s & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = 1
                    bits.append(np.packbits(map_).tobytes())
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("id", "__id", "__hash")]
                    + [pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())],
                    names=["id", "__id", "__hash", "n", "h1", "h2", "prefix", "bits"])

    return read.mapInArrow(lean(run), f"id {id_kind}, __id long, __hash long, n long, h1 long, h2 long, prefix binary, bits binary")


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of a sorted key column; a run can be longer than a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and (first := held[0].column(key)[0].as_py()) == k[0] == k[-1]:
            held.append(batch)
            continue
        cut = int(np.argmax(k == k[-1]))  # where the last run begins
        if cut == 0 and held and first != k[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
            continue
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """Sets that share a prefix shingle and can link by their sizes, as distinct (gid, rid, other); reps: rid, n, prefix.

    A row is a group's set (other: null), a block's set (other: the block, as
    gid), or a pair of blocks gid and other (rid: null) that are no neighbours.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keys = part.column("prefix").to_pylist()
                size = np.array([len(k) // 8 for k in keys], np.int64)
                first = np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(np.repeat(part.column("rid").to_numpy(), size)),
                     pa.array(np.repeat(part.column("n").to_numpy(), size).astype(np.int32)),
                     pa.array((np.arange(size.sum()) - first).astype(np.int32))], names=["key", "rid", "n", "pos"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, "key"):
            key, rid, n, pos = (table.column(c).to_numpy() for c in ("key", "rid", "n", "pos"))
            n = n.astype(np.int64)
            # a run ends with its key, or where the next size is too large for all before it
            cut = np.ones(len(key), bool)
            cut[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
            first = np.flatnonzero(cut)
            size = np.diff(np.append(first, len(key)))
            # in a link, the smaller set has the shared shingle among fewer first ones
            near = np.logical_or.reduceat(pos < n - least_overlap(n, n, percent) + 1, first)
            left = np.minimum.reduceat(n - pos, first)  # shingles from here on: an upper bound of what is shared
            least = least_overlap(n[first], n[first], percent)
            keep = (size > 1) & near & ((size > 2) | (left >= least))
            out_gid, out_rid = [], []
            small = keep & (size <= GROUP_ROWS)
            rows = np.repeat(small, size)
            mixed = W.mix(rid.astype(np.uint64) + W._M3)
            total = np.add.reduceat(mixed, first)
            out_gid.append(np.repeat(W.mix(total), size)[rows]), out_rid.append(rid[rows])
            gid = np.concatenate(out_gid)
            if len(gid):
                yield from _grouped(gid, np.concatenate(out_rid))
            for f, s in zip(first[keep & ~small].tolist(), size[keep & ~small].tolist()):
                yield from _blocks(rid[f:f + s], n[f:f + s], percent)

    rows = reps.mapInArrow(lean(explode), "key long, rid long, n int, pos int")
    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(lean(group), "gid long, rid long, other long").distinct()


def _grouped(gid: np.ndarray, rid: np.ndarray | None, other: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (gid, rid, other) from hashes and ids; what isn't there is null."""
    nulls = pa.nulls(len(gid), pa.int64())
    columns = [pa.array(gid.view(np.int64)), nulls if rid is None else pa.array(rid), nulls if other is None else pa.array(other.view(np.int64))]
    return iter(pa.Table.from_arrays(columns, names=["gid", "rid", "other"]).to_batches(max_chunksize=50_000))


def _blocks(rid: np.ndarray, n: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """A large group, by rising size: its neighbouring blocks as groups, and the other pairs of blocks that can link by size.

    About three rows a set, and a row for each pair of blocks.
    """
    half = GROUP_ROWS // 2
    begin = np.arange(0, len(rid), half)
    end = np.append(begin[1:], len(rid))
    mixed = W.mix(rid.astype(np.uint64) + W._M3)
    total = np.add.reduceat(mixed, begin)
    for x in range(len(begin) - 1):
        a, b = begin[x], end[x + 1]
        yield from _grouped(np.repeat(W.mix(total[x:x + 2].sum(dtype=np.uint64, keepdims=True)), b - a), rid[a:b])
    # a block's name isn't that of a group of the same sets
    name = W.mix(total + W._M3)
    last = np.searchsorted(percent * n[begin], 100 * n[end - 1], "right")  # blocks before this one can link by size
    place = np.arange(len(begin))
    used = last > place + 2
    pairs = np.flatnonzero(used).tolist()
    used[2:] |= last[:-2] > place[2:]  # the block two before reaches the farthest
    for k in np.flatnonzero(used).tolist():
        own = np.repeat(name[k], end[k] - begin[k])
        yield from _grouped(own, rid[begin[k]:end[k]], own)
    for k in pairs:
        others = name[k + 2:last[k]]
        yield from _grouped(np.repeat(name[k], len(others)), None, others)


def _open_blocks(blocks: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(gid, rid, label) of the pairs of blocks with more than one component; blocks: gid, rid; pairs: gid, other."""
    labelled = materialize(_labelled(blocks, roots), "labelled")
    spans = materialize(labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")), "spans")
    of = lambda c: spans.select(F.col("gid").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
    mixed = pairs.join(of("gid"), "gid").join(of("other"), "other").filter(F.least("low_gid", "low_other") < F.greatest("high_gid", "high_other"))
    sides = mixed.select(F.xxhash64("gid", "other").alias("pair"), F.explode(F.array("gid", "other")).alias("gid"))
    return sides.join(labelled, "gid").select(F.col("pair").alias("gid"), "rid", "label")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """gid, rid and label: the set's component."""
    return members.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("gid", "rid", F.coalesce("root", "rid").alias("label"))


class Tree:
    """Signature tree over sets in a given order: arrays of each level, leaves first."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        surplus = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, surplus, label)]
        while len(bits) > 1:
            first = np.arange(0, len(bits), FANOUT)
            bits = np.bitwise_or.reduceat(bits, first, axis=0)
            low, high = np.minimum.reduceat(self.levels[-1][1], first), np.maximum.reduceat(self.levels[-1][2], first)
            surplus, one = np.maximum.reduceat(surplus, first), np.minimum.reduceat(label, first)
            # a label stays on a node whose leaves all have it
            label = np.where((one == np.maximum.reduceat(label, first)), one, -1)
            self.levels.append((bits, low, high, surplus, label))

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest possible similarity of pairs of leaves."""
        bits, n, _, surplus, _ = self.levels[0]
        both = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(surplus[a], surplus[b])
        both = np.minimum(both, np.minimum(n[a], n[b]))
        return both / (n[a] + n[b] - both)


def _possible(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs (a of x, b of y) can hold a link, by sizes and the largest possible overlap."""
    low_a, low_b, high_a, high_b = x[1][a], y[1][b], x[2][a], y[2][b]
    ok = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    at = np.flatnonzero(ok)
    a, b = a[at], b[at]
    common = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
    ok[at] = np.minimum(common, np.minimum(x[2][a], y[2][b])) >= least_overlap(low_a[at], low_b[at], percent)
    return ok


def search_first(tree: Tree, percent: int) -> list[tuple[int, int]]:
    """A pair (earlier, later) for each set with a possible earlier partner: hubs take all sets that they may link to."""
    n = len(tree.levels[0][1])
    free = np.ones(n, bool)
    pairs = []
    for hub in range(n):
        if not free[hub]:
            continue
        free[hub] = False
        one = tuple(z[hub:hub + 1] for z in tree.levels[0])
        nodes = np.zeros(1, np.int64)
        for depth in range(len(tree.levels) - 1, -1, -1):
            level = tree.levels[depth]
            nodes = nodes[_possible(one, level, np.zeros(len(nodes), np.int64), nodes, percent)]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(tree.levels[depth - 1][1])]
        nodes = nodes[free[nodes]]
        free[nodes] = False
        pairs += [(hub, x) for x in nodes.tolist()]
    return pairs


def best_partners(tree: Tree, percent: int) -> list[tuple[int, int]]:
    """For each leaf that can link to one with another label, the one that it is most alike."""
    n = len(tree.levels[0][1])
    score, partner = np.zeros(n), np.full(n, -1, np.int64)
    for a, b in dual_traversal(tree, percent):
        alike = tree.likeness(a, b)
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((-y, alike, x))
            last = order[np.append(x[order][1:] != x[order][:-1], True)]
            better = last[alike[last] > score[x[last]]]
            score[x[better]], partner[x[better]] = alike[better], y[better]
    return [(x, int(partner[x])) for x in np.flatnonzero(partner >= 0).tolist()]


def dual_traversal(tree: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves with different labels that can link, some at a time."""
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, a, b = stack.pop()
        level = tree.levels[depth]
        differ = (level[4][a] != level[4][b]) | (level[4][a] < 0)
        a, b = a[differ], b[differ]
        ok = _possible(level, level, a, b, percent)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if depth == 0:
            yield a, b
            continue
        below, step = len(tree.levels[depth - 1][1]), np.arange(FANOUT)
        for lo in range(0, len(a), 20_000):
            x = (a[lo:lo + 20_000, None, None] * FANOUT + step[:, None] + 0 * step).reshape(-1)
            y = (b[lo:lo + 20_000, None, None] * FANOUT + step + 0 * step[:, None]).reshape(-1)
            keep = (x < below) & (y < below) & ((x < y) | (x == y) & (depth > 1))
            stack.append((depth - 1, x[keep], y[keep]))


def _tree_pairs(grouped: DataFrame, percent: int, wanted: str) -> DataFrame:
    """(gid, a, b), a < b, that the groups' trees let pass; grouped: gid, rid, n, bits, label.

    wanted: ``hubs`` (``search_first``), ``best`` (``best_partners``) or ``all`` (``dual_traversal``).
    """
    search = {"hubs": search_first, "best": best_partners}.get(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[np.ndarray] = []

        def tell() -> Iterator[pa.RecordBatch]:
            if told:
                gid, x, y = np.concatenate(told, axis=1)
                told.clear()
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["gid", "a", "b"])

        for table in _whole_runs(batches, "gid"):
            gid, rid, n, label = (table.column(c).to_numpy() for c in ("gid", "rid", "n", "label"))
            column = table.column("bits").combine_chunks()
            bits = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(gid), _WORDS64)
            first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
            size = np.diff(np.append(first, len(gid)))
            two = first[size == 2]  # a tree of two leaves is one comparison
            level = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), label)
            ok = two[(label[two] != label[two + 1]) & _possible(level, level, two, two + 1, percent)]
            told.append(np.stack([gid[ok], rid[ok], rid[ok + 1]]))
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                tree = Tree(bits[f:f + s], n[f:f + s], label[f:f + s])
                if search:
                    found = [np.array(x, np.int64).T for x in [search(tree, percent)] if x]
                else:
                    found = map(np.stack, dual_traversal(tree, percent))
                for x in found:
                    told.append(np.concatenate([np.full((1, x.shape[1]), gid[f]), rid[f + x]]))
                    if sum(x.shape[1] for x in told) > 200_000:
                        yield from tell()
            yield from tell()

    # hubs are the smallest sets; else components lie together, so that nodes have one label
    order = ["gid", "n", "rid"] if wanted == "hubs" else ["gid", "label", "n", "rid"]
    return grouped.repartition("gid").sortWithinPartitions(*order).mapInArrow(lean(run), "gid long, a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose texts' shingle sets link; texts: rid, text.

    Of each pair the row in more pairs is the hub.  Its text goes once to each
    chunk of at most about ``CHUNK_PARTNERS`` partners, whose texts go along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            hub, partner, text = batch.column("hub").to_pylist(), batch.column("partner").to_pylist(), batch.column("text")
            keep = []
            for k, y in enumerate(partner):
                other = _one_set(text.slice(k, 1), size)
                if y is None:  # the hub comes first
                    own = other
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    keep.append((min(hub[k], y), max(hub[k], y)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d")), "degree")
    of = lambda c: degree.select(F.col("x").alias(c), F.col("d").alias(f"d_{c}"))
    first = F.col("d_a") >= F.col("d_b")
    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("partner"),
        F.pmod(F.xxhash64(F.when(first, F.col("b")).otherwise(F.col("a"))), F.ceil(F.greatest("d_a", "d_b") / CHUNK_PARTNERS)).alias("chunk"))
    dealt = materialize(dealt, "dealt")
    # few pairs go to the texts; else both are dealt out by row id
    hubs = materialize(dealt.select("hub", "chunk").distinct(), "hubs")
    one = _if_few(hubs).join(texts.withColumnRenamed("rid", "hub"), "hub").withColumn("partner", F.lit(None).cast("long"))
    other = _if_few(dealt).join(texts.withColumnRenamed("rid", "partner"), "partner")
    return one.unionByName(other).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("partner").asc_nulls_first()) \
        .select("hub", "partner", "text").mapInArrow(lean(run), "a long, b long")


def _if_few(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _one_set(text: pa.Array, size: int) -> np.ndarray:
    buf, bounds = W.text_bytes(text)
    return next(shingle_sets(W.Words(buf, bounds, W.PLAIN, True), size))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The id column, ``text_hash`` (of id and text), ``n_shingles`` long and ``component_id`` of each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    read = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("__id"),
                       F.xxhash64(docs[id_col], t).alias("__hash"), t.alias("__text"))
    kind = read.schema["id"].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(_sketch(read, size))
    base = materialize(_facts(read, kind, size, percent, ranks).withColumn("rid", F.monotonically_increasing_id()), "facts")
    same = ["n", "h1", "h2"]
    classes = materialize(base.filter("n > 0").groupBy(*same).agg(F.min("rid").alias("rep"), F.min("id").alias("low")), "classes")
    reps = base.filter("length(prefix) > 0").select("rid", "n", "prefix").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    groups = materialize(_candidate_groups(reps, percent), "groups")
    members = groups.filter("other is null").select("gid", "rid")
    blocks, crossed = groups.filter("other = gid").select("gid", "rid"), groups.filter("rid is null").select("gid", "other")
    many = not crossed.isEmpty()
    info = base.select("rid", "n", "bits")
    hubs = _tree_pairs(members.join(info, "rid").withColumn("label", F.col("rid")), percent, "hubs")
    hubs = materialize(hubs, "hubs")
    # groups without any pair that could link are done with
    members = materialize(members.join(hubs.select("gid").distinct(), "gid", "left_semi"), "members")
    involved = members.select("rid").unionByName(blocks.select("rid")) if many else members.select("rid")
    involved = materialize(involved.distinct(), "involved")
    info = materialize(info.join(involved, "rid", "left_semi"), "info")
    keys = materialize(base.select("rid", "__id", "__hash").join(involved, "rid", "left_semi"), "keys")
    texts = read.select("__id", "__hash", "__text").join(_if_few(keys), ["__id", "__hash"]).select("rid", F.col("__text").alias("text"))
    texts = materialize(texts.dropDuplicates(["rid"]), "texts")
    release(spark)
    tried = materialize(hubs.select("a", "b").distinct(), "pairs")
    links = materialize(_verified(tried, texts, size, percent), "links")
    roots = materialize(components(links), "roots")
    rounds = ["best"] * BEST_ROUNDS + ["all"]
    while rounds:
        wanted = rounds.pop(0)
        labelled = materialize(_labelled(members, roots), "labelled")
        mixed = labelled.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("gid")
        open_ = labelled.join(materialize(mixed, "mixed"), "gid", "left_semi")
        open_ = materialize(open_.unionByName(_open_blocks(blocks, crossed, roots)) if many else open_, "open")
        found = _tree_pairs(open_.join(info, "rid"), percent, wanted).select("a", "b").distinct()
        found = materialize(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = materialize(_verified(found, texts, size, percent), "links")
        new, known = more.count(), links.count()
        tried, links = tried.unionByName(found), links.unionByName(more)
        if new:
            roots = materialize(components(links), "roots")
        if new * 20 < known:  # best partners hardly find anything: to the last step
            rounds = rounds[-1:]
        release(spark, labelled, open_)
    owned = classes.join(roots, F.col("rep") == F.col("node"), "left").select(*same, "low", F.coalesce("root", "rep").alias("root"))
    owned = materialize(owned, "owned")
    lowest = materialize(owned.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = materialize(owned.join(lowest, "root").select(*same, "component_id"), "named")
    return base.select("id", "__hash", *same).join(named, same, "left").select(
        F.col("id").alias(id_col), F.col("__hash").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
