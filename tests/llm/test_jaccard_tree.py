import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tricky import documents

from ledgerlens.llm import components as C
from ledgerlens.llm import jaccard_tree as J


def brute(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def families(seed):
    rng, texts = random.Random(seed), [None, "", " \n", "a", "a b", "A B", "a b c", "x" * 50_000]
    words = [f"w{i}" for i in range(300)]
    for copies in [*[rng.randint(1, 12) for _ in range(20)], 120]:
        base = [rng.choice(words) for _ in range(rng.randint(8, 140))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                i, op = rng.randrange(len(t)), rng.random()
                if op < .4:
                    t[i] = rng.choice(words)
                elif op < .7 and len(t) > 3:
                    del t[i]
                else:
                    t.insert(i, rng.choice(words))
            texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("size,percent,rows", [(3, 90, 4096), (5, 80, 16), (3, 80, 4)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, rows):
    monkeypatch.setattr(J, "GROUP_ROWS", rows)  # the small ones cut groups into blocks
    texts = families(size)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bits", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs, size=size, percent=percent).collect()}
    assert got == brute(texts, size, percent)


@pytest.mark.parametrize("rows", [1, 2, 5, 7, 100])
def test_runs_stay_whole_over_batches(rows):
    rng = random.Random(rows)
    keys = sorted(rng.choice([rng.randint(-9, 40), 3, 4]) for _ in range(300))
    table = pa.table({"k": pa.array(keys, pa.int64()), "at": pa.array(range(300), pa.int64())})
    got = [t.column("k").to_pylist() for t in J._whole_runs(iter(table.to_batches(max_chunksize=rows)), "k")]
    assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:]))
    assert list(J._whole_runs(iter([]), "k")) == []


@pytest.mark.parametrize("count,half", [(5, 2), (17, 2), (100, 4), (1000, 50)])
def test_blocks_cover_all_pairs_that_sizes_allow(monkeypatch, count, half):
    monkeypatch.setattr(J, "GROUP_ROWS", 2 * half)
    rng = np.random.default_rng(count)
    n, rid = np.sort(rng.integers(50, 80, count)), rng.permutation(count).astype(np.int64) + 7
    rows = [r for b in J._blocks(rid, n, 80) for r in zip(*(b.column(c).to_pylist() for c in ("gid", "rid", "other")))]
    sets = {}
    for g, r, o in rows:
        if r is not None:
            sets.setdefault((g, o is not None), set()).add(r)
    assert sum(r is not None for _, r, _ in rows) <= 3 * count and all(len(x) <= 2 * half for x in sets.values())
    together = {frozenset(p) for (_, block), x in sets.items() if not block for p in itertools.combinations(x, 2)}
    together |= {frozenset((p, q)) for g, r, o in rows if r is None for p in sets[g, True] for q in sets[o, True]}
    size = dict(zip(rid.tolist(), n.tolist()))
    wanted = {frozenset(p) for p in itertools.combinations(size, 2) if 100 * min(size[x] for x in p) >= 80 * max(size[x] for x in p)}
    assert wanted <= together and all(len(p) == 2 for p in together)


def test_joined_up_blocks_are_not_filled(spark):
    """Pairs of blocks that lie in one component give no rows; a third block in another one does."""
    blocks = spark.createDataFrame([(g, 10 * g + k) for g in (1, 2, 3) for k in range(4)], "gid long, rid long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "gid long, other long")
    roots = spark.createDataFrame([(10 * g + k, 10) for g in (1, 2) for k in range(4)], "node long, root long")
    got = J._open_blocks(blocks, pairs, roots).collect()
    assert sorted(r.rid for r in got) == [20, 21, 22, 23, 30, 31, 32, 33] and len({r.gid for r in got}) == 1
    assert {r.rid: r.label for r in got} == {k: 10 if k < 30 else k for k in (20, 21, 22, 23, 30, 31, 32, 33)}


def test_small_batches_equal_brute_force(spark):
    texts = families(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(docs, size=3, percent=90).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == brute(texts, 3, 90)


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    got = J.join(docs, size=3, percent=90).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[2].__class__({(0, 1)}) and by[5] == {(2, 4)} and by[10] == {(1, 9)} and by[6] == {(10, 6), (4, 6)}
    assert J.join(docs.limit(0)).collect() == []


@pytest.mark.parametrize("local", [250_000, 15])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL_LINKS", local)  # the small one joins up partitions by stars
    rng = random.Random(4)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(40)] + [(500, k) for k in range(600, 650)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in list(root) if x not in alone}
