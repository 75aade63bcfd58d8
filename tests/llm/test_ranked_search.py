import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tricky import documents

from ledgerlens.llm import ranked_search as R


def terms(t):
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def brute(docs, items, top=50):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if x in c)
            if s > 0:
                scored.append((-s, -2**63 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1)]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def sample(n, seed=1):
    rng = random.Random(seed)
    text = lambda k: " ".join(f"W{min(int(rng.paretovariate(.7)), 400)}." for _ in range(k))
    docs = [(i * 7 % n, text(rng.choice([0, 3, 30, 30, 200]))) for i in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(80)]
    return docs, [(k, text(k)) for k in range(0, 40)] + [(50, docs[5][1]), (51, "w1 W1 w2"), (52, None), (53, ""), (54, "unheard")]


@pytest.mark.parametrize("window,chunk,short", [(1024, 1 << 15, 4), (16, 100, 4), (8, 1 << 15, 10 ** 9), (64, 500, 1)])
def test_equals_brute_force(spark, monkeypatch, window, chunk, short):
    monkeypatch.setattr(R, "WINDOW", window), monkeypatch.setattr(R, "CHUNK_DOCS", chunk), monkeypatch.setattr(R, "SHORT_SHARE", short)
    docs, items = sample(700)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert told(R.search(*frames)) == brute(docs, items)
    assert told(R.search(*frames, top=3, block=60)) == brute(docs, items, 3)


def test_windows_are_skipped(monkeypatch):
    """Late windows of weak documents aren't opened once the best are known."""
    monkeypatch.setattr(R, "WINDOW", 32)
    n = 1024
    lists = [bytes(np.array([0, 1], np.int32)) if i < 60 else bytes(np.array([1], np.int32)) for i in range(n)]
    chunk = R.Chunk(np.arange(n), np.full(n, 5), lists, [bytes(np.ones(len(t) // 4, np.int64)) for t in lists], np.array([900, 10]), (n, 5 * n))
    opened, part = [], R.Chunk._part
    monkeypatch.setattr(R.Chunk, "_part", lambda self, k, window, *a: opened.append(window) or part(self, k, window, *a))
    docs, scores = chunk.search(np.array([0, 1]), 50, 1)
    assert set(opened) == {0, 1} and sorted(docs)[:50] == list(range(50))


def test_lengths_past_64_bits():
    n = np.array([10**9, 3])
    assert R._length_parts(n, 10**12, 10**14).tolist() == [50 + 50 * 10**9 * 10**12 // 10**14, 50 + 50 * 3 * 10**12 // 10**14]


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    items = [(1, "one é tail"), (1, "one é tail"), (1, "lorem"), (None, "alone x y z"), (2, None), (3, "ONE")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert told(R.search(docs, frame)) == brute(rows, items)
    assert R.search(docs.limit(0), frame).collect() == [] and R.search(docs, frame.limit(0)).collect() == []
