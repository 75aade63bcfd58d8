import random
from collections import Counter

import numpy as np
import pytest
from tricky import documents

from ledgerlens.llm import bloom
from ledgerlens.llm import line_dedup as L
from ledgerlens.llm import words as W

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, documents=10, keep_first=False):
    lines = [(t or "").split("\n") for _, t in rows]
    keys = [[x.strip(" \t\n\v\f\r").translate(LOWER) for x in own] for own in lines]
    seen = Counter(k for own in keys for k in set(own) if k)
    bad = {k for k, n in seen.items() if n >= documents}
    first = {}
    if keep_first:
        for (i, t), own in sorted(zip(rows, keys), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
            for n, k in enumerate(own):
                first.setdefault(k, (i, t, n))
    out = []
    for (i, t), own, ks in zip(rows, lines, keys):
        kept = [x for n, (x, k) in enumerate(zip(own, ks)) if k not in bad or (keep_first and first[k] == (i, t, n))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def told(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def sample(n=300):
    rng = random.Random(5)
    pool = ["Cookie Notice", " cookie notice\t", "All Rights Reserved", "É is not é", "é IS NOT É", "x" * 50, "\r", "", "mid", "rare one"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < .3 else f"own line {i} {k}" for k in range(rng.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("documents", [2, 10, 40])
@pytest.mark.parametrize("most_keys", [0, 1000])
def test_equals_brute_force(spark, documents, most_keys):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep in (False, True):
        assert told(L.dedup(docs, documents=documents, most_keys=most_keys, keep_first=keep)) == sorted(brute(rows, documents, keep), key=str)


@pytest.mark.parametrize("most_keys", [0, 1000])
def test_tricky_rows(spark, most_keys):
    docs, rows = documents(spark)
    assert told(L.dedup(docs, documents=2, most_keys=most_keys)) == sorted(brute(rows, 2), key=str)
    assert L.dedup(docs.limit(0)).collect() == []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "bits_for", lambda n, most=0: bloom.SEGMENT)
    rows = sample(2000)
    assert told(L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(brute(rows), key=str)


def test_filters_merge_like_one():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    whole, parts = bloom.Twice(18), []
    for k in range(4):
        own = np.concatenate([h[k * 1000:k * 1000 + 1000], h[4000:4100]])
        whole.add(own)
        part = bloom.Twice(18)
        part.add(own)
        parts += list(part.segments())
    merged = {r["segment"]: r for b in bloom._merge(iter(parts)) for r in b.to_pylist()}
    for k in range(4):
        at = slice(k * bloom.SEGMENT_BYTES, (k + 1) * bloom.SEGMENT_BYTES)
        assert (bloom._unpacked(merged[k]["once"]) == whole.once[at]).all() and (bloom._unpacked(merged[k]["twice"]) == whole.twice[at]).all()
    assert bloom.has(whole.twice, h[4000:4100], 18).all() and bloom.has(whole.twice, h[:1000], 18).mean() < .1


def test_span_hashes_tell_spans_apart():
    buf = np.frombuffer(b"abcdefgh" * 4 + b"abcdefgX" + b"hgfedcba", np.uint8)
    a, b = np.array([0, 8, 0, 0, 32, 40, 3, 3]), np.array([8, 16, 16, 15, 40, 48, 3, 4])
    h = W.span_hashes(buf, a, b)
    assert h[0] == h[1] and len(set(h.tolist())) == 7
