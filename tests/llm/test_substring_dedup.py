import hashlib
import random
import re
from collections import Counter

import pytest
from tricky import documents

from ledgerlens.llm import substring_dedup as D


def brute(texts, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for k in range(n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n,alphabet", [(35, 400), (35, 2), (17, 3), (8, 50)])
def test_equals_brute_force(spark, n, alphabet):
    rng = random.Random(n + alphabet)
    fresh = lambda k: [f"w{rng.randrange(alphabet)}" for _ in range(k)]
    passages, texts = [fresh(k) for k in (n - 1, n, n + 1, 2 * n, 5 * n)], []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += rng.choice([fresh(rng.randint(0, 40)), rng.choice(passages)])
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += [texts[5], texts[6], " " + texts[6], None, "", "z " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in D.dedup(docs, words=n).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, n)


def test_levels_at_most_double():
    for n in range(8, 200):
        steps = D.levels(n)
        assert steps[-1] == n and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in D.dedup(docs).collect())
    assert got == sorted((i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 35)))
    assert D.dedup(docs.limit(0)).collect() == []
