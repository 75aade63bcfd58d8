import random
import re

import pytest
from tricky import documents

from ledgerlens.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, size=10):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            for win in {tuple(x[i:i + size]) for i in range(max(1, len(x) - size + 1))} if x else ():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i:i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("alphabet,block", [(300, 200_000), (2, 200_000), (300, 40)])
def test_equals_brute_force(spark, alphabet, block):
    rng = random.Random(alphabet)
    fresh = lambda k: [f"W{rng.randrange(alphabet)}" for _ in range(k)]
    items = [fresh(k) for k in (1, 2, 3, 5, 9, 10, 11, 14, 25, 30, 30)]
    items.append(items[8][:])
    rows = [(k, " ".join(x)) for k, x in enumerate(items)] + [(20, None), (21, ""), (None, " ".join(items[9])), (3, " ".join(fresh(12)))]
    texts = []
    for _ in range(50):
        t = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(items)
            t += rng.choice([fresh(rng.randint(0, 30)), x, x[1:], x[:-1]])
        texts.append(rng.choice([" ", ", ", "\n"]).join(t).lower())
    texts += [None, "", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.hits(docs, bench, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, rows)
    assert all(r.n_items == len(r["items"]) for r in D.hits(docs, bench, block=block).collect())


def test_a_sentence_shared_by_many_items(spark):
    """The windows that go to the tasks carry no items, however many share one."""
    shared, fresh = " ".join(f"s{k}" for k in range(10)), lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    items = [(i, shared + " " + fresh(i) if i % 3 == 0 else fresh(i)) for i in range(1500)]
    texts = [f"before {shared} after"] * 40 + [fresh(7), fresh(9), "nothing here", shared + " " + fresh(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    all_shared = sorted(str(i) for i in range(0, 1500, 3))
    for block in (200_000, 500):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in D.hits(docs, bench, block=block).collect()}
        assert all(got[k] == (10, all_shared) for k in range(40))
        assert [got[40], got[41], got[42], got[43]] == [(10, ["7"]), (10, ["9"]), (0, []), (20, all_shared)]
    rows = D.windows(bench, "item_id", "text", 10).select("words").distinct().selectExpr("words", "0L AS window").collect()
    sizes = [len(x) for x in vars(D.Index(rows, 10, 3)).values() if isinstance(x, list)]
    assert max(sizes) <= 3  # the shingle sizes are the one list left


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "one"), (3, None)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in D.hits(docs, bench).collect()), key=str)
    want = brute([t for _, t in rows], [(1, "a b c d e f g h i j k"), (2, "one")])
    assert got == sorted(((i or 0, *x) for (i, _), x in zip(rows, want)), key=str)
    assert D.hits(docs.limit(0), bench).collect() == []
    assert {r.n_hit for r in D.hits(docs, bench.limit(0)).collect()} == {0}
