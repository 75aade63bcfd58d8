import random
import re
from collections import Counter

from tricky import documents

from ledgerlens.llm import quality_rules as Q


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, same = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        same += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    twice = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), same, len(twice)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    bits = ["a", "b", "a b c d e f ", "\n", " ", "é#", "\x0b", "x|y", "a b\n", "\u00a0"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["w " * 5000]
    got = Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_rules(spark):
    rules = (Q.Rule("a", "n_symbols", "n_words", None, 0.5), Q.Rule("b", "word_chars", "n_words", 2.0, None, 12))
    rows = [(1, "# # # # # # " + "word " * 6), (2, "# " * 7 + "word " * 6), (3, "one two three four five six seven eight nine ten"),
            (4, " ".join("abcdefghijklm")), (5, " ".join("abcdefghijk"))]
    got = {r.doc_id: r.broken_rules for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()}
    assert got == {1: [], 2: ["a"], 3: [], 4: ["b"], 5: []}
    assert Q.judge(spark.createDataFrame(rows, "doc_id long, text string"), rules=()).filter("size(broken_rules) > 0").count() == 0


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    got = Q.judge(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_repeat_words) for r in got) == sorted((i or 0, counts(t)[0], counts(t)[4]) for i, t in rows)
    assert Q.judge(docs.limit(0)).collect() == []
