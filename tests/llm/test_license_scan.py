import random
import re

import pytest
from tricky import documents

from ledgerlens.llm import license_scan as L


@pytest.mark.parametrize("text,want", [
    ("MIT", ({"mit"}, True)),
    ("(MIT OR GPL-3.0-only) AND Apache-2.0", ({"mit", "gpl-3.0", "apache-2.0"}, True)),
    ("MIT AND GPL-3.0+", ({"mit", "gpl-3.0"}, False)),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MPL-2.0 AND MPL-2.0", ({"gpl-2.0", "mpl-2.0"}, True)),
    ("MPL-2.0 OR MIT AND GPL-2.0", ({"mpl-2.0", "mit", "gpl-2.0"}, False)),
    ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT Apache-2.0", None), ("", None), ("WITH MIT", None), ("MIT WITH GPL-2.0", None),
    ("Classpath-exception-2.0", None), ("my own licence", None), ("()", None),
])
def test_expressions(text, want):
    assert L.evaluate(text) == want


def test_expressions_equal_truth_tables():
    """Random expressions of known identifiers: permissive if the expression holds with permissive names true, the others false."""
    rng = random.Random(8)

    def build(depth):
        if not depth or rng.random() < .3:
            name = rng.choice(sorted(L.IDENTIFIERS))
            return name, f"({L.IDENTIFIERS[name]})", {name}
        parts = [build(depth - 1) for _ in range(rng.randint(2, 3))]
        op = rng.choice(["and", "or"])
        names = set().union(*(p[2] for p in parts))
        return "(" + f" {op.upper()} ".join(p[0] for p in parts) + ")", "(" + f" {op} ".join(p[1] for p in parts) + ")", names

    for _ in range(400):
        text, logic, names = build(rng.randint(1, 4))
        assert L.evaluate(text) == (names, eval(logic)), text
        flat = [build(0) for _ in range(4)]  # without brackets `and` binds closer
        ops = [rng.choice(["and", "or"]) for _ in range(3)]
        joined = lambda k: " ".join(x for a, b in zip(flat, ops + [""]) for x in (a[k], b))
        assert L.evaluate(joined(0)) == (set().union(*(p[2] for p in flat)), eval(joined(1).strip()))


def test_many_alternatives_stay_linear():
    names, free = L.evaluate(" AND ".join(["(MIT OR GPL-2.0)"] * 5000))
    assert names == {"mit", "gpl-2.0"} and free


@pytest.mark.parametrize("line,labels,free", [
    ("BSL-1.0 OR MIT", "bsl-1.0,mit", True), ("GPL-2.0 WITH Linux-syscall-note", "gpl-2.0,linux-syscall-note", None),
    ("BSL-1.0 AND GPL-3.0", "bsl-1.0,gpl-3.0", False), ("BSL-1.0 AND MIT", "bsl-1.0,mit", None), ("Beerware", "beerware", None),
    ("MIT.", "mit", True), ("Apache-2.0. See LICENSE", "apache-2.0", True), ("(MIT OR GPL-2.0-only) and some prose", "gpl-2.0,mit", True),
    ("GPL-2.0 with love from us", "gpl-2.0", False), ("MIT, as is", "mit", True), ("MIT (see LICENSE)", "mit", True),
    ("MIT/Apache-2.0", "apache-2.0,mit", True), ("GPL-3.0/MPL-2.0.", "gpl-3.0,mpl-2.0", False), ("MIT AND NOASSERTION", "mit", None), ("NONE OR GPL-2.0", "gpl-2.0", None),
])
def test_unknown_names_and_lines_that_go_on(line, labels, free):
    got = L.Scanner().scan(f"// SPDX-License-Identifier: {line}\ncode".encode())
    assert (got[5], got[6], got[7]) == (labels, free, 1.0)


@pytest.mark.parametrize("line", ["nothing known", "%s", "<license-id>", "see the file", "", "...", "MIT WITH GPL-2.0", "NONE", "NOASSERTION", "unknown", "NONE OR NOASSERTION"])
def test_lines_without_an_expression(line):
    assert L.Scanner().scan(f"// SPDX-License-Identifier: {line}\ncode".encode())[5:] == ("", None, 0.0)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["MIT", "license", "License", "apache", "general", "public", "é", "GNU", "version 3", "\n", "--", "MIT/License", "mit licenses", "GENERAL public-license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["code\n// SPDX-License-Identifier: MIT OR GPL-2.0\nmore", 'x {"license": "Apache-2.0", "a": 1}', "SPDX-License-Identifier: nothing known"]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = sorted((k, label) for p, label in L.BASE.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None), t
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
    assert got[150].labels == "gpl-2.0,mit" and got[150].permissive and got[150].score == 1
    assert got[151].labels == "apache-2.0" and got[152].labels == "" and got[152].score == 0


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    got = L.scan(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((i or 0, len(words(t))) for i, t in rows)
    assert L.scan(docs.limit(0)).collect() == []
