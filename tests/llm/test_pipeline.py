"""The pipeline's stages against plain versions of what each must do."""
import base64
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from test_decontaminate import brute as hits
from test_jaccard_tree import brute as components
from test_secret_links import linked

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"]))
    columns, read = docs.columns, []
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        read.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns or name == C.STAGES[-1][0]
    text = lambda rows: sorted((r.doc_id or 0, r.text or "") for r in rows)
    # quality: drawn rows are unchanged
    before, after = read[0]
    assert 0.5 * len(before) < len(after) <= len(before) and set(text(after)) <= set(text(before))
    # near duplicates: the smallest id of each group
    before, after = read[1]
    before = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id))
    group = components([r.text for r in before], 5, 80)
    assert text(after) == text(r for i, r in enumerate(before) if before[group[i][1]].doc_id == r.doc_id)
    # decontamination: no hit
    before, after = read[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert text(after) == text(r for r, x in zip(before, hits([r.text for r in before], items)) if not x[1])
    # secrets: reported spans are marks, all else as before
    before, after = read[3]
    assert len(after) == len(before) and not any(linked(r.text) for r in after)
    assert text(after) == text(r.__class__(**r.asDict() | {"text": _marked(r.text)}) for r in before)
    assert all(r.n_chars == len(r.text) for r in after)
    # tokens
    before, after = read[4]
    with open(P.path(C.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(r.ids for r in after) == sorted(enc.encode_ordinary(r.text) for r in before)


def _marked(t):
    out, at = "", 0
    for s, _, e in linked(t):
        if s > at or not out:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_run_and_empty_tables(spark):
    assert C.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_names():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert not re.search("ledgerlens.catalog", open(C.__file__).read())
