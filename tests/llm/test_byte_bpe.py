import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from tricky import documents

from ledgerlens.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(spark):
    docs, rows = documents(spark)
    encoded = B.encode(docs, PATH, P.PATTERN, keep=("doc_id", "text", "ids"))
    decoded = B.decode(encoded, PATH, keep=("doc_id", "text", "n_tokens", "ids", "ids_sha256")).collect()
    both = {(r.doc_id, tuple(r.ids)): r for r in B.round_trip(docs, PATH, P.PATTERN).collect()}
    for r in decoded:
        one = both[r.doc_id, tuple(r.ids)]
        assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (r.n_tokens, r.ids_sha256, hashlib.sha256(bytes(r.decoded)).hexdigest())
    enc, want = reference(), sorted((i or 0, t or "") for i, t in rows)
    assert sorted((r.doc_id or 0, r.text or "") for r in decoded) == want
    for r in decoded:
        ids = enc.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_random_texts_and_both_merge_paths():
    rng, v, enc = random.Random(5), B.Vocabulary(PATH), reference()
    letters = "ab c\n\t'st  éèßñ你好🎉\u0085 123#$%\x1c\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [" " * 4000, "a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(6000)), "<|endoftext|>", "  a b  c ", " a", "a ", "a \nb c\n d", "a\x1c b \u0085c", "it's 's 'll  's x"]
    find = regex.compile(P.PATTERN).findall
    got = B.encode_texts(texts, v, find, B.Cache())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]
    pieces = [p.encode() for p in {p for t in texts for p in find(t)} if 2 < len(p.encode()) <= 200]
    assert v.merge_rows(pieces) == [v.merge_long(p) for p in pieces]


def test_empty_table(spark):
    docs, _ = documents(spark)
    assert B.decode(B.encode(docs.limit(0), PATH, P.PATTERN), PATH).collect() == []
