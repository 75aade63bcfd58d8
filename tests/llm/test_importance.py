import math
import random

from pyspark.sql import functions as F
from tricky import documents

from ledgerlens.llm import importance as I


def test_held_out_labels(spark):
    """Models fitted on two thirds of the labelled good documents tell the rest from the poor ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    s = I.Sampler(docs, labels)
    got = s.selected().join(labels, "doc_id").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(I.HELD_OUT)) == 0)
    share = {(r.quality, r.toxic): r.s for r in got.filter("held or quality = 0 or toxic = 1").groupBy("quality", "toxic").agg(
        F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[1, 0] >= 0.98 and share[0, 0] <= 0.05 and share[0, 1] <= 0.05 and share[1, 1] <= 0.4
    assert s.keep().count() == s.k and s.keep().columns == docs.columns


def test_weights_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"Word{k}é" for k in range(10)] + ["a", "bb"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 100])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    s = I.Sampler(docs, labels, k=50)
    roles = {r.good: r.role for r in I._good(labels, "doc_id", 1000).collect()}

    def grams(w):
        b = [x.lower().encode() for x in w]
        return [[(x,), (4, x[:4]), (6, x[:6])] + ([(x, y)] if y is not None else []) for x, y in zip(b, [*b[1:], None])]

    raw, target = {}, {}
    for i, t in rows:
        for own in grams(t.split()):
            for g in own:
                raw[g] = raw.get(g, 0) + 1
                target[g] = target.get(g, 0) + (roles.get(i) == 1)
    share = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + I.PRIOR) / (n * share + I.PRIOR)) for g, n in raw.items()}

    def weight(t):
        v = [sum(ratio[g] for g in own) for own in grams(t.split())]
        if not v:
            return I.NO_WORDS
        n, p = len(v), I.PASSAGE
        parts = [sum(v[i:i + p]) for i in range(max(1, n - p + 1))]
        return min(min(parts), sum(v) * I.TEXT_PASSAGE / n if n > I.TEXT_PASSAGE else sum(v))

    got = s.selected().collect()
    assert all(abs(r.log_weight - weight(dict(rows)[r.doc_id])) < 1e-3 for r in got)
    top = sorted((r.noisy for r in got), reverse=True)[:50]
    assert sorted((r.noisy for r in got if r.selected), reverse=True) == top
    noise = [r.noisy - r.log_weight for r in got if r.log_weight > I.NO_WORDS]
    assert len(set(noise)) == len(noise) and abs(sum(noise) / len(noise) - 0.5772) < 0.4


def test_kth_largest(spark):
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1e6) for _ in range(500)], [rng.randint(0, 3) * 1.0 for _ in range(300)], [1e-300, -1e300, 5.0, 5.0, 7.0]):
        df = spark.createDataFrame([(v,) for v in values], "noisy double")
        for k in (1, 2, 4, len(values) - 1):
            assert I.kth_largest(df, k, bins=16) == sorted(values, reverse=True)[k - 1]
        assert I.kth_largest(df, len(values)) is None and I.kth_largest(df, 0) == float("inf")


def test_tricky_rows(spark):
    docs, rows = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, None, 0), (None, 1, 0), (6, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    s = I.Sampler(docs, labels)
    assert sorted(str(r.doc_id) for r in s.selected().collect()) == sorted(str(i) for i, _ in rows)
    assert s.keep().columns == docs.columns
    assert I.Sampler(docs, labels, k=3).keep().filter("length(trim(text)) = 0 or text is null").count() == 0
    assert I.Sampler(docs.limit(0), labels).selected().collect() == []
    assert I.Sampler(docs, labels.limit(0)).keep().count() == len(rows)
