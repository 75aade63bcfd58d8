"""J5 over long histories: equal to the fold and to a plain loop, cut into pieces."""
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import workflow as W
from ledgerlens.operators.long_replay import long_replay

EXC = "exception_id long, status string, version int, assigned_to string"
ACTS = "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, assign_to string, note string"
KNOWN = ["assign", "start", "resolve", "approve", "close"]


def _history(rng, i, n):
    """Actions that are often right, so that all statuses are reached."""
    version, out = rng.choice([1, 1, 2]), []
    for seq in range(n):
        act = rng.choice(KNOWN if rng.random() < 0.7 else ["assign", "start", None, "reopen"])
        role = rng.choice(["ADMIN", "APPROVER", "ANALYST", "ANALYST", "AUDITOR", None])
        version += rng.random() < 0.4
        out.append((i, seq if rng.random() < 0.9 else seq + 1, act, rng.choice(["u", "v", None]), role, rng.choice([version, version - 1, version + 1, None]),
                    rng.choice(["u", "v", None]), rng.choice(["long enough", "long enough", "no", None])))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_fold(spark, strict):
    rng = random.Random(7)
    exc = [(i, rng.choice(["UNASSIGNED", "UNASSIGNED", "ASSIGNED", "IN_PROGRESS", "RESOLVED", "APPROVED", "CLOSED", None]), rng.choice([1, 1, 2, None]),
            rng.choice(["u", "v", None])) for i in range(60)]
    acts = [a for i, *_ in exc if i % 9 for a in _history(rng, i, rng.randint(1, 40))]
    acts += acts[:20] + [(999, 1, "assign", "a", "ADMIN", None, "u", None)]
    e, a = spark.createDataFrame(exc, EXC), spark.createDataFrame(acts, ACTS).repartition(3)
    want = W.fold_views(W.fold_workflow(e, a, strict))
    got = long_replay(e, a, strict, least=5)
    for g, w in zip(got, want):
        assert sorted(map(str, g.collect())) == sorted(map(str, w.select(*g.columns).collect()))
    mixed = W.replay_workflow(e, a, strict, longest=15)
    for g, w in zip(mixed, want):
        assert sorted(map(str, g.collect())) == sorted(map(str, w.select(*g.columns).collect()))
    nothing = long_replay(e.limit(0), a, strict)
    assert nothing[0].collect() == nothing[1].collect() == []


def test_one_exception_with_many_actions(spark):
    n = 30_000
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)], EXC)
    i = F.col("id")
    # every third action expects the version that is right by then, the others are stale
    acts = spark.range(n).select(F.lit(1).cast("long").alias("exception_id"), i.alias("seq"), F.when(i == 0, "assign").otherwise("resolve").alias("action"),
                                 F.lit("u").alias("actor"), F.lit("ADMIN").alias("actor_role"),
                                 F.when(i % 3 == 1, F.floor(i / 3) + 2).otherwise(1).cast("int").alias("expected_version"),
                                 F.lit("u").alias("assign_to"), F.lit("long enough").alias("note"))
    state, outcomes = W.replay_workflow(exc, acts)
    assert tuple(state.first()) == (1, "RESOLVED", 1 + 1 + n // 3, "u", 1 + n // 3, n - 1 - n // 3)
    assert outcomes.filter("code IS NULL AND seq % 3 = 1").count() == n // 3
