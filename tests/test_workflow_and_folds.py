"""Workflow replay, lockouts, idempotency: tiny cases and brute force."""
import datetime as dt


from ledgerlens.functions.columns import round1_ratio
from ledgerlens.operators import workflow as W
from ledgerlens.sources.fixtures import Fixtures

from conftest import SF


def test_workflow_case(spark):
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)],
                                "exception_id long, status string, version int, assigned_to string")
    acts = spark.createDataFrame([
        (1, 1, "assign", "a", "APPROVER", None, "u", None),
        (1, 2, "start", "u", "ANALYST", None, None, None),
        (1, 3, "resolve", "u", "ANALYST", 3, None, "fixed it"),
        (1, 4, "resolve", "u", "ANALYST", 3, None, "again!"),
        (1, 5, "approve", "a", "APPROVER", 4, None, None),
        (1, 6, "close", "a", "APPROVER", 5, None, None),
    ], "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, "
       "assign_to string, note string")
    state, outcomes = W.replay_workflow(exc, acts)
    s = state.collect()[0]
    assert (s.status, s.version, s.n_accepted) == ("CLOSED", 6, 5)
    rej = [tuple(r) for r in W.rejected_actions(outcomes).select("seq", "code").collect()]
    assert rej == [(4, "VERSION_CONFLICT")]


def test_auditor_and_short_note_rejected(spark):
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)],
                                "exception_id long, status string, version int, assigned_to string")
    acts = spark.createDataFrame([
        (1, 1, "assign", "x", "AUDITOR", None, "u", None),
        (1, 2, "assign", "a", "ADMIN", None, "u", None),
        (1, 3, "start", "v", "ANALYST", None, None, None),
        (1, 4, "resolve", "u", "ANALYST", 2, None, "ok"),
    ], "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, "
       "assign_to string, note string")
    _, outcomes = W.replay_workflow(exc, acts)
    codes = dict((r.seq, r.code) for r in outcomes.collect())
    assert codes == {1: "FORBIDDEN", 2: None, 3: "INVALID_STATE", 4: "VALIDATION"}


def test_kpi_rounding(spark):
    df = spark.createDataFrame([(4678, 1000), (9554, 100), (8819, 100), (9821, 100), (1, 0)], "p long, q long")
    got = [r[0] for r in df.select(round1_ratio("p", "q").cast("string")).collect()]
    assert got == ["4.7", "95.5", "88.2", "98.2", None]


def _lockout_python(events, n=5, minutes=15):
    out = {}
    for user in sorted({e[1] for e in events}):
        fails, until = 0, None
        for eid, _, ts, ok in sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0])):
            if until is not None and ts < until:
                out[eid] = "REFUSED"
                continue
            if ok:
                fails, until = 0, None
                out[eid] = "OK"
            elif fails + 1 >= n:
                fails, until = 0, ts + dt.timedelta(minutes=minutes)
                out[eid] = "LOCKED"
            else:
                fails, until = fails + 1, None
                out[eid] = "FAILED"
    return out


def test_lockout_matches_python(spark):
    fx = Fixtures(spark, SF)
    ev = [tuple(r) for r in fx.auth_events.collect()]
    got = {r.event_id: r.outcome for r in W.login_lockouts(fx.auth_events).collect()}
    assert got == _lockout_python(ev)


def test_dense_failures_lock(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "u", t0 + dt.timedelta(minutes=i), False) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, success boolean")
    got = [r.outcome for r in W.login_lockouts(df).orderBy("event_id").collect()]
    assert got == ["FAILED"] * 4 + ["LOCKED"] + ["REFUSED"] * 3


def test_dedupe_matches_python(spark):
    import hashlib
    fx = Fixtures(spark, SF)
    rows = fx.requests.collect()
    by_key = {}
    want = {}
    for r in rows:
        if not r.idempotency_key or r.method not in ("POST", "PATCH", "PUT"):
            want[r.request_id] = "BYPASS"
            continue
        h = hashlib.sha256(f"{r.user_id or 'anonymous'}:{r.method}:{r.path}:{r.idempotency_key}".encode()).hexdigest()
        by_key.setdefault(h, []).append(r)
    for rs in by_key.values():
        done, code = None, None
        for r in sorted(rs, key=lambda r: (r.ts, r.request_id)):
            if done is None or (code >= 500 and r.ts >= done):
                want[r.request_id] = "FIRST"
                done, code = r.finished_at, r.status_code
            elif r.ts < done:
                want[r.request_id] = "CONFLICT"
            else:
                want[r.request_id] = "REPLAYED"
    got = {r.request_id: r.outcome for r in W.dedupe_requests(fx.requests).collect()}
    assert got == want


def test_batch_registration_hashes(spark):
    import glob
    import hashlib
    import os

    from ledgerlens.sources import ingest as ING
    files = ING.read_files(spark, os.path.join(SF, "*.parquet"))
    got = {r.file_name: r.file_hash for r in files.collect()}
    want = {os.path.basename(p): hashlib.sha256(open(p, "rb").read()).hexdigest()
            for p in glob.glob(os.path.join(SF, "*.parquet"))}
    assert got == want
    manifest = spark.createDataFrame([(5, 4, want["orders.parquet"], "COMPLETED"),
                                      (6, 4, want["lineitem.parquet"], "FAILED"),
                                      (7, 3, want["region.parquet"], "COMPLETED")],
                                     "batch_id long, source_id int, file_hash string, status string")
    dec = {r.file_name: (r.decision, r.batch_id) for r in ING.register_batch(files, manifest, 4).collect()}
    assert dec["orders.parquet"] == ("DUPLICATE_IMPORT", 5)
    assert dec["lineitem.parquet"] == ("RETRY", 6)
    assert dec["region.parquet"][0] == "NEW"


def test_lockout_across_midnight_and_days(spark):
    d = dt.datetime(2024, 1, 1, 23, 50)
    rows = [(i, "u", d + dt.timedelta(minutes=i), False) for i in range(5)]            # lock at 23:54 -> 00:09
    rows += [(10, "u", dt.datetime(2024, 1, 2, 0, 1), False),                          # refused
             (11, "u", dt.datetime(2024, 1, 2, 0, 5), True),                           # refused (success while locked)
             (12, "u", dt.datetime(2024, 1, 2, 0, 10), False),                         # fails 1
             (13, "u", dt.datetime(2024, 1, 2, 9, 0), False),                          # fails 2
             (14, "u", dt.datetime(2024, 1, 3, 9, 0), False),                          # fails 3 (carried over days)
             (15, "u", dt.datetime(2024, 1, 5, 9, 0), False),                          # fails 4
             (16, "u", dt.datetime(2024, 1, 7, 23, 59), False),                        # 5th -> lock to 00:14
             (17, "u", dt.datetime(2024, 1, 8, 0, 13), True),                          # refused
             (18, "u", dt.datetime(2024, 1, 8, 0, 14), True)]                          # ok (lock over)
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, success boolean")
    got = {r.event_id: r.outcome for r in W.login_lockouts(df).collect()}
    assert got == _lockout_python(rows)
    assert got[10] == got[11] == got[17] == "REFUSED" and got[16] == "LOCKED" and got[18] == "OK"


def test_lockout_random_brute_force(spark):
    import random
    rnd = random.Random(5)
    rows, eid = [], 0
    for user in ("a", "b", "c"):
        t = dt.datetime(2024, 1, 1, 22, 0)
        for _ in range(300):
            t += dt.timedelta(minutes=rnd.choice([1, 2, 3, 7, 14, 16, 60, 300]))
            eid += 1
            rows.append((eid, user, t, rnd.random() < 0.15))
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, success boolean")
    got = {r.event_id: r.outcome for r in W.login_lockouts(df).collect()}
    assert got == _lockout_python(rows)


def test_strict_mode_checks_status(spark):
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)],
                                "exception_id long, status string, version int, assigned_to string")
    acts = spark.createDataFrame([
        (1, 1, "approve", "a", "ADMIN", 1, None, None),      # reference: accepted (version matches)
        (1, 2, "close", "a", "ADMIN", 2, None, None),
    ], "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, "
       "assign_to string, note string")
    _, lax = W.replay_workflow(exc, acts)
    assert [r.code for r in lax.orderBy("seq").collect()] == [None, None]
    _, strict = W.replay_workflow(exc, acts, strict=True)
    # the rejected approve leaves version 1, so the close is stale first
    assert [r.code for r in strict.orderBy("seq").collect()] == ["INVALID_STATE", "VERSION_CONFLICT"]


def test_rules_without_state_are_told_before_the_fold(spark):
    """The fold's step holds what depends on the state only, each code once."""
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)], "exception_id long, status string, version int, assigned_to string")
    rows = [(1, 1, "assign", "a", "ADMIN", None, "u", None), (1, 2, "assign", "a", "AUDITOR", None, "v", None), (1, 2, "start", "u", None, None, None, None),
            (1, 3, "start", "u", "ANALYST", None, None, None), (1, 4, "resolve", "u", "ANALYST", 3, None, "ok"), (1, 5, "resolve", "u", "ANALYST", 3, None, "long enough"),
            (1, 6, "assign", "a", "ADMIN", None, "w", None), (1, 7, "approve", "a", "ADMIN", 3, None, None), (1, 8, None, "a", "ADMIN", 4, None, None),
            (1, 9, "close", "a", "ADMIN", 4, None, None)]
    acts = spark.createDataFrame(rows, "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, assign_to string, note string")
    folded = W.fold_workflow(exc, acts)
    step = [x for x in folded._jdf.queryExecution().optimizedPlan().toString().splitlines() if "aggregate(" in x]
    assert step and not any("FORBIDDEN" in x for x in step) and all(x.count("VERSION_CONFLICT") == 1 for x in step)
    got = folded.first()
    assert [(o.seq, o.code, o.assigned_to) for o in got.out] == [
        (1, None, "u"), (2, "FORBIDDEN", "u"), (2, "FORBIDDEN", "u"), (3, None, "u"), (4, "VALIDATION", "u"), (5, None, "u"), (6, "INVALID_STATE", "u"),
        (7, "VERSION_CONFLICT", "u"), (8, "UNKNOWN_ACTION", "u"), (9, None, "u")]
    assert (got.status, got.version, got.assigned_to, got.accepted) == ("CLOSED", 5, "u", 4)


def test_read_log_starts_from_the_written_actions(spark):
    """Neither the action log nor the outcomes are unfolded again for it."""
    from ledgerlens import catalog as C
    plan = C.reads(C.Fixtures(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
