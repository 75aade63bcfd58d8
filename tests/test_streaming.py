"""Structured Streaming twins: file sources over data derived from the
tables, memory / foreachBatch sinks, processAllAvailable."""
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.sources.fixtures import Fixtures
from ledgerlens.streaming import jobs as K

from conftest import SF


def _as_stream(spark, df, name):
    d = tempfile.mkdtemp(prefix=f"stream-{name}-", dir="/tmp")
    df.write.mode("overwrite").parquet(os.path.join(d, "data"))
    return spark.readStream.schema(df.schema).parquet(os.path.join(d, "data"))


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_break_counts_equal_batch(spark):
    fx = Fixtures(spark, SF)
    exc = fx.exceptions.select("exception_id", "exception_type", "created_at")
    out = _drain(K.stream_break_counts(_as_stream(spark, exc, "exc")), "k4")
    # append mode emits windows closed by the watermark; the last day stays open
    batch = (exc.groupBy(F.to_date("created_at").alias("d"), "exception_type").count())
    got = {(r.window_start.date(), r.exception_type): r.cnt for r in out.collect()}
    want = {(r.d, r.exception_type): r["count"] for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_stream_dedupe(spark):
    fx = Fixtures(spark, SF)
    req = fx.requests.select("request_id", "user_id", "method", "path", "idempotency_key", "ts")
    out = _drain(K.stream_dedupe(_as_stream(spark, req, "req")), "k3")
    from ledgerlens.operators.workflow import guarded
    kept = req.filter(guarded(req))
    assert out.count() == (kept.select("user_id", "method", "path", "idempotency_key").distinct().count()
                           + req.filter(~guarded(req)).count())


def test_stream_exact_candidates(spark):
    fx = Fixtures(spark, SF)
    from ledgerlens.operators import matching as M
    led = M.ledger_side(fx.ledger, fx.accounts).limit(300)
    ext = M.external_side(fx.external, fx.accounts)
    out = _drain(K.stream_exact_candidates(_as_stream(spark, led, "l"), _as_stream(spark, ext, "e")), "k2")
    assert out.filter(F.col("ext_line_id").isNotNull()).count() > 0


def test_stream_workflow_state(spark):
    fx = Fixtures(spark, SF)
    acts = fx.actions.join(fx.exceptions.select("exception_id", "sla_deadline"), "exception_id")
    out = _drain(K.stream_workflow_state(_as_stream(spark, acts, "acts")), "k5")
    from ledgerlens.operators import workflow as W
    _, outcomes = W.replay_workflow(fx.fresh_exceptions, fx.actions)
    batch = {(r.exception_id, r.seq): r.code for r in outcomes.collect()}
    stream = {(r.exception_id, r.seq): r.code for r in out.filter(F.col("event") == "ACTION").collect()}
    assert stream == batch


def test_stream_ingest(spark, tmp_path):
    """Files of one stream: shuffled header, a reference published before, a repeated file, a bad header."""
    from ledgerlens.sources.imports import StatementStore
    acc = spark.createDataFrame([("ACC-1",)], "external_ref string")
    sources = spark.createDataFrame([(4, "CSV")], "source_id int, file_format string")
    head = "external_ref,account_ref,amount,currency,value_date\n"
    folder = tmp_path / "in"
    folder.mkdir()
    store = StatementStore(spark, str(tmp_path / "store"))

    def arrive(name, text):
        (folder / name).write_text(text)
        q = K.stream_ingest(spark, str(folder), store, acc, sources, checkpoint=str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()

    arrive("a.csv", "account_ref,value_date,external_ref,currency,amount\nACC-1,2024-01-01,Z1,GBP,1.00\n")
    arrive("b.csv", head + "Z1,ACC-1,2.00,GBP,2024-01-02\n")
    arrive("c.csv", "account_ref,value_date,external_ref,currency,amount\nACC-1,2024-01-01,Z1,GBP,1.00\n")
    arrive("d.csv", "external_ref,amount\nZ2,1\n")
    arrive("e.csv", head + "Z3,ACC-1,3.00,GBP,2024-01-03\n")
    assert [r.external_ref for r in store.lines().orderBy("external_ref").collect()] == ["Z1", "Z3"]
    assert {r.file_name: (r.status, r.error) for r in store.batches().collect()} == {
        "a.csv": ("COMPLETED", None), "b.csv": ("FAILED", "ALREADY_COMMITTED"), "d.csv": ("FAILED", "CSV_HEADER_ERROR"),
        "e.csv": ("COMPLETED", None)}


def test_workflow_sla_timer_fires(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        # exception 1: assigned, never closed, deadline at +2h -> breached
        (1, 1, "assign", "a", "ADMIN", None, "u", None, t0, t0 + dt.timedelta(hours=2)),
        # exception 2: closed before the deadline -> no breach
        (2, 1, "assign", "a", "ADMIN", None, "u", None, t0, t0 + dt.timedelta(hours=2)),
        (2, 2, "close", "a", "ADMIN", 2, None, None, t0 + dt.timedelta(minutes=5), t0 + dt.timedelta(hours=2)),
        # a later event of another exception moves the watermark past both deadlines
        (3, 1, "assign", "a", "ADMIN", None, "u", None, t0 + dt.timedelta(days=1), t0 + dt.timedelta(days=5)),
    ]
    schema = ("exception_id long, seq long, action string, actor string, actor_role string, expected_version int, "
              "assign_to string, note string, acted_at timestamp, sla_deadline timestamp")
    src = spark.createDataFrame(rows, schema)
    out = _drain(K.stream_workflow_state(_as_stream(spark, src, "sla"), watermark="1 hour"), "k5sla")
    breached = {r.exception_id for r in out.filter(F.col("event") == "SLA_BREACHED").collect()}
    assert breached == {1}


def test_stream_rate_limit(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u1", t0 + dt.timedelta(seconds=i)) for i in range(12)] + [("u2", t0)] + \
           [("u1", t0 + dt.timedelta(days=1))]
    src = spark.createDataFrame(rows, "user_id string, ts timestamp")
    out = _drain(K.stream_rate_limit(_as_stream(spark, src, "rl"), "user_id", "ts", 15, 10), "k4rl")
    assert [(r.client, r.requests) for r in out.collect()] == [("u1", 12)]


def test_stream_reconcile_closed_dates(spark):
    """Micro-batch reconciliation equals J1 runs of the same dates in
    sequence, and every closed ledger row ends matched or as an exception."""
    import datetime as dt

    from ledgerlens.config import MatchConfig
    from ledgerlens.plans.reconcile import reconcile
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    lo, hi = dt.date(1996, 3, 1), dt.date(1996, 3, 8)
    led = fx.ledger.filter(F.col("value_date").between(lo, hi))
    ext = fx.external.filter(F.col("value_date").between(lo, hi + dt.timedelta(days=3)))
    base = tempfile.mkdtemp(prefix="srecon-", dir="/tmp")
    # two arrivals per side, each one file, in date order (the lateness bound holds)
    for name, df in (("led", led), ("ext", ext)):
        df.filter(F.col("value_date") < dt.date(1996, 3, 5)).coalesce(1).write.parquet(os.path.join(base, name, "a"))
        df.filter(F.col("value_date") >= dt.date(1996, 3, 5)).coalesce(1).write.parquet(os.path.join(base, name, "b"))
    ls = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "led", "*"))
    es = spark.readStream.schema(ext.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "ext", "*"))
    out = os.path.join(base, "out")
    q = K.stream_reconcile(spark, ls, es, fx.accounts, fx.rules, out, lateness_days=3)
    q.processAllAvailable()
    q.stop()
    closed = sorted(r[0] for r in spark.read.parquet(os.path.join(out, "closed_dates")).collect())
    # the horizon is the latest staged date (either side) minus the lateness
    top = max(r[0] for r in ext.select(F.max("value_date")).collect() + led.select(F.max("value_date")).collect())
    assert closed and closed[-1] <= top - dt.timedelta(days=3)
    got = {(r.match_id, r.ledger_txn_id) for r in spark.read.parquet(os.path.join(out, "ledger_lines")).collect()}

    # batch: the same J1 runs in date order
    want, lb, eb, px = set(), None, None, None
    for d in closed:
        r = reconcile(led, ext, fx.accounts, fx.rules, MatchConfig(run_date=d), lb, eb, px)
        rows = {(x.match_id, x.ledger_txn_id) for x in r.ledger_lines.collect()}
        want |= rows
        lb = spark.createDataFrame([(i,) for _, i in want] or [], "ledger_txn_id long")
        eb = spark.createDataFrame([(m,) for m, _ in want] or [], "ext_line_id long")
        new_px = r.exceptions.select("ledger_txn_id", "ext_line_id")
        px = new_px if px is None else px.unionByName(new_px)
        px = spark.createDataFrame(px.collect(), "ledger_txn_id long, ext_line_id long")
    assert got == want
    exc = spark.read.parquet(os.path.join(out, "exceptions"))
    closed_led = led.filter(F.col("value_date").isin(closed)).select("ledger_txn_id")
    covered = ({i for _, i in got} | {r.ledger_txn_id for r in exc.filter(F.col("ledger_txn_id").isNotNull())
                                      .collect()})
    assert {r.ledger_txn_id for r in closed_led.collect()} <= covered
    assert len({i for _, i in got}) == len([i for _, i in got])


def test_missed_heartbeats(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [  # job 1 beats every 10 s then goes silent while RUNNING -> stalled, retried
        (1, t0 + dt.timedelta(seconds=s), "RUNNING", 1, 3) for s in (0, 10, 20)] + [
        # job 2 beats then completes -> no stall
        (2, t0, "RUNNING", 0, 3), (2, t0 + dt.timedelta(seconds=10), "COMPLETED", 0, 3),
        # job 3 stalls on its last attempt -> dead letter
        (3, t0, "RUNNING", 3, 3),
        # a late beat of another job pushes the watermark past every session
        (9, t0 + dt.timedelta(minutes=10), "RUNNING", 0, 3)]
    src = spark.createDataFrame(rows, "job_id long, ts timestamp, status string, attempts int, max_attempts int")
    out = _drain(K.stream_missed_heartbeats(_as_stream(spark, src, "hb")), "k5hb")
    got = {r.job_id: (r.disposition, r.stalled_at, r.next_run_at) for r in out.collect()}
    assert got[1] == ("RETRYING", t0 + dt.timedelta(seconds=50), t0 + dt.timedelta(seconds=70))
    assert got[3][0] == "DEAD_LETTER" and got[3][2] is None
    assert 2 not in got


def test_workflow_stream_calls_python_once_a_bucket(spark, tmp_path):
    """Exceptions share few groups, and rows that come in several parts, latest first, are replayed in their order."""
    import datetime as dt
    from ledgerlens.operators import workflow as W
    t = dt.datetime(2024, 1, 1)
    steps = [("assign", "a", "ADMIN", None, "u"), ("start", "u", "ANALYST", None, None), ("resolve", "u", "ANALYST", 3, None),
             ("approve", "a", "ADMIN", 4, None), ("close", "a", "ADMIN", 5, None)]
    rows = [(i, seq + 1, act, actor, role, version, to, "long enough", t + dt.timedelta(minutes=seq), t + dt.timedelta(hours=1 if i % 7 else 9))
            for seq, (act, actor, role, version, to) in reversed(list(enumerate(steps))) for i in range(200) if seq < i % 6]
    rows.append((1000, 1, "assign", "a", "ADMIN", None, "u", None, t + dt.timedelta(hours=6), None))
    schema = ("exception_id long, seq long, action string, actor string, actor_role string, expected_version int, assign_to string, note string, "
              "acted_at timestamp, sla_deadline timestamp")
    acts = spark.createDataFrame(rows, schema)
    acts.coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = K.stream_workflow_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=5)
        q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators) <= 5
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    fresh = acts.select("exception_id", F.lit("UNASSIGNED").alias("status"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("assigned_to")).distinct()
    want = {(r.exception_id, r.seq): r.code for r in W.replay_workflow(fresh, acts)[1].collect()}
    assert {(r.exception_id, r.seq): r.code for r in got if r.event == "ACTION"} == want and len(want) == len(rows)
    told = [r.exception_id for r in got if r.event == "SLA_BREACHED"]
    # a deadline at one hour, and fewer than four steps (not approved)
    assert sorted(told) == [i for i in range(200) if 0 < i % 6 < 4 and i % 7]


def test_run_dates_exclude_only_ids_they_can_meet(spark, monkeypatch, tmp_path):
    """Dates far apart share flagged lines and repeated ids only: the results are those of whole bridges, and ids that no later date can meet aren't handed on."""
    import datetime as dt
    from ledgerlens.config import MatchConfig
    from ledgerlens.plans import reconcile as P
    from ledgerlens.sources import tables as T
    days = [dt.date(2024, 3, 1), dt.date(2024, 3, 3), dt.date(2024, 4, 20)]
    acc = spark.createDataFrame([(i, f"A{i}") for i in range(1, 4)], "account_id long, external_ref string")
    led, ext = [], []
    for k, d in enumerate(days):
        for i in range(6):
            led.append((100 * k + i, 1 + i % 3, "EUR", f"{50 + 10 * i}.00", d))
            if i < 4:  # the next date's window reaches the first one's lines
                ext.append((1000 + 100 * k + i, f"A{1 + i % 3}", "EUR", f"{50 + 10 * i}.00", d + dt.timedelta(days=i % 2), False))
    led += [(1, 2, "EUR", "60.00", days[2]), (7777, 3, "EUR", "33.00", days[0]), (7777, 3, "EUR", "33.00", days[2])]  # ids that come twice
    ext += [(1000, "A1", "EUR", "50.00", days[2], False), (5000, "A2", "EUR", "90.00", days[2], True), (5001, "A3", "EUR", "33.00", days[2], True)]
    led = spark.createDataFrame(led, "ledger_txn_id long, account_id long, currency string, amount string, value_date date") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)")).selectExpr("*", "'r' AS txn_ref", "'DEBIT' AS txn_type", "cast(null AS long) AS batch_id")
    ext = spark.createDataFrame(ext, "ext_line_id long, account_ref string, currency string, amount string, value_date date, is_batched_settlement boolean") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)")).selectExpr("*", "cast(null AS long) AS batch_id")
    staging, out, rules = str(tmp_path / "staging"), str(tmp_path / "out"), T.match_rules(spark)
    K._stage_ledger(led).unionByName(K._stage_external(ext)).write.partitionBy("side", "is_batched_settlement", "value_date").parquet(staging)
    handed, run = [], P.reconcile

    def watched(*args, **kw):
        handed.append({k: sorted(r[0] for r in kw[k].collect()) if kw[k] is not None else [] for k in ("ledger_bridge", "ext_bridge")})
        return run(*args, **kw)

    monkeypatch.setattr(P, "reconcile", watched)
    assert K.reconcile_closed_dates(spark, staging, out, acc, rules, 0) == days
    got = {part: sorted(tuple(r) for r in spark.read.parquet(f"{out}/{part}").drop("run_date").collect()) for part in ("ledger_lines", "external_lines")}
    exc = sorted(r.exception_id for r in spark.read.parquet(f"{out}/exceptions").collect())

    lb, eb, px, want_exc = [], [], [], []
    e = ext.selectExpr("*", "cast(null AS int) AS source_id", "cast(null AS string) AS external_ref", "value_date AS settlement_date")
    for d in days:
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        r = run(led, e, acc, rules, MatchConfig(run_date=d), frame([(i,) for _, i in lb], "ledger_txn_id long"), frame([(i,) for _, i in eb], "ext_line_id long"),
                frame(px, "ledger_txn_id long, ext_line_id long"))
        lb, eb = lb + [tuple(x) for x in r.ledger_lines.collect()], eb + [tuple(x) for x in r.external_lines.collect()]
        new = r.exceptions.collect()
        px, want_exc = px + [(x.ledger_txn_id, x.ext_line_id) for x in new], want_exc + [x.exception_id for x in new]
    assert got == {"ledger_lines": sorted(lb), "external_lines": sorted(eb)} and exc == sorted(want_exc)
    assert {k for k, _ in lb} & {5000, 5001} and len(lb) > 8
    # the last date: no ledger ids but repeated ones, no lines but flagged and repeated ones
    assert set(handed[2]["ledger_bridge"]) <= {1, 7777} and set(handed[2]["ext_bridge"]) <= {1000, 5000, 5001}
