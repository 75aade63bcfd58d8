"""Hand-written uploads, the import chain, NULL-safe rules, late stream actions, skew and growth of the matching passes."""
import contextlib
import datetime as dt
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens import schemas as S
from ledgerlens.operators import chains as CH
from ledgerlens.operators import classify as CL
from ledgerlens.operators import matching as M
from ledgerlens.operators import queues as Q
from ledgerlens.operators import running as R
from ledgerlens.operators import validation as V
from ledgerlens.operators import workflow as W
from ledgerlens.session import create_file, materialize, with_dense_ids
from ledgerlens.sources import csv as CSV
from ledgerlens.sources import ingest as ING
from ledgerlens.sources.fixtures import Fixtures
from ledgerlens.sources.imports import ImportRefused, StatementStore
from ledgerlens.streaming import jobs as K

HEAD = "external_ref,account_ref,amount,currency,value_date,settlement_date,is_batched_settlement\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_quotes_line_breaks_marks_and_ragged_rows(spark, tmp_path):
    p = write(tmp_path, "a.csv", "﻿" + HEAD + '"E ""q"", 1",ACC-1,1.00,GBP,2024-01-01,,true\n\n"E\n2",ACC-1,2.00,GBP,2024-01-02,,\n')
    raw = CSV.read_statement(spark, p)
    assert sorted((r.external_ref, r.amount, r.is_malformed) for r in raw.collect()) == [("E\n2", "2.00", False), ('E "q", 1', "1.00", False)]
    p = write(tmp_path, "b.csv", HEAD + "E1,ACC-1,1.00,GBP,2024-01-01,,,more\nE2,ACC-1,1.00\nE3,ACC-1,1.00,GBP,2024-01-01,,\n")
    raw = CSV.read_statement(spark, p)
    assert {r.external_ref: r.is_malformed for r in raw.collect()} == {"E1": True, "E2": True, "E3": False}
    acc = spark.createDataFrame([("ACC-1",)], "external_ref string")
    found = {r.rule: r.n_rows for r in V.validate_statement(raw, acc, acc.limit(0)).collect()}
    assert found["CAST_ERROR"] == 2


def test_each_file_has_its_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "E1,ACC-1,1.00,GBP,2024-01-01,,\n")
    write(tmp_path, "b.csv", " VALUE_DATE ,Account_Ref,external_ref,currency,amount\n2024-01-02,ACC-2,E2,USD,2.00\n")
    got = {r.external_ref: (r.account_ref, r.amount, r.value_date) for r in CSV.read_statement(spark, str(tmp_path)).collect()}
    assert got == {"E1": ("ACC-1", "1.00", "2024-01-01"), "E2": ("ACC-2", "2.00", "2024-01-02")}


def test_import_chain(spark, tmp_path):
    acc = spark.createDataFrame([(1, "ACC-1")], "account_id long, external_ref string")
    sources = spark.createDataFrame([(1, "DATABASE"), (4, "CSV")], "source_id int, file_format string")
    store = StatementStore(spark, str(tmp_path / "store"))
    good = write(tmp_path, "good.csv", HEAD + "E1,ACC-1,1.00,gbp,2024-01-01,,\nE2,ACC-1,2.00,GBP,2024-01-01,,\n")

    def refused(path, source=4):
        with pytest.raises(ImportRefused) as e:
            store.import_statement(path, source, acc, sources)
        return e.value.code

    assert store.lines() is None and refused(good, 1) == "INVALID_IMPORT_SOURCE" and store.batches().count() == 0
    bad = write(tmp_path, "bad.csv", HEAD + "E3,ACC-1,-1.00,GBP,2024-01-01,,\n")
    assert refused(bad) == "AMOUNT_NOT_POSITIVE"
    assert store.import_statement(good, 4, acc, sources) == 2
    assert refused(good) == "DUPLICATE_IMPORT"
    assert refused(write(tmp_path, "again.csv", HEAD + "E1,ACC-1,5.00,GBP,2024-01-01,,\n")) == "ALREADY_COMMITTED"
    assert refused(write(tmp_path, "short.csv", "external_ref,amount\nE9,1\n")) == "CSV_HEADER_ERROR"
    assert refused(write(tmp_path, "empty.csv", HEAD)) == "EMPTY_FILE"
    # a failed batch is tried again under its own id, here with an account that is known by now
    later = write(tmp_path, "later.csv", HEAD + "E7,ACC-2,1.00,GBP,2024-01-01,,\n")
    assert refused(later) == "ACCOUNT_NOT_FOUND"
    more = acc.unionByName(spark.createDataFrame([(2, "ACC-2")], acc.schema))
    assert store.import_statement(later, 4, more, sources) == 6
    assert {r.batch_id: (r.status, r.row_count) for r in store.batches().collect()} == {
        1: ("FAILED", None), 2: ("COMPLETED", 2), 3: ("FAILED", None), 4: ("FAILED", None), 5: ("FAILED", None), 6: ("COMPLETED", 1)}
    lines = store.lines().orderBy("ext_line_id").collect()
    assert [(r.external_ref, r.ext_line_id, r.currency) for r in lines] == [
        ("E1", 2 * CSV.BATCH_ROWS + 1, "GBP"), ("E2", 2 * CSV.BATCH_ROWS + 2, "GBP"), ("E7", 6 * CSV.BATCH_ROWS + 1, "GBP")]
    # published ids can be reconciled
    led = spark.createDataFrame([(10, 1, 1.0, "GBP", dt.date(2024, 1, 1)), (11, 1, 9.0, "GBP", dt.date(2024, 1, 1))],
                                "ledger_txn_id long, account_id long, amount double, currency string, value_date date") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    from ledgerlens.plans.reconcile import reconcile
    r = reconcile(led, store.lines(), more, None)
    assert [(x.ledger_txn_id, x.ext_line_id) for x in r.exact.collect()] == [(10, 2 * CSV.BATCH_ROWS + 1)]
    assert r.exceptions.select("exception_id").distinct().count() == 3


def store_of(spark, tmp_path):
    acc = spark.createDataFrame([(1, "ACC-1")], "account_id long, external_ref string")
    sources = spark.createDataFrame([(4, "CSV")], "source_id int, file_format string")
    return StatementStore(spark, str(tmp_path / "store")), acc, sources


def test_any_error_fails_the_batch_and_a_retry_gets_its_id(spark, tmp_path, monkeypatch):
    store, acc, sources = store_of(spark, tmp_path)
    good = write(tmp_path, "good.csv", HEAD + "E1,ACC-1,1.00,GBP,2024-01-01,,\n")
    with monkeypatch.context() as m:
        m.setattr(CSV, "type_statement", lambda raw: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.import_statement(good, 4, acc, sources)
    assert [(r.batch_id, r.status, r.error) for r in store.batches().collect()] == [(1, "FAILED", "division by zero")]
    assert store.import_statement(good, 4, acc, sources) == 1 and store.lines().count() == 1
    twice = write(tmp_path, "twice.csv", HEAD.strip() + ",Amount \nE2,ACC-1,1.00,GBP,2024-01-01,,,2\n")
    with pytest.raises(ImportRefused) as e:
        store.import_statement(twice, 4, acc, sources)
    assert e.value.code == "CSV_HEADER_ERROR" and "amount" in str(e.value)
    assert {r.batch_id: r.status for r in store.batches().collect()} == {1: "COMPLETED", 2: "FAILED"}


def test_imports_at_the_same_time_get_different_ids(spark, tmp_path):
    store, acc, sources = store_of(spark, tmp_path)
    paths = [write(tmp_path, f"f{k}.csv", HEAD + f"E{k},ACC-1,1.00,GBP,2024-01-01,,\n") for k in range(4)]
    other = StatementStore(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda x: x[0].import_statement(x[1], 4, acc, sources), zip([store, other] * 2, paths)))
    assert sorted(ids) == [1, 2, 3, 4] and store.log().count() == 8
    assert {r.external_ref for r in store.lines().collect()} == {f"E{k}" for k in range(4)}
    assert create_file(spark, str(tmp_path / "one"), "a") and not create_file(spark, str(tmp_path / "one"), "b")
    assert (tmp_path / "one").read_text() == "a"


def test_every_file_of_an_upload_needs_its_columns(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "E1,ACC-1,1.00,GBP,2024-01-01,,\n")
    write(tmp_path, "b.csv", "external_ref,account_ref,currency,value_date\nE2,ACC-1,GBP,2024-01-01\n")
    with pytest.raises(CSV.CsvHeaderError):
        CSV.read_statement(spark, str(tmp_path))


def test_a_batch_beyond_its_ids_is_refused(spark, tmp_path, monkeypatch):
    store, acc, sources = store_of(spark, tmp_path)
    monkeypatch.setattr(CSV, "BATCH_ROWS", 4)
    rows = lambda n, lo: HEAD + "".join(f"E{lo + k},ACC-1,1.00,GBP,2024-01-01,,\n" for k in range(n))
    with pytest.raises(ImportRefused) as e:
        store.import_statement(write(tmp_path, "six.csv", rows(6, 0)), 4, acc, sources)
    assert e.value.code == "BATCH_TOO_LARGE"
    assert store.import_statement(write(tmp_path, "three.csv", rows(3, 10)), 4, acc, sources) == 2
    assert sorted(r.ext_line_id for r in store.lines().collect()) == [9, 10, 11]
    with pytest.raises(CSV.BatchTooLarge):
        CSV.publish_statement(CSV.type_statement(CSV.read_statement(spark, str(tmp_path / "three.csv"))), CSV.BATCH_IDS, 4)


def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path):
    """As many tasks as splits, and the rows of an unsplit reading."""
    rng = random.Random(2)
    words = ["plain", 'say ""so""', "two\nlines", "a\n\n\nb", "x" * 90, "many" + "\n" * 40 + "lines", ", comma", ""]
    rows = [(f"E{k}", rng.choice(words)) for k in range(400)]
    text = HEAD + "".join(f'{r},"{w}",1.00,GBP,2024-01-01,,\n' + rng.choice(["", "", "\n"]) for r, w in rows)
    path = write(tmp_path, "quoted.csv", text)
    write(tmp_path, "other.csv", HEAD + 'Z1,"q\nr",2.00,GBP,2024-01-01,,\nZ2,"open')
    with settings(spark, files__maxPartitionBytes="1000", files__openCostInBytes="1"):
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = {r.external_ref: r.account_ref for r in CSV.read_statement(spark, path).collect()}
        both = CSV.read_statement(spark, str(tmp_path)).collect()
    import csv as plain
    want = {r[0]: r[1].strip() or None for r in list(plain.reader(open(path, newline="")))[1:] if r}
    assert got == want and len(got) == 400
    assert len(both) == 402 and {r.external_ref: r.account_ref for r in both}["Z1"] == "q\nr"


def test_equal_files_in_one_call(spark):
    files = spark.createDataFrame([("b", "b", "h1"), ("a", "a", "h1"), ("c", "c", "h2"), ("d", "d", "h3")], "path string, file_name string, file_hash string")
    manifest = spark.createDataFrame([(7, 4, "h3", "FAILED")], "batch_id long, source_id int, file_hash string, status string")
    got = {r.path: (r.decision, r.batch_id) for r in ING.register_batch(files, manifest, 4).collect()}
    assert got == {"a": ("NEW", 8), "b": ("DUPLICATE_IMPORT", 8), "c": ("NEW", 9), "d": ("RETRY", 7)}


def test_large_files_have_the_same_hash(spark, tmp_path, monkeypatch):
    write(tmp_path, "x.bin", "hello" * 1000)
    whole = ING.read_files(spark, str(tmp_path)).collect()
    monkeypatch.setattr(ING, "ROW_BYTES", 10)
    assert ING.read_files(spark, str(tmp_path)).collect() == whole


def test_dense_ids(spark):
    df = spark.createDataFrame([(k * 7 % 101, str(k)) for k in range(100)] + [(None, "n")], "a long, b string").repartition(5)
    got = [(r.a, r.i) for r in with_dense_ids(df, ["a", "b"], "i", 1000).orderBy("i").collect()]
    assert [i for _, i in got] == list(range(1001, 1102)) and [a for a, _ in got] == [None] + sorted(a for a, _ in got[1:])


def test_refused_without_a_batch(spark):
    fx = Fixtures(spark, SF)
    assert Q.require_batch(fx.batches, fx.sources, fx.external) > 0
    with pytest.raises(Q.NoSettlementBatch):
        Q.require_batch(fx.batches, fx.sources, fx.external.limit(0))
    with pytest.raises(Q.NoSettlementBatch):
        Q.require_batch(fx.batches, fx.sources, fx.external, -1)


def test_missing_roles_and_versions_are_refused(spark):
    exc = spark.createDataFrame([(1, "UNASSIGNED", 1, None)], "exception_id long, status string, version int, assigned_to string")
    rows = [(1, 1, "assign", "x", None, None, "u", None), (1, 2, "assign", "x", "ADMIN", None, "u", None), (1, 3, "start", "u", None, None, None, None),
            (1, 4, "start", "u", "ANALYST", None, None, None), (1, 5, "resolve", "u", "ANALYST", None, None, "long enough"),
            (1, 6, "resolve", "u", "ANALYST", 3, None, "long enough"), (1, 7, "approve", "x", "ADMIN", None, None, None)]
    acts = spark.createDataFrame(rows, "exception_id long, seq long, action string, actor string, actor_role string, expected_version int, "
                                       "assign_to string, note string")
    state, outcomes = W.replay_workflow(exc, acts)
    assert {r.seq: r.code for r in outcomes.collect()} == {1: "FORBIDDEN", 2: None, 3: "FORBIDDEN", 4: None, 5: "VERSION_CONFLICT", 6: None,
                                                            7: "VERSION_CONFLICT"}
    assert state.first().status == "RESOLVED"


def test_requests_without_a_key_pass(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "u", "GET", "/a", None, t, t, 200), (2, "u", "GET", "/a", None, t, t, 200), (3, "u", "POST", "/a", "", t, t, 200),
            (4, "u", "POST", "/a", "k", t, t + dt.timedelta(seconds=5), 500), (5, "u", "POST", "/a", "k", t + dt.timedelta(seconds=1), t, 200),
            (6, "u", "POST", "/a", "k", t + dt.timedelta(seconds=5), None, None), (7, "u", "POST", "/a", "k", t + dt.timedelta(days=1), t, 200),
            (8, None, "PUT", "/a", "k", t, t, 201), (9, None, "PUT", "/a", "k", t, t, 201)]
    log = spark.createDataFrame(rows, "request_id long, user_id string, method string, path string, idempotency_key string, ts timestamp, "
                                      "finished_at timestamp, status_code int")
    got = {r.request_id: r.outcome for r in W.dedupe_requests(log).collect()}
    assert got == {1: "BYPASS", 2: "BYPASS", 3: "BYPASS", 4: "FIRST", 5: "CONFLICT", 6: "FIRST", 7: "CONFLICT", 8: "FIRST", 9: "REPLAYED"}


def test_page_of_500_and_bad_pages(spark):
    fx = Fixtures(spark, SF)
    assert Q.list_exceptions(fx.exceptions, fx.ledger, fx.external, fx.users, fx.as_of, page_size=500).count() == 500
    with pytest.raises(ValueError):
        Q.list_exceptions(fx.exceptions, fx.ledger, fx.external, fx.users, fx.as_of, page_size=0)


def test_long_chains_and_cycles(spark):
    led = spark.createDataFrame([(k,) for k in range(60)], "ledger_txn_id long")
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(50, 51), (51, 50), (50, 5)], "child_txn_id long, parent_txn_id long")
    full = CH.reversal_chains(led, links).collect()
    assert [(r.root_txn_id, r.chain_length, r.is_truncated) for r in full] == [(0, 40, False)] and len(full[0].chain) == 43
    cut = CH.reversal_chains(led, links, 20).collect()
    assert [(r.root_txn_id, r.chain_length, r.is_truncated) for r in cut] == [(0, 20, True)]


def test_ten_thousand_links_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(CH, "materialize", lambda df, name, *a: written.append(name) or materialize(df, name, *a))
    links = spark.range(10_000).select((F.col("id") + 1).alias("child_txn_id"), F.col("id").alias("parent_txn_id"))
    led = spark.range(10_001).select(F.col("id").alias("ledger_txn_id"))
    deep = CH.chain_depths(led, links)
    assert deep.filter("root_txn_id = 0 AND depth = txn_id").count() == deep.count() == 10_001
    assert sum(n.startswith("jump_") for n in written) < 20


def test_chains_equal_a_plain_search(spark):
    rng = random.Random(4)
    for several in (0, 25):
        links = {(c, rng.randrange(300)) for c in rng.sample(range(300), 240)} | {(rng.randrange(300), rng.randrange(300)) for _ in range(several)}
        below, children = {}, {c for c, _ in links}
        for c, p in links:
            below.setdefault(p, set()).add(c)
        want = set()
        for root in set(range(280)) & set(below) - children:
            depth, seen, now = 0, set(), {root}
            while now:
                want |= {(root, depth, x) for x in now}
                seen |= now
                now, depth = {c for x in now for c in below.get(x, ())} - seen, depth + 1
        got = CH.chain_depths(spark.range(280).withColumnRenamed("id", "ledger_txn_id"),
                              spark.createDataFrame(sorted(links), "child_txn_id long, parent_txn_id long"))
        assert {tuple(r) for r in got.select("root_txn_id", "depth", "txn_id").collect()} == want


def test_a_hot_user_day_is_cut_into_blocks(spark):
    """Blocks of 40 attempts of users with up to a thousand a day: the outcomes of a plain fold."""
    rng, t0 = random.Random(9), dt.datetime(2024, 1, 1, 9)
    rows, at = [], t0
    for k in range(1500):
        at += dt.timedelta(seconds=rng.choice([0, 5, 60, 400]))
        rows.append((rng.choice(["hot", "hot", "u1", "u2"]), at, k, rng.random() < .2))
    want, state = {}, {}
    for user, ts, k, ok in rows:
        fails, lock = state.get(user, (0, None))
        if lock and ts < lock:
            want[k] = "REFUSED"
            continue
        if ok:
            want[k], state[user] = "OK", (0, None)
        elif fails + 1 >= S.LOCKOUT_FAILURES:
            want[k], state[user] = "LOCKED", (0, ts + dt.timedelta(minutes=S.LOCKOUT_MINUTES))
        else:
            want[k], state[user] = "FAILED", (fails + 1, None)
    auth = spark.createDataFrame(rows, "user_id string, ts timestamp, event_id long, success boolean").repartition(4)
    assert {r.event_id: r.outcome for r in W.login_lockouts(auth, block=40).collect()} == want


def test_an_audit_scans_each_table_once(spark):
    fx = Fixtures(spark, SF)
    frames = [fx.ledger, fx.external, fx.accounts, fx.exceptions, fx.batches]
    tables = [materialize(df.limit(50), f"audit-{k}") for k, df in enumerate(frames)]
    plan = V.integrity_audit(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 5 and plan.count("Join") == 1
    led = spark.createDataFrame([(1, 1, "CREDIT", 1.0), (1, 2, "ODD", -1.0), (None, None, None, None)], "ledger_txn_id long, account_id long, txn_type string, amount double")
    told = {(r.table_name, r.rule): r.n_rows for r in V.integrity_audit(led, fx.external.limit(0), fx.accounts.limit(0), fx.exceptions.limit(0), fx.batches.limit(0)).collect()}
    t = "ledger_transactions"
    assert len(told) == 16 and {k[1]: n for k, n in told.items() if k[0] == t} == {
        "txn_type_domain": 1, "amount_positive": 1, "unique_ledger_txn_id": 1, "fk_account": 2}


def test_break_amounts_equal_brute_force(spark):
    rng = random.Random(3)
    side = lambda lo, n: [(lo + k, 1, "GBP", round(rng.choice([0.01, 5, 100, 9999]) * rng.random() + 0.01, 2),
                           dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 6))) for k in range(n)]
    left, other = side(0, 80), side(1000, 25)
    frame = lambda rows: spark.createDataFrame(rows, "id long, account_id long, currency string, amount double, value_date date") \
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.id: float(r.amount_diff) for r in CL._nearest(frame(left), frame(other), 2).collect()}
    want = {i: min(round(abs(a - b), 2) for _, _, _, b, e in other if abs((d - e).days) <= 2)
            for i, _, _, a, d in left if any(abs((d - e).days) <= 2 for *_, e in other)}
    assert got == want


def test_one_cell_grows_in_proportion(spark):
    """All keys on one (account, currency, date): four times the rows, about four times the time."""
    def took(n):
        base = spark.range(n).select(F.col("id"), F.lit(1).alias("account_id"), F.lit("GBP").alias("currency"),
                                     F.lit("2024-01-01").cast("date").alias("cdate"), F.lit(0).alias("off"), (F.col("id") * 2).alias("amt"))
        near = M._nearest(base.withColumnRenamed("id", "l_id"), base.withColumnRenamed("id", "e_id").withColumn("amt", F.col("amt") + 1), "l_id", "e_id")
        t = time.time()
        assert near.count() == 2 * n - 1
        return time.time() - t
    took(2_000)
    small = took(20_000)
    assert took(80_000) < 4 * max(1.5, 2 * small)


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {f"spark.sql.{k.replace('__', '.')}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_hot_account_fills_a_third_of_200_partitions(spark):
    """Broadcasts and AQE off, a third of the rows on one account; other accounts aren't copied."""
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__enabled="false", shuffle__partitions="200"):
        acc = spark.range(30_000).select(F.col("id").alias("account_id"))
        led = spark.range(300_000).select(F.col("id").alias("ledger_txn_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 30_000).alias("account_id"))
        hot = R.hot_keys(led, ["account_id"])
        assert [(r["account_id"], r["n"]) for r in hot] == [(7, 100_010)] and hot[0]["pieces"] >= 100
        side = R.salted_join(led, acc, "account_id", "ledger_txn_id", [])
        sizes = [r["count"] for r in side.filter("account_id = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 100_010 and len(sizes) >= 67
        assert side.count() == 300_000


def test_frames_of_a_hot_key_are_cut_and_carried(spark):
    """Running frames over pieces equal one frame over the key, and a hot key's rows lie in several tasks."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", f"k{k % 50}"]), rng.randrange(4000), k, k if rng.random() < .02 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, "key string, at int, id int, v int").repartition(4)
    pieces = R.Pieces(df, ["key"], "at", least=200)
    assert pieces.rows.filter("key = 'hot'").select("__piece").distinct().count() > 8
    assert pieces.rows.filter("key <> 'hot'").select("__piece").distinct().count() == 1
    for down in (False, True):
        for strict in (False, True):
            want = {}
            for key in {r[0] for r in rows}:
                last = None
                for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=down):
                    if strict:
                        want[r[2]] = last
                    last = r[3] if r[3] is not None else last
                    if not strict:
                        want[r[2]] = last
            got = pieces.last(pieces.rows, F.col("v"), ["at", "id"], "o", descending=down, strict=strict)
            assert {r.id: r.o for r in got.collect()} == want


def test_a_hot_request_key_equals_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAST_ROWS", 100)
    monkeypatch.setattr(R.hot_keys, "__defaults__", (100,)), monkeypatch.setattr(R.Pieces.__init__, "__defaults__", (100,))
    rng, t0 = random.Random(11), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(1500):
        ts = t0 + dt.timedelta(seconds=rng.randrange(20_000))
        end = None if rng.random() < .002 else ts + dt.timedelta(seconds=rng.randrange(30))
        rows.append((k, "u", "POST", "/a", rng.choice(["hot", "hot", f"k{k % 200}"]), ts, end, rng.choice([200, 500, 503]) if end else None))
    log = spark.createDataFrame(rows, "request_id long, user_id string, method string, path string, idempotency_key string, ts timestamp, "
                                      "finished_at timestamp, status_code int")
    want = {}
    for key in {r[4] for r in rows}:
        owner = None
        for r in sorted((r for r in rows if r[4] == key), key=lambda r: (r[5], r[0])):
            if owner is None or (owner[6] is not None and owner[7] >= 500 and r[5] >= max(owner[6], owner[5])):
                want[r[0]], owner = "FIRST", r
            else:
                want[r[0]] = "CONFLICT" if owner[6] is None or r[5] < max(owner[6], owner[5]) else "REPLAYED"
    assert {r.request_id: r.outcome for r in W.dedupe_requests(log).collect()} == want


def test_a_hot_account_is_spread(spark):
    """Broadcasts off, a third of all distinct keys on one account: no partition of a prepared side holds over twice the median."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(k, v)
        acc = spark.range(3000).select(F.col("id").alias("account_id"))
        led = spark.range(60_000).select(F.col("id").alias("ledger_txn_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 3000).alias("account_id"),
                                         F.lit("GBP").alias("currency"), F.col("id").cast("decimal(18,2)").alias("amount"),
                                         F.lit("2024-01-01").cast("date").alias("value_date"))
        side = M.ledger_side(led, acc)
        sizes = sorted(r["count"] for r in side.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 60_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for k, v in zip(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"), old):
            spark.conf.set(k, v)


def test_late_actions_and_missing_deadlines_in_the_stream(spark, tmp_path):
    """An action after its deadline has passed the watermark, a deadline that is null: the query goes on, with its state."""
    schema = ("exception_id long, seq long, action string, actor string, actor_role string, expected_version int, assign_to string, note string, "
              "acted_at timestamp, sla_deadline timestamp")
    t = dt.datetime(2024, 1, 1)
    batches = [[(1, 1, "assign", "x", "ADMIN", None, "u", None, t, t + dt.timedelta(hours=2)), (2, 1, "assign", "x", "ADMIN", None, "u", None, t, None)],
               [(3, 1, "assign", "x", "ADMIN", None, "u", None, t + dt.timedelta(days=3), t + dt.timedelta(days=9))],
               [(4, 1, "assign", "x", "ADMIN", None, "u", None, t + dt.timedelta(days=3), t + dt.timedelta(hours=1))],
               [(1, 2, "start", "u", "ANALYST", None, None, None, t + dt.timedelta(days=4), None)]]
    src = str(tmp_path / "in")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    events = []
    for rows in batches:  # a restart from the checkpoint for each
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = (K.stream_workflow_state(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None
        events = spark.read.parquet(out).collect()
    told = {(r.exception_id, r.seq, r.event): (r.code, r.status, r.version) for r in events}
    assert told[1, 2, "ACTION"] == (None, "IN_PROGRESS", 3)
    assert sorted(k[0] for k in told if k[2] == "SLA_BREACHED") == [1, 4]


def test_rows_without_a_key_are_spread_in_left_joins(spark):
    """Exceptions without a ledger row, line or assignee, and those with one: all once, no task with most of them."""
    from ledgerlens.operators import queues as Q
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ("-1", "false", "8")):
            spark.conf.set(k, v)
        key = lambda k: F.when(F.col("id") % k == 0, F.col("id"))
        exc = spark.range(8000).select(F.col("id").alias("exception_id"), key(5).alias("ledger_txn_id"), key(4).alias("ext_line_id"),
                                       key(3).cast("string").alias("assigned_to"))
        day, money = F.lit("2024-01-01").cast("date").alias("value_date"), F.lit(1).cast("decimal(18,2)").alias("amount")
        led = spark.range(8000).select(F.col("id").alias("ledger_txn_id"), F.concat(F.lit("L"), "id").alias("txn_ref"), money, day)
        ext = spark.range(8000).select(F.when(F.col("id") > 0, F.col("id")).alias("ext_line_id"), F.concat(F.lit("E"), "id").alias("external_ref"), money, day)
        users = spark.range(8000).select(F.col("id").cast("string").alias("user_id"), F.concat(F.lit("U"), "id").alias("full_name"))
        got = Q.with_context(exc, led, ext, users)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 8000 and len(sizes) == 8 and sizes[-1] <= 2 * sizes[0]
        for r in got.collect():
            k = r.exception_id
            assert (r.ledger_ref, r.external_ref, r.assigned_to_name) == (
                f"L{k}" if k % 5 == 0 else None, f"E{k}" if k % 4 == 0 and k else None, f"U{k}" if k % 3 == 0 else None)
    finally:
        for k, v in zip(names, old):
            spark.conf.set(k, v)


def test_upload_with_a_repeated_column_comes_in_parts(spark):
    """The upload that repeats a column is written by as many tasks as the feed, each part with the header, and refused for it."""
    import glob
    import os
    from ledgerlens import catalog
    from ledgerlens.sources.fixtures import Fixtures
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small parts would be put together
    kept = dict(catalog._IMPORTED)
    catalog._IMPORTED.clear()
    try:
        fx = Fixtures(spark, "/root/testdata/sf0.001")
        store, told = catalog.imported(fx)
        assert told[-1] == "CSV_HEADER_ERROR"
        folder = os.path.dirname(os.path.dirname(store.lines_dir))
        parts = [open(f).read().splitlines() for f in glob.glob(os.path.join(folder, "twice", "part-*"))]
        head = parts[0][0]
        assert len(parts) == len(glob.glob(os.path.join(folder, "feed", "part-*"))) > 1
        assert head.split(",").count("amount") == 2 and all(p[0] == head and head not in p[1:] for p in parts)
        assert sum(len(p) - 1 for p in parts) == fx.external.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        catalog._IMPORTED.update(kept)
