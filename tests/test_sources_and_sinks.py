"""Upload checks, sinks and report refresh."""
import datetime as dt
import os
import random
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import history as H
from ledgerlens.plans import reports as R
from ledgerlens.sources import csv as CSV
from ledgerlens.sources.fixtures import Fixtures

from conftest import SF


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="upload-", dir="/tmp")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_header_check_rejects_file(spark):
    p = _write(" External_Ref ,account_ref,amount,currency\nE1,ACC-1,10.00,GBP\n")
    with pytest.raises(CSV.CsvHeaderError):
        CSV.read_statement(spark, p)


def test_statement_reader_trims_and_flags(spark):
    p = _write(" External_Ref ,ACCOUNT_REF,amount,currency,value_date,is_batched_settlement\n"
               " E1 , ACC-1 ,10.005,gbp,2024-01-02,TRUE\n\nE2,ACC-1,,usd,2024-01-03,yes\n")
    raw = CSV.read_statement(spark, p)
    rows = CSV.type_statement(raw).orderBy("external_ref").collect()
    assert [r.external_ref for r in rows] == ["E1", "E2"]
    assert str(rows[0].amount) == "10.01" and rows[1].amount is None
    assert [r.is_batched_settlement for r in rows] == [True, False]
    assert CSV.check_size(raw, 1) == "ROW_LIMIT" and CSV.check_size(raw, 10) is None
    assert CSV.check_size(raw.limit(0)) == "EMPTY_FILE"


def test_negative_amount_rejected(spark):
    fx = Fixtures(spark, SF)
    from ledgerlens.operators import validation as V
    raw = spark.createDataFrame([("S1", "ACC-1", "-50.00", "GBP", "2024-01-01", None, None)],
                                "external_ref string, account_ref string, amount string, currency string, "
                                "value_date string, settlement_date string, is_batched_settlement string")
    rules = {r.rule for r in V.validate_statement(raw, fx.accounts, fx.external.limit(0)).collect()}
    assert rules == {"AMOUNT_NOT_POSITIVE"}


def test_refresh_summary_rewrites_touched_dates(spark):
    fx = Fixtures(spark, SF)
    exc = fx.exceptions.limit(0)
    path = os.path.join(tempfile.mkdtemp(prefix="summary-", dir="/tmp"), "s")
    full = R.refresh_summary(fx.ledger, fx.external, exc, fx.accounts, path)
    n = full.count()
    touched = fx.ledger.select("value_date").limit(3)
    again = R.refresh_summary(fx.ledger, fx.external, exc, fx.accounts, path, touched)
    assert again.count() == n


def _summary_inputs(spark, rows):
    """Ledger, empty statement, exceptions of (account, date, exceptions) rows; accounts."""
    acc = spark.createDataFrame([(a, f"R{a}") for a in range(1, 40)], "account_id long, external_ref string")
    led = spark.createDataFrame([(i, a, d, "CREDIT", Decimal(5)) for i, (a, d, _) in enumerate(rows)],
                                "ledger_txn_id long, account_id long, value_date date, txn_type string, amount decimal(18,2)")
    ext = spark.createDataFrame([], "account_ref string, value_date date, amount decimal(18,2)")
    exc = spark.createDataFrame([(i, dt.datetime.combine(d, dt.time(9))) for i, (_, d, n) in enumerate(rows) for _ in range(n)] or [],
                                "ledger_txn_id long, created_at timestamp")
    return led, ext, exc, acc


@pytest.mark.parametrize("monthly", [False, True])
def test_refresh_opens_only_partitions_near_the_touched_dates(spark, tmp_path, monthly):
    rng, day0, span = random.Random(3), dt.date(2023, 1, 1), 240 if monthly else 60
    rows = [(a, day0 + dt.timedelta(days=k), rng.randrange(3)) for a in range(1, 4) for k in range(0, span, a)]
    rows += [(20, day0 + dt.timedelta(days=k), 2) for k in (0, 40, span - 10)]  # an account of few days
    path = str(tmp_path / "s")
    R.refresh_summary(*_summary_inputs(spark, rows), path, monthly=monthly)
    for shift, touched in enumerate([[span // 2], [span], [3, 40]]):
        days = [day0 + dt.timedelta(days=k) for k in touched]
        rows = [(a, d, n + (d in days)) for a, d, n in rows if not (d in days and a == 1 and shift == 2)]
        rows += [(30 + shift, d, 1) for d in days]  # new accounts
        led, ext, exc, acc = _summary_inputs(spark, rows)
        want = sorted(map(str, R.daily_summary(led, ext, exc, acc).collect()))
        got = R.refresh_summary(led, ext, exc, acc, path, spark.createDataFrame([(d,) for d in days], "value_date date"), monthly=monthly)
        assert sorted(map(str, got.select(*R.daily_summary(led, ext, exc, acc).columns).collect())) == want
    stored, periods = spark.read.parquet(path), R._periods(led, path)
    day = day0 + dt.timedelta(days=span // 2)
    near = R._neighbourhood(stored, spark.read.parquet(path + "/_accounts"), spark.createDataFrame([(1,)], "account_id long"), periods, [day],
                            [day.replace(day=1) if monthly else day])
    assert len(near.select("period").distinct().collect()) < (4 if monthly else 20) < len(periods)
    assert re.search(r"PartitionFilters: \[[^\]]", near._jdf.queryExecution().executedPlan().toString())


def test_write_monthly(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 2, 7))],
                               "id long, created_at timestamp")
    path = os.path.join(tempfile.mkdtemp(prefix="audit-", dir="/tmp"), "a")
    H.write_monthly(df, path)
    back = spark.read.parquet(path)
    assert sorted((r.y, r.m) for r in back.select("y", "m").collect()) == [(2024, 1), (2024, 2)]
    assert back.filter((F.col("y") == 2024) & (F.col("m") == 2)).count() == 1


def test_job_health_with_schedules(spark):
    fx = Fixtures(spark, SF)
    sched = spark.createDataFrame([(1, True), (2, False), (3, True)], "config_id int, is_active boolean")
    got = {r.metric: r.value for r in R.job_health(fx.jobs, fx.dead_letters, sched,
                                                   dt.datetime(2024, 1, 15)).collect()}
    assert got["active_schedulers"] == 2 and got["dead_letter_queue"] > 0


def test_batch_publish_is_all_or_nothing(spark):
    base = tempfile.mkdtemp(prefix="publish-", dir="/tmp")
    lines = spark.createDataFrame([(1, "E1")], "ext_line_id long, external_ref string")
    manifest = spark.createDataFrame([(7, "COMPLETED", 1)], "batch_id long, status string, row_count int")
    CSV.write_batch(lines, os.path.join(base, "lines", "batch_id=7"), manifest, os.path.join(base, "manifest"))
    with pytest.raises(Exception):  # the same batch folder is never written twice
        CSV.write_batch(lines, os.path.join(base, "lines", "batch_id=7"), manifest, os.path.join(base, "manifest"))
    assert spark.read.parquet(os.path.join(base, "manifest")).count() == 1
    assert spark.read.parquet(os.path.join(base, "lines")).count() == 1
