"""Reports E1-E16, F3-F5 and J4.

Aggregations are pre-aggregated before any join (partial aggregation on the
map side), and windows only ever run over already-aggregated rows (one row
per account-day or per type-day), never over raw transactions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.columns import round1_ratio
from ledgerlens.session import materialize, path_exists


def _asof(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


# ---------------------------------------------------------------------------
# Daily reconciliation summary
# ---------------------------------------------------------------------------

def ledger_daily(led: DataFrame, acc: DataFrame) -> DataFrame:
    """Per (account, value_date): count, credits, debits."""
    return (led.join(acc.select("account_id"), "account_id", "left_semi")
            .groupBy("account_id", "value_date")
            .agg(F.count(F.lit(1)).alias("internal_txn_count"),
                 F.sum(F.when(F.col("txn_type") == "CREDIT", F.col("amount"))).alias("internal_credits"),
                 F.sum(F.when(F.col("txn_type") == "DEBIT", F.col("amount"))).alias("internal_debits")))


def external_daily(ext: DataFrame, acc: DataFrame) -> DataFrame:
    """Per (account, value_date): line count and total.  Lines are
    pre-aggregated per (account_ref, date) before the account lookup."""
    pre = (ext.groupBy("account_ref", "value_date")
           .agg(F.count(F.lit(1)).alias("external_line_count"), F.sum("amount").alias("external_total")))
    a = acc.select(F.col("external_ref").alias("account_ref"), "account_id")
    return (pre.join(a, "account_ref").groupBy("account_id", "value_date")
            .agg(F.sum("external_line_count").alias("external_line_count"),
                 F.sum("external_total").alias("external_total")))


def exception_daily(exc: DataFrame, led: DataFrame) -> DataFrame:
    """Per (ledger account, created date): count.  Exceptions without a
    ledger side get a NULL account (and never join a summary row)."""
    e = exc.select("ledger_txn_id", F.to_date("created_at").alias("exception_date"))
    return (e.join(led.select("ledger_txn_id", "account_id"), "ledger_txn_id", "left")
            .groupBy("account_id", "exception_date").agg(F.count(F.lit(1)).alias("exception_count")))


def daily_summary(led: DataFrame, ext: DataFrame, exc: DataFrame, acc: DataFrame,
                  all_led: DataFrame | None = None) -> DataFrame:
    """E4 (+ D7 full outer join, F4 rolling 7-row average).  ``all_led``: where
    the exceptions' accounts are looked up, if ``led`` is a part of the ledger."""
    l = ledger_daily(led, acc)
    x = external_daily(ext, acc)
    e = exception_daily(exc, led if all_led is None else all_led).filter(F.col("account_id").isNotNull())
    j = l.join(x, ["account_id", "value_date"], "full").withColumnRenamed("value_date", "summary_date")
    j = j.join(e.withColumnRenamed("exception_date", "summary_date"), ["account_id", "summary_date"], "left")
    w = Window.partitionBy("account_id").orderBy("summary_date").rowsBetween(-6, 0)
    exc_n = F.coalesce(F.col("exception_count"), F.lit(0))
    return j.select(
        "account_id", "summary_date",
        F.coalesce("internal_txn_count", F.lit(0)).cast("long").alias("internal_txn_count"),
        (F.coalesce("internal_credits", F.lit(0)) - F.coalesce("internal_debits", F.lit(0)))
        .cast(S.MONEY).alias("internal_net"),
        F.coalesce("external_line_count", F.lit(0)).cast("long").alias("external_line_count"),
        F.coalesce("external_total", F.lit(0)).cast(S.MONEY).alias("external_total"),
        exc_n.cast("long").alias("exception_count"),
        F.round(F.avg(exc_n).over(w), 6).cast("decimal(18,6)").alias("rolling_7d_avg_exceptions"))


#: Rows before and after an account's touched days that a refresh needs: those of the rolling average.
ROLLING = 6


def _periods(df: DataFrame, path: str) -> list[dt.date]:
    """The stored partitions, in order: a listing of folders, no file is opened."""
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(dt.date.fromisoformat(n[7:]) for n in names if n.startswith("period=") and n[7:8].isdigit())


def _bounds(summary: DataFrame) -> DataFrame:
    return summary.groupBy("account_id").agg(F.min("summary_date").alias("first_day"), F.max("summary_date").alias("last_day"))


def _between(stored: DataFrame, periods: list[dt.date], lo: int, hi: int) -> DataFrame:
    """The partitions from the lo-th to the hi-th; beyond either end of the list there is no bound."""
    some = F.lit(True)
    if lo > 0:
        some = some & (F.col("period") >= F.lit(periods[lo]))
    if hi < len(periods) - 1:
        some = some & (F.col("period") <= F.lit(periods[hi]))
    return stored.filter(some | F.col("period").isNull()) if lo > 0 or hi < len(periods) - 1 else stored


def _neighbourhood(stored: DataFrame, bounds: DataFrame, accounts: DataFrame, periods: list[dt.date], days: list[dt.date],
                   touched: list[dt.date]) -> DataFrame:
    """The stored partitions that hold ``ROLLING`` rows of each account on either side of the touched days, if there are so many.

    One partition more on either side, then two, four and so on, until no account
    lacks rows.  ``bounds`` (account_id, first_day, last_day; never too narrow) tell
    which accounts have no rows further out, so a new account opens nothing."""
    lo = max(0, sum(p < min(touched) for p in periods) - 1)
    hi = min(len(periods) - 1, sum(p <= max(touched) for p in periods))
    known, step = bounds.join(accounts, "account_id", "left_semi"), 1
    while True:
        near = _between(stored, periods, lo, hi)
        rows = near.groupBy("account_id").agg(F.count(F.when(F.col("summary_date") < F.lit(min(days)), 1)).alias("before"),
                                              F.count(F.when(F.col("summary_date") > F.lit(max(days)), 1)).alias("after"))
        few = known.join(rows, "account_id", "left").na.fill(0, ["before", "after"])
        further = F.lit(periods[hi + 1]) if hi < len(periods) - 1 else F.lit(None).cast("date")
        lacks = few.agg(F.max((F.col("before") < ROLLING) & (F.col("first_day") < F.lit(periods[lo]))),
                        F.max((F.col("after") < ROLLING) & (F.col("last_day") >= further))).first()
        back, on = bool(lacks[0]) and lo > 0, bool(lacks[1]) and hi < len(periods) - 1
        if not back and not on:
            return near
        lo, hi = max(0, lo - step) if back else lo, min(len(periods) - 1, hi + step) if on else hi
        step *= 2


def refresh_summary(led: DataFrame, ext: DataFrame, exc: DataFrame, acc: DataFrame, path: str,
                    touched_dates: DataFrame | None = None, monthly: bool = False) -> DataFrame:
    """Write the summary partitioned by date (or by month); with
    ``touched_dates`` (value_date) only what these dates change is rewritten.

    Of the inputs, only the touched dates are summed again.  The accounts' rows
    around them come from the stored summary, of which only the partitions near
    the touched dates are opened (``_neighbourhood``); the rolling averages of a
    touched day and of the account's next six days are computed anew, and the
    partitions of all these days are replaced with the other accounts' stored
    rows in them.  The first and last day of each account are kept beside the
    partitions, widened before these change; without them all are opened."""
    spark = led.sparkSession

    def period(c: str) -> Column:
        return (F.trunc(c, "MM") if monthly else F.col(c)).alias("period")

    def write(df: DataFrame) -> DataFrame:
        (df.withColumn("period", period("summary_date")).repartition("period").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path))
        return spark.read.parquet(path).drop("period")

    extent = f"{path}/_accounts"
    if touched_dates is None:
        full = write(daily_summary(led, ext, exc, acc))
        _bounds(full).write.mode("overwrite").parquet(extent)
        return full
    days = materialize(touched_dates.select(F.col("value_date").alias("day")).dropna().distinct(), "touched")
    calendar = [(r["day"], r["period"]) for r in days.withColumn("period", period("day")).collect()]  # dates of a calendar
    if not calendar:
        return spark.read.parquet(path).drop("period")
    on = lambda df, day: df.withColumn("day", day).join(F.broadcast(days), "day", "left_semi").drop("day")  # noqa: E731  dates of a calendar
    stored = spark.read.parquet(path)
    new = daily_summary(on(led, F.col("value_date")), on(ext, F.col("value_date")), on(exc, F.to_date("created_at")), acc, led)
    new = materialize(new.drop("rolling_7d_avg_exceptions").withColumn("is_new", F.lit(True)), "new")
    touched = sorted({p for _, p in calendar})
    gone = on(stored.filter(F.col("period").isin(touched)).drop("period"), F.col("summary_date"))
    accounts = materialize(new.select("account_id").unionByName(gone.select("account_id")).distinct(), "accounts")
    near, folders = stored, _periods(led, path)
    if folders and path_exists(spark, f"{extent}/_SUCCESS"):
        bounds = spark.read.parquet(extent)
        near = _neighbourhood(stored, bounds, accounts, folders, [d for d, _ in calendar], touched)
        wider = bounds.unionByName(_bounds(new)).groupBy("account_id").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
        materialize(wider, "bounds").write.mode("overwrite").parquet(extent)
    old = near.drop("period")
    kept = (old.join(accounts, "account_id", "left_semi").drop("rolling_7d_avg_exceptions")
            .join(F.broadcast(days.withColumnRenamed("day", "summary_date")), "summary_date", "left_anti"))
    # a vanished day leaves a mark, so that the days after it are known to change
    marks = gone.select("account_id", "summary_date").join(new.select("account_id", "summary_date"), ["account_id", "summary_date"], "left_anti")
    both = kept.withColumn("is_new", F.lit(False)).unionByName(new).unionByName(marks.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("account_id").orderBy("summary_date")
    real = F.col("internal_txn_count").isNotNull()
    place = F.sum(real.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(F.col("is_new"), F.col("place")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("place", place).withColumn("since", F.col("place") - last).filter(real)
    avg = F.round(F.avg("exception_count").over(w.rowsBetween(-6, 0)), 6).cast("decimal(18,6)")
    again = placed.withColumn("rolling_7d_avg_exceptions", avg).filter("since <= 6").select(*[c for c in old.columns])
    again = materialize(again, "changed")
    key = ["account_id", "summary_date"]
    periods = again.select(period("summary_date")).unionByName(days.select(period("day"))).distinct()
    changed = [r["period"] for r in periods.collect()]  # of a calendar as well
    rest = stored.filter(F.col("period").isin(changed)).drop("period").join(again.select(*key), key, "left_anti").join(
        marks.select(*key), key, "left_anti")
    result = materialize(again.unionByName(rest.select(*again.columns)), "partitions")
    emptied = periods.join(result.select(period("summary_date")).distinct(), "period", "left_anti").collect()
    write(result)
    for r in emptied:  # periods without any row left: a partition to drop each
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/period={r['period']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.parquet(path).drop("period")


# ---------------------------------------------------------------------------
# Exception trend
# ---------------------------------------------------------------------------

def exception_trend(exc: DataFrame, from_date: dt.date, to_date: dt.date) -> DataFrame:
    """per (day, type) in range: cnt, previous present day's cnt of the
    type, delta, share of the day (rounded to 1)."""
    d = F.to_date("created_at")
    daily = (exc.filter((d >= F.lit(from_date)) & (d <= F.lit(to_date)))
             .groupBy(d.alias("day"), "exception_type").agg(F.count(F.lit(1)).alias("cnt")))
    by_type = Window.partitionBy("exception_type").orderBy("day")
    by_day = Window.partitionBy("day")
    return (daily
            .withColumn("prev_day_cnt", F.lag("cnt").over(by_type))
            .withColumn("day_total", F.sum("cnt").over(by_day))
            .select("day", "exception_type", F.col("cnt").cast("long"), F.col("prev_day_cnt").cast("long"),
                    (F.col("cnt") - F.coalesce("prev_day_cnt", F.lit(0))).cast("long").alias("delta_vs_prev_day"),
                    round1_ratio(F.col("cnt") * 100, "day_total").alias("pct_of_day")))


def daily_break_volume(trend: DataFrame) -> DataFrame:
    """Trend rows summed per day."""
    return trend.groupBy("day").agg(F.sum("cnt").cast("long").alias("total_breaks"))


# ---------------------------------------------------------------------------
# E5-E12, E15
# ---------------------------------------------------------------------------

def analyst_workload(exc: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """E5: per live user: open (ASSIGNED/IN_PROGRESS), in review (RESOLVED),
    approved on the as_of day.  Exceptions are counted per assignee first."""
    today = F.to_date(_asof(as_of))
    per = (exc.filter(F.col("assigned_to").isNotNull()).groupBy(F.col("assigned_to").alias("user_id"))
           .agg(F.count_if(F.col("status").isin("ASSIGNED", "IN_PROGRESS")).alias("open_count"),
                F.count_if(F.col("status") == "RESOLVED").alias("in_review_count"),
                F.count_if((F.col("status") == "APPROVED") & (F.to_date("approved_at") == today))
                .alias("resolved_today")))
    live = users.filter(F.col("deleted_at").isNull()).select("user_id", "full_name")
    return live.join(per, "user_id", "left").select(
        "user_id", "full_name",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("open_count", "in_review_count", "resolved_today")])


def ops_kpis(exc: DataFrame, runs: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """E6-E10 as one row; each rate rounded to one place."""
    now = _asof(as_of)
    done = F.coalesce("resolved_at", "approved_at", "closed_at")
    micros = F.unix_micros(done) - F.unix_micros(F.col("created_at"))
    e = exc.agg(
        F.sum(F.when(done.isNotNull(), micros)).alias("s_us"),
        F.count(done).alias("n_done"),
        F.count(F.lit(1)).alias("n"),
        F.count_if((done <= F.col("sla_deadline")) | (done.isNull() & (now <= F.col("sla_deadline")))).alias("ok"),
        F.count_if(F.col("status").isin(S.ACTIVE_QUEUE_STATUSES)).alias("active"))
    r = runs.agg(F.sum("matched_count").alias("m"),
                 F.sum(F.col("matched_count") + F.col("exception_count")).alias("t"))
    b = batches.agg(F.count(F.lit(1)).alias("bn"), F.count_if(F.col("status") == "COMPLETED").alias("bc"))
    # three one-row aggregates combined by a union and one final aggregate
    parts = {"e": e, "r": r, "b": b}
    tagged = None
    for name, df in parts.items():
        cols = [F.struct(*df.columns).alias(name) if n == name else
                F.lit(None).cast(parts[n].schema.simpleString()).alias(n) for n in parts]
        t = df.select(*cols)
        tagged = t if tagged is None else tagged.unionByName(t)
    row = tagged.agg(*[F.first(n, ignorenulls=True).alias(n) for n in parts]).select("e.*", "r.*", "b.*")
    zero, hundred = F.lit(0).cast("decimal(20,1)"), F.lit(100).cast("decimal(20,1)")
    return row.select(
        F.coalesce(round1_ratio("s_us", F.col("n_done") * 3_600_000_000), zero).alias("avg_resolution_hours"),
        F.coalesce(round1_ratio(F.col("ok") * 100, "n"), hundred).alias("sla_compliance_pct"),
        F.coalesce(round1_ratio(F.col("m") * 100, "t"), zero).alias("auto_match_rate"),
        F.coalesce(round1_ratio(F.col("bc") * 100, "bn"), hundred).alias("import_success_rate"),
        F.col("active").cast("long").alias("active_queue_size"))


def breakdown(exc: DataFrame, col: str) -> DataFrame:
    """Counts by status or by type."""
    return exc.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def job_health(jobs: DataFrame, dead: DataFrame, schedules: DataFrame | None, as_of,
               heartbeat_seconds: int = S.HEARTBEAT_ACTIVE_SECONDS,
               worker_col: Column | None = None) -> DataFrame:
    """E12 in long form (metric, value): jobs per status, distinct active
    workers (RUNNING with a heartbeat in the last N seconds), active
    schedules, dead-letter size.  The worker id is read from the JSON payload
    by default, as the reference does."""
    now = _asof(as_of)
    worker = worker_col if worker_col is not None else F.get_json_object("payload", "$.workerId")
    by_status = jobs.groupBy(F.concat(F.lit("jobs:"), F.col("status")).alias("metric")) \
        .agg(F.count(F.lit(1)).alias("value"))
    active = (jobs.filter((F.col("status") == "RUNNING") &
                          (F.col("last_heartbeat") > F.timestamp_add("SECOND", F.lit(-heartbeat_seconds), now)))
              .agg(F.count_distinct(worker).alias("value")).select(F.lit("active_workers").alias("metric"), "value"))
    dlq = dead.agg(F.count(F.lit(1)).alias("value")).select(F.lit("dead_letter_queue").alias("metric"), "value")
    out = by_status.unionByName(active).unionByName(dlq)
    if schedules is not None:
        out = out.unionByName(schedules.filter(F.col("is_active")).agg(F.count(F.lit(1)).alias("value"))
                              .select(F.lit("active_schedulers").alias("metric"), "value"))
    return out.select("metric", F.col("value").cast("long"))
