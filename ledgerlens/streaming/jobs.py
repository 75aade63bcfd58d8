"""K1-K5: Structured Streaming twins of ingest, matching, dedupe, break
counts and workflow state.

All stateful operators are bounded by event-time watermarks, so state is
dropped once the watermark passes; checkpoints go to the shared folder
(``spark.checkpoint.dir``) unless a location is given.
"""

from __future__ import annotations

import datetime as dt
import functools
import logging
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlens import schemas as S
from ledgerlens.operators import matching as M
from ledgerlens.operators import validation as V
from ledgerlens.operators import workflow as W
from ledgerlens.session import materialize, new_run_dir, path_exists
from ledgerlens.sources.imports import ImportRefused, StatementStore

LOG = logging.getLogger(__name__)


def _ckpt(spark: SparkSession, name: str, location: str | None) -> str:
    return location or os.path.join(new_run_dir(spark, "stream"), name)


# ---------------------------------------------------------------------------
# K1 streaming statement ingest
# ---------------------------------------------------------------------------

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, in_dir: str, store: StatementStore, acc: DataFrame, sources: DataFrame,
                  source_id: int = 4, checkpoint: str | None = None,
                  max_files_per_trigger: int | None = None, folders: bool = False) -> StreamingQuery:
    """Each arriving CSV file goes through the import chain by itself: its own
    header, content hash, validation against what is published by then, and
    manifest rows.  With ``folders`` an upload is a folder of parts, which must
    be complete when it appears (moved into place).  An upload that is refused
    or fails for any reason leaves its FAILED row (or none, if it was imported
    before) and the stream goes on; a micro-batch that is run again finds its
    uploads imported.  Only paths are read from the stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv")
    if max_files_per_trigger:
        files = files.option("maxFilesPerTrigger", max_files_per_trigger)

    def handle(batch: DataFrame, epoch: int) -> None:
        upload = F.regexp_replace("path", "/[^/]*$", "") if folders else F.col("path")
        came = batch.groupBy(upload.alias("upload")).agg(F.min("modificationTime").alias("at"))
        for r in came.orderBy("at", "upload").collect():  # one row an upload
            try:
                store.import_statement(r["upload"], source_id, acc, sources)
            except ImportRefused:
                pass  # told in the manifest
            except Exception:  # told there as well; the next upload may be fine
                LOG.exception("import of %s failed", r["upload"])

    return (files.load(in_dir).select("path", "modificationTime").writeStream.foreachBatch(handle)
            .option("checkpointLocation", _ckpt(spark, "ingest", checkpoint)).start())


# ---------------------------------------------------------------------------
# K2 stream-stream exact-match candidates
# ---------------------------------------------------------------------------

def stream_exact_candidates(led: DataFrame, ext: DataFrame, window_days: int = 2,
                            watermark: str = "3 days") -> DataFrame:
    """Ledger and statement streams (already resolved to account_id) joined
    on account, currency and amount with the statement's value time within
    +/- ``window_days`` of the ledger's.  Left outer: a ledger row with no
    candidate is emitted with NULLs once the watermark passes (a late
    MISSING_EXTERNAL).  Mutual-best selection runs per micro-batch
    downstream (``foreachBatch`` + ``operators.matching``)."""
    l = (led.withColumn("l_time", F.col("value_date").cast("timestamp")).withWatermark("l_time", watermark)
         .select("ledger_txn_id", F.col("account_id").alias("l_acct"), F.col("currency").alias("l_cur"),
                 F.col("amount").alias("l_amt"), "l_time"))
    e = (ext.withColumn("e_time", F.col("value_date").cast("timestamp")).withWatermark("e_time", watermark)
         .select("ext_line_id", F.col("account_id").alias("e_acct"), F.col("currency").alias("e_cur"),
                 F.col("amount").alias("e_amt"), "e_time"))
    cond = F.expr(f"""l_acct = e_acct AND l_cur = e_cur AND l_amt = e_amt
                      AND e_time >= l_time - INTERVAL {window_days} DAYS
                      AND e_time <= l_time + INTERVAL {window_days} DAYS""")
    return (l.join(e, cond, "leftOuter")
            .select("ledger_txn_id", "ext_line_id",
                    F.abs(F.datediff("e_time", "l_time")).alias("day_diff")))


# ---------------------------------------------------------------------------
# K3 streaming idempotency dedupe
# ---------------------------------------------------------------------------

def stream_dedupe(requests: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """First request per idempotency key hash within the watermark; requests
    that the check doesn't apply to (no key, other methods) all pass, known by
    their ``request_id``."""
    from ledgerlens.operators.workflow import request_key
    known = requests.withColumn("key_hash", request_key(requests)).withColumn(
        "dedupe_by", F.coalesce("key_hash", F.concat(F.lit("request "), F.col("request_id").cast("string"))))
    return known.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["dedupe_by"]).drop("dedupe_by")


# ---------------------------------------------------------------------------
# K4 tumbling counts
# ---------------------------------------------------------------------------

def stream_break_counts(exc: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Exceptions per type per tumbling window of creation time."""
    return (exc.withWatermark("created_at", watermark)
            .groupBy(F.window("created_at", window).alias("w"), "exception_type")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "exception_type", "cnt"))


def stream_rate_limit(log: DataFrame, key_col: str, ts_col: str, minutes: int, max_requests: int,
                      watermark: str = "1 hour") -> DataFrame:
    """Tumbling rate-limit counts; windows above the limit."""
    return (log.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, f"{minutes} minutes").alias("w"), F.col(key_col).alias("client"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .filter(F.col("requests") > max_requests)
            .select("client", F.col("w.start").alias("window_start"), "requests"))


# ---------------------------------------------------------------------------
# K5 streaming workflow state with an SLA timer
# ---------------------------------------------------------------------------

WF_STATE = ("held array<struct<exception_id:bigint,status:string,version:int,assigned_to:string,sla_deadline:bigint,"
            "breached:boolean,kept_until:bigint>>")
WF_OUT = "exception_id long, seq long, action string, code string, status string, version int, event string"


def _code(st: dict, a) -> str | None:
    """What the state decides (``workflow.state_code``); what doesn't depend on it comes with the action."""
    if not pd.isna(a.own_code):
        return a.own_code
    if a.action == "assign":
        return "INVALID_STATE" if st["status"] in S.NO_REASSIGN_STATUSES else None
    if a.action == "start":
        return None if (st["assigned_to"] == a.actor and st["status"] == "ASSIGNED") else "INVALID_STATE"
    return None if not pd.isna(a.expected_version) and int(a.expected_version) == st["version"] else "VERSION_CONFLICT"


_STATE_FIELDS = ["status", "version", "assigned_to", "sla_deadline", "breached", "kept_until"]
#: How long a closed exception's state is kept after the watermark (late actions still find it closed).
CLOSED_KEPT_MS = 24 * 3600 * 1000
#: A group of the stateful operator holds the exceptions of one hash bucket: calls into Python
#: cost milliseconds each, so there is one a bucket and micro-batch, not one an exception.
WF_BUCKETS = 4096


def _workflow_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The states of a bucket's exceptions.  A state outlives a breach, so later
    actions go on from it; a breach is told once.  Only a closed exception's
    state is dropped, a day later.  The bucket's timer is its earliest one."""
    held = {h[0]: dict(zip(_STATE_FIELDS, h[1:])) for h in (state.get[0] if state.exists else [])}
    now, acted, told = state.getCurrentWatermarkMs(), set(), []
    if not state.hasTimedOut:
        # all of the bucket's rows of this micro-batch: an exception's may come in several parts, in any order
        for a in pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable").itertuples(index=False):
            exception_id = None if pd.isna(a.exception_id) else a.exception_id
            st = held.setdefault(exception_id, {"status": "UNASSIGNED", "version": 1, "assigned_to": None, "sla_deadline": None,
                                                "breached": False, "kept_until": None})
            acted.add(exception_id)
            if st["sla_deadline"] is None and not pd.isna(a.sla_deadline):
                st["sla_deadline"] = int(a.sla_deadline)
            code = _code(st, a)
            if code is None:
                st["status"] = W.NEW_STATUS[a.action]
                st["version"] += 1
                if a.action == "assign":
                    st["assigned_to"] = None if pd.isna(a.assign_to) else a.assign_to
            told.append((exception_id, int(a.seq), a.action, code, st["status"], st["version"], "ACTION"))
    timers, dropped = [], []
    for exception_id, st in held.items():
        if st["status"] == "CLOSED":
            if exception_id in acted:
                st["kept_until"] = now + CLOSED_KEPT_MS
            if st["kept_until"] < now:
                dropped.append(exception_id)
            else:
                timers.append(st["kept_until"])
        elif st["sla_deadline"] is not None and not st["breached"] and st["status"] not in S.DONE_STATUSES:
            if st["sla_deadline"] < now or (exception_id in acted and st["sla_deadline"] == now):
                st["breached"] = True
                told.append((exception_id, None, None, None, st["status"], st["version"], "SLA_BREACHED"))
            else:
                timers.append(st["sla_deadline"])
    for exception_id in dropped:
        del held[exception_id]
    if told:
        yield pd.DataFrame(told, columns=[c.split()[0] for c in WF_OUT.split(", ")], dtype=object)
    if not held:
        state.remove()
        return
    state.update(([(i, *[st[f] for f in _STATE_FIELDS]) for i, st in held.items()],))
    if timers:
        state.setTimeoutTimestamp(max(min(timers), now + 1))  # a timer can't be set for the watermark itself


def stream_workflow_state(actions: DataFrame, watermark: str = "1 hour", buckets: int = WF_BUCKETS) -> DataFrame:
    """Per-exception workflow state kept in streaming state; an event-time
    timer at the SLA deadline emits SLA_BREACHED for exceptions not yet
    approved/closed when the watermark passes the deadline.
    ``actions``: the action log with ``acted_at`` and the exception's
    ``sla_deadline``.  The exceptions are grouped by hash into ``buckets``
    (fixed for the life of a checkpoint); rows without an id have their own."""
    bucket = F.when(F.col("exception_id").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("exception_id"), F.lit(buckets)))
    deadline = F.unix_millis(F.col("sla_deadline").cast("timestamp")) if "sla_deadline" in actions.columns else F.lit(None).cast("long")
    rows = actions.withWatermark("acted_at", watermark).select(
        bucket.alias("bucket"), F.col("exception_id").cast("long").alias("exception_id"), F.col("seq").cast("long").alias("seq"), "action", "actor",
        "expected_version", "assign_to", W.own_code(actions).alias("own_code"), deadline.alias("sla_deadline"), "acted_at")
    return rows.groupBy("bucket").applyInPandasWithState(_workflow_fn, WF_OUT, WF_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------------------
# K2 (final results): micro-batch reconciliation of closed value dates
# ---------------------------------------------------------------------------

RECON_STAGE = ("side string, id long, account_id long, txn_ref string, txn_type string, account_ref string, "
               "amount decimal(18,2), currency string, value_date date, batch_id long, "
               "is_batched_settlement boolean")


def _stage_ledger(led: DataFrame) -> DataFrame:
    return led.select(F.lit("L").alias("side"), F.col("ledger_txn_id").alias("id"), "account_id", "txn_ref",
                      "txn_type", F.lit(None).cast("string").alias("account_ref"), "amount", "currency",
                      "value_date", F.col("batch_id").cast("long"), F.lit(False).alias("is_batched_settlement"))


def _stage_external(ext: DataFrame) -> DataFrame:
    return ext.select(F.lit("E").alias("side"), F.col("ext_line_id").alias("id"),
                      F.lit(None).cast("long").alias("account_id"), F.lit(None).cast("string").alias("txn_ref"),
                      F.lit(None).cast("string").alias("txn_type"), "account_ref", "amount", "currency",
                      "value_date", "batch_id", "is_batched_settlement")


def _ids_or_none(ids: DataFrame) -> DataFrame | None:
    """The written ids (first column) that are marked in ``again``; None without any."""
    marked = materialize(ids.filter("again").drop("again"), "again")
    return None if marked.isEmpty() else marked


def _prior_ids(col: str, again: DataFrame | None, rows: DataFrame | None, near: DataFrame | None = None) -> DataFrame | None:
    """Of the ids in earlier runs' ``rows`` those that a run date can meet: all of
    ``near``, and the ones in ``again``.  None if there are none by construction."""
    if rows is None:
        return None
    parts = [near.select(col)] if near is not None else []
    if again is not None:
        parts.append(rows.select(col).join(again, col, "left_semi"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def reconcile_closed_dates(spark: SparkSession, staging: str, out_dir: str, acc: DataFrame, rules: DataFrame,
                           lateness_days: int) -> list:
    """Run J1 for every value date that is closed (max staged date minus the
    lateness) and not yet done, in date order; each date's outputs are written
    under ``out_dir/<part>/run_date=<d>`` and the date marker is written last."""
    from ledgerlens.config import MatchConfig
    from ledgerlens.plans.reconcile import reconcile

    staged = spark.read.option("basePath", staging).parquet(staging)
    led = staged.filter(F.col("side") == "L").select(
        F.col("id").alias("ledger_txn_id"), "account_id", "txn_ref", "txn_type", "amount", "currency", "value_date",
        "batch_id")
    ext = staged.filter(F.col("side") == "E").select(
        F.col("id").alias("ext_line_id"), "batch_id", F.lit(None).cast("int").alias("source_id"),
        F.lit(None).cast("string").alias("external_ref"), "account_ref", "amount", "currency", "value_date",
        F.col("value_date").alias("settlement_date"), F.col("is_batched_settlement").cast("boolean"))  # a folder's name is text
    top = staged.agg(F.max("value_date")).first()[0]
    if top is None:
        return []
    horizon = top - dt.timedelta(days=lateness_days)
    done_path = os.path.join(out_dir, "closed_dates")
    done = set()
    if path_exists(spark, done_path):
        done = {r[0] for r in spark.read.parquet(done_path).select("run_date").collect()}
    # one row per value date: bounded by the calendar, not by the data
    dates = sorted(r[0] for r in led.filter(F.col("value_date") <= F.lit(horizon))
                   .select("value_date").distinct().collect() if r[0] not in done)
    if not dates:
        return []
    # read by every run date: written once
    rules = materialize(rules, "rules")
    rule = M.first_rule(rules, "TOLERANCE").first()
    reach = max(MatchConfig().exact_window_days, int(rule["date_window_days"]) if rule else 0)
    # ids that more than one run date can meet, wherever these lie: ledger ids on
    # several rows; lines that are flagged or on several rows
    twice = F.count(F.lit(1)) > 1
    led_again = _ids_or_none(led.filter(F.col("value_date") <= F.lit(horizon)).groupBy("ledger_txn_id").agg(twice.alias("again")))
    ext_again = _ids_or_none(ext.groupBy("ext_line_id").agg((twice | F.coalesce(F.max("is_batched_settlement"), F.lit(False))).alias("again")))
    closed = []
    for d in dates:
        def prior(part: str):
            p = os.path.join(out_dir, part)
            return spark.read.parquet(p) if path_exists(spark, p) else None
        lines = prior("external_lines")
        # any other line is only met by run dates whose windows overlap
        near = lines.filter(F.col("run_date") >= F.lit(d - dt.timedelta(days=2 * reach))) if lines is not None else None
        lb, eb = _prior_ids("ledger_txn_id", led_again, prior("ledger_lines")), _prior_ids("ext_line_id", ext_again, lines, near)
        px, told = prior("exceptions"), []
        for col, again in (("ledger_txn_id", led_again), ("ext_line_id", ext_again)):
            ids = _prior_ids(col, again, px)
            if ids is not None:
                told.append(ids.select(*[(F.col(c) if c == col else F.lit(None).cast("long")).alias(c) for c in ("ledger_txn_id", "ext_line_id")]))
        cfg = MatchConfig(run_id=int(d.strftime("%Y%m%d")), run_date=d)
        res = reconcile(led, ext, acc, rules, cfg, ledger_bridge=lb, ext_bridge=eb,
                        prior_exceptions=functools.reduce(DataFrame.unionByName, told) if told else None)
        tag = f"run_date={d.isoformat()}"
        res.ledger_lines.write.mode("overwrite").parquet(os.path.join(out_dir, "ledger_lines", tag))
        res.external_lines.write.mode("overwrite").parquet(os.path.join(out_dir, "external_lines", tag))
        res.exceptions.select("exception_id", "ledger_txn_id", "ext_line_id", "exception_type") \
            .write.mode("overwrite").parquet(os.path.join(out_dir, "exceptions", tag))
        res.run.write.mode("overwrite").parquet(os.path.join(out_dir, "runs", tag))
        spark.createDataFrame([(d,)], "run_date date").write.mode("append").parquet(done_path)
        closed.append(d)
    return closed


def stream_reconcile(spark: SparkSession, led: DataFrame, ext: DataFrame, acc: DataFrame, rules: DataFrame,
                     out_dir: str, lateness_days: int = 7, checkpoint: str | None = None) -> StreamingQuery:
    """Ledger and statement streams -> per closed value date, the J1 run of
    that date (run dates in sequence, as the order dependence of J1 needs).
    Each micro-batch is staged under ``staging/epoch=<n>`` (overwritten on a
    retry), then the newly closed dates are reconciled; results are final
    because a date is only closed once no later row can change it."""
    staging = os.path.join(out_dir, "staging")
    u = _stage_ledger(led).unionByName(_stage_external(ext))

    def handle(batch: DataFrame, epoch: int) -> None:
        # partitioned so that a run date opens its own ledger folder, the lines
        # of its window, and the flagged lines, which may be of any date
        batch.withColumn("is_batched_settlement", F.coalesce("is_batched_settlement", F.lit(False))) \
            .write.mode("overwrite").partitionBy("side", "is_batched_settlement", "value_date") \
            .parquet(os.path.join(staging, f"epoch={epoch}"))
        reconcile_closed_dates(batch.sparkSession, staging, out_dir, acc, rules, lateness_days)

    return (u.writeStream.foreachBatch(handle)
            .option("checkpointLocation", _ckpt(spark, "reconcile", checkpoint)).start())


# ---------------------------------------------------------------------------
# K5 missed-heartbeat timer
# ---------------------------------------------------------------------------

def stream_missed_heartbeats(beats: DataFrame, timeout_seconds: int = S.HEARTBEAT_ACTIVE_SECONDS,
                             watermark: str = "1 minute") -> DataFrame:
    """Job heartbeat events (job_id, ts, status, attempts, max_attempts) ->
    one row per missed heartbeat: a session of heartbeats closes when no
    beat follows within ``timeout_seconds``; if the job was still RUNNING at
    its last beat it stalled at ``last_heartbeat + timeout`` and is either
    RETRYING (run_at = stalled_at + 2^attempts * 10 s) or DEAD_LETTER, as in J10.
    Of beats at the same moment the one with the most attempts counts.
    Session windows are built in (no Python); state is dropped by the watermark."""
    from ledgerlens.functions.columns import retry_delay_seconds
    sess = F.session_window("ts", f"{timeout_seconds} seconds")
    closed = (beats.withWatermark("ts", watermark)
              .groupBy("job_id", sess.alias("s"))
              .agg(F.max("ts").alias("last_heartbeat"),
                   F.max(F.struct("ts", "attempts", "max_attempts", "status")).alias("last")))
    stalled = closed.filter(F.col("last.status") == "RUNNING")
    retry = F.col("last.attempts") < F.col("last.max_attempts")
    at = F.col("s.end")
    return stalled.select(
        "job_id", "last_heartbeat", at.alias("stalled_at"),
        F.col("last.attempts").alias("attempts"),
        F.when(retry, "RETRYING").otherwise("DEAD_LETTER").alias("disposition"),
        F.when(retry, F.timestamp_add("SECOND", retry_delay_seconds(F.col("last.attempts")), at)).alias("next_run_at"))
