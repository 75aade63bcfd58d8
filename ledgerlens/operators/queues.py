"""Exception queues and lists: C1-C9, D6, D8, D12, F5, G1-G5, H1.

Lists are composed ``Column`` predicates over the exception table; pages
are ``orderBy(...).offset(m).limit(n)`` (a global top-(m+n), planned as
``TakeOrderedAndProject``), and the total row count is a separate
aggregate instead of an empty-partition window that would funnel every row
into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.columns import (add_hours, is_sla_breached, remaining_text,
                                          time_remaining_seconds)
from ledgerlens.operators.running import left_join


def _asof(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


# ---------------------------------------------------------------------------
# C5-C7 SLA
# ---------------------------------------------------------------------------

def with_sla(exc: DataFrame, sla_rules: DataFrame, as_of) -> DataFrame:
    """deadline = created_at + rule hours (default 24), breach flag,
    seconds remaining (negative when late) and its display text.  The rule
    table is UNIQUE on exception_type, a CHECK-constrained enumeration of
    five values, so its size is bounded by the schema and it is broadcast."""
    now = _asof(as_of)
    rules = F.broadcast(sla_rules.select("exception_type", "max_resolution_hours"))
    out = (exc.drop("sla_deadline").join(rules, "exception_type", "left")
           .withColumn("sla_deadline", add_hours("created_at",
                                                 F.coalesce("max_resolution_hours", F.lit(S.SLA_DEFAULT_HOURS))))
           .drop("max_resolution_hours"))
    return (out.withColumn("is_sla_breached", is_sla_breached("status", "sla_deadline", now))
            .withColumn("time_remaining_seconds", time_remaining_seconds("sla_deadline", now))
            .withColumn("time_remaining_text", remaining_text("time_remaining_seconds")))


# ---------------------------------------------------------------------------
# D6 context, C1-C4, C9
# ---------------------------------------------------------------------------

def with_context(exc: DataFrame, led: DataFrame, ext: DataFrame, users: DataFrame) -> DataFrame:
    """Ledger ref/amount/date, statement ref/amount/date, assignee name."""
    l = led.select("ledger_txn_id", F.col("txn_ref").alias("ledger_ref"), F.col("amount").alias("ledger_amount"),
                   F.col("value_date").alias("ledger_value_date"))
    e = ext.select("ext_line_id", "external_ref", F.col("amount").alias("external_amount"),
                   F.col("value_date").alias("external_value_date"))
    u = users.select(F.col("user_id").alias("assigned_to"), F.col("full_name").alias("assigned_to_name"))
    for side, key in ((l, "ledger_txn_id"), (e, "ext_line_id"), (u, "assigned_to")):
        exc = left_join(exc, side, key, "exception_id")
    return exc


def live_users(users: DataFrame) -> DataFrame:
    """Soft-deleted users are hidden."""
    return users.filter(F.col("deleted_at").isNull())


def visible(exc: DataFrame, role: str, user_id: str | None) -> DataFrame:
    """APPROVER/AUDITOR/ADMIN see every row; others their own or unassigned rows."""
    if role in S.SEE_ALL_ROLES:
        return exc
    return exc.filter(F.col("assigned_to").isNull() | (F.col("assigned_to") == F.lit(user_id)))


def search_refs(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring on either reference; the user's ``%``
    and ``_`` keep their wildcard meaning, as in the reference."""
    pat = f"%{text}%"
    return df.filter(F.col("ledger_ref").ilike(pat) | F.col("external_ref").ilike(pat))


def filter_exceptions(df: DataFrame, status: str | None = None, assigned_to: str | None = None,
                      exception_type: str | None = None, search: str | None = None) -> DataFrame:
    """C1 predicates (each optional, combined with AND)."""
    if status:
        df = df.filter(F.col("status") == status)
    if assigned_to:
        df = df.filter(F.col("assigned_to") == assigned_to)
    if exception_type:
        df = df.filter(F.col("exception_type") == exception_type)
    if search:
        df = search_refs(df, search)
    return df


def page(df: DataFrame, order: list[Column], page_no: int = 1, page_size: int = 25) -> DataFrame:
    """G1: one page (1-based) of an ordered result."""
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def with_total(page_df: DataFrame, total: int, page_size: int) -> DataFrame:
    """pagination metadata from a separately counted total."""
    return (page_df.withColumn("total_count", F.lit(total).cast("long"))
            .withColumn("total_pages", F.lit(math.ceil(total / page_size) if page_size else 0).cast("long")))


def list_exceptions(exc: DataFrame, led: DataFrame, ext: DataFrame, users: DataFrame, as_of,
                    status=None, assigned_to=None, exception_type=None, search=None,
                    page_no: int = 1, page_size: int = 25) -> DataFrame:
    """C1 + D6 + C6/C7 + G1 + F5.  A page or size below 1 is an error.

    Only a search on references needs the context of every exception; without
    one, the page is taken first and its rows alone are joined."""
    if page_size < 1 or page_no < 1:
        raise ValueError(f"page_no and page_size start at 1, got {page_no} and {page_size}")
    now = _asof(as_of)
    order = [F.col("created_at").desc(), F.col("exception_id").desc()]
    df = filter_exceptions(exc, status, assigned_to, exception_type)
    if search:
        df = search_refs(with_context(df, led, ext, users), search)
    total = df.count()
    p = page(df, order, page_no, page_size)
    if not search:
        p = with_context(p, led, ext, users).orderBy(*order)
    p = (p.withColumn("is_sla_breached", is_sla_breached("status", "sla_deadline", now))
         .withColumn("time_remaining_seconds", time_remaining_seconds("sla_deadline", now)))
    return with_total(p, total, page_size)


def open_exceptions(exc: DataFrame, led: DataFrame, ext: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """C4: the open queue view (UNASSIGNED..APPROVED) with context and breach flag."""
    now = _asof(as_of)
    e = exc.filter(F.col("status").isin(S.OPEN_QUEUE_STATUSES))
    df = with_context(e, led, ext, users)
    return df.select("exception_id", "run_id", "exception_type", "amount_diff", "status", "version",
                     "ledger_ref", "ledger_amount", "ledger_value_date", "external_ref", "external_amount",
                     "external_value_date", "assigned_to_name", "created_at", "sla_deadline",
                     is_sla_breached("status", "sla_deadline", now).alias("is_sla_breached"))


def my_queue(exc: DataFrame, user_id: str, status: str, n: int = 50) -> DataFrame:
    """Newest ``n`` exceptions of a status assigned to a user."""
    return (exc.filter((F.col("status") == status) & (F.col("assigned_to") == user_id))
            .orderBy(F.col("created_at").desc(), F.col("exception_id").desc()).limit(n)
            .select("exception_id", "exception_type", "amount_diff", "created_at"))


# ---------------------------------------------------------------------------
# Batches, runs, jobs
# ---------------------------------------------------------------------------

def eligible_batches(batches: DataFrame, sources: DataFrame, ext: DataFrame) -> DataFrame:
    """C8 + A6 + D8: COMPLETED, not from a DATABASE source, and has lines.
    Sources are keyed by a SMALLINT id (at most 32767 rows), so the source
    table is broadcast."""
    src = F.broadcast(sources.filter(F.col("file_format") != "DATABASE").select("source_id"))
    return (batches.filter(F.col("status") == "COMPLETED")
            .join(src, "source_id", "left_semi")
            .join(ext.select("batch_id"), "batch_id", "left_semi"))


def latest_batch(batches: DataFrame, sources: DataFrame, ext: DataFrame) -> DataFrame:
    """Newest eligible batch (completed_at desc nulls last, batch_id desc)."""
    return (eligible_batches(batches, sources, ext)
            .orderBy(F.col("completed_at").desc_nulls_last(), F.col("batch_id").desc()).limit(1)
            .select("batch_id", "source_id", "file_name", "completed_at"))


class NoSettlementBatch(ValueError):
    """A run was asked for without a statement batch that it could use."""

    code = "NO_EXTERNAL_SETTLEMENT_BATCH"


def require_batch(batches: DataFrame, sources: DataFrame, ext: DataFrame, batch_id: int | None = None) -> int:
    """The given batch if it is eligible, else without one the newest eligible; NoSettlementBatch if there is none."""
    if batch_id is None:
        found = latest_batch(batches, sources, ext).select("batch_id").first()
    else:
        found = eligible_batches(batches.filter(F.col("batch_id") == batch_id), sources, ext).select("batch_id").first()
    if found is None:
        raise NoSettlementBatch("no external settlement batch is available for reconciliation")
    return found["batch_id"]


def run_history(runs: DataFrame, users: DataFrame, page_no: int = 1, page_size: int = 20) -> DataFrame:
    """Runs with the trigger's name, newest first, paged."""
    u = users.select(F.col("user_id").alias("triggered_by"), F.col("full_name").alias("triggered_by_name"))
    df = runs.join(u, "triggered_by", "left")
    total = runs.count()
    p = page(df, [F.col("started_at").desc(), F.col("run_id").desc()], page_no, page_size)
    return with_total(p, total, page_size)


def import_history(batches: DataFrame, sources: DataFrame, users: DataFrame,
                   page_no: int = 1, page_size: int = 20) -> DataFrame:
    """Batches with source name/format and importer name, newest first
    (sources: SMALLINT key, bounded, broadcast)."""
    s = F.broadcast(sources.select("source_id", "source_name", "file_format"))
    u = users.select(F.col("user_id").alias("imported_by"), F.col("full_name").alias("imported_by_name"))
    df = batches.join(s, "source_id", "left").join(u, "imported_by", "left")
    total = batches.count()
    p = page(df, [F.col("completed_at").desc_nulls_last(), F.col("batch_id").desc()], page_no, page_size)
    return with_total(p, total, page_size)


def next_due_jobs(jobs: DataFrame, as_of, n: int = 10) -> DataFrame:
    """Due PENDING/RETRYING jobs by (priority, created_at, job_id)."""
    now = _asof(as_of)
    return (jobs.filter(F.col("status").isin("PENDING", "RETRYING") & (F.col("run_at") <= now))
            .orderBy("priority", "created_at", "job_id").limit(n)
            .select("job_id", "job_type", "priority", "attempts", "run_at", "created_at"))


def job_lookup(jobs: DataFrame, dead: DataFrame, job_id: int | None = None) -> DataFrame:
    """H1: live jobs UNION ALL dead letters (status DEAD_LETTER, padded columns)."""
    live = jobs.select("job_id", "job_type", "status", "priority", "attempts", "max_attempts", "run_at",
                       "started_at", "completed_at", "last_heartbeat", "error_message", "created_at",
                       "worker_owner")
    d = dead.select("job_id", "job_type", F.lit("DEAD_LETTER").alias("status"), "priority", "attempts",
                    F.col("attempts").alias("max_attempts"), F.col("failed_at").alias("run_at"),
                    F.lit(None).cast("timestamp").alias("started_at"), F.col("failed_at").alias("completed_at"),
                    F.lit(None).cast("timestamp").alias("last_heartbeat"),
                    F.col("last_error").alias("error_message"), F.col("failed_at").alias("created_at"),
                    F.lit(None).cast("string").alias("worker_owner"))
    out = live.unionByName(d)
    if job_id is not None:
        out = out.filter(F.col("job_id") == job_id)
    return out
