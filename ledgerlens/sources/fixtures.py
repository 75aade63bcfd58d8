"""Reconciliation tables derived from the shared Parquet tables.

``id = o_orderkey`` and ``acct = o_custkey`` map the order book onto a bank
ledger; events become exceptions, jobs, requests and auth events; suppliers
become import batches; customers become accounts and users.  Every table is
a lazily built DataFrame, so its work grows with the input tables.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.columns import add_hours, sha256_hex, sla_deadline, ts_lit
from ledgerlens.sources import tables as T
from ledgerlens.session import materialize, new_run_dir
from ledgerlens.sources.feeds import discrepancy_feed

_WRITTEN: dict[tuple, DataFrame] = {}

AS_OF = dt.datetime(2024, 2, 1, 0, 0, 0)
DELETED_AT = "2024-01-15 00:00:00"
BATCH_EPOCH = "2024-01-01 00:00:00"

# Fixed fixture mappings (event_type -> exception type / job type).
EVENT_EXCEPTION_TYPE = {
    "click": "MISSING_EXTERNAL",
    "view": "MISSING_INTERNAL",
    "error": "AMOUNT_MISMATCH",
    "purchase": "DUPLICATE",
    "signup": "TIMING",
}
EVENT_JOB_TYPE = {
    "click": "RECONCILIATION_RUN",
    "view": "REFRESH_SUMMARY",
    "error": "IMPORT_STATEMENT",
    "purchase": "ARCHIVE",
    "signup": "NOTIFY",
}
CURRENCIES = ["GBP", "EUR", "USD"]   # by acct % 3


def _map(d: dict, c) -> F.Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[c]


def _pick(values: list, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


class Fixtures:
    """All derived tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: dt.datetime = AS_OF,
                 hot_account: int | None = None, year_end: bool = False):
        """``hot_account``: move every ledger id with id % 3 = 0 to this
        account, so one account holds a third of all rows (skew fixture).
        ``year_end``: all of a year's ledger rows have its last day as value
        date and all lines are of batch 1 (run dates with many rows)."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.hot_account = hot_account
        self.year_end = year_end
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return T.read_table(self.spark, self.sf_dir, name)

    # -- accounts, ledger, statement ------------------------------------
    @cached_property
    def accounts(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("account_id"),
            F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("external_ref"),
            F.col("c_custkey").alias("client_id"),
            F.col("c_nationkey").cast("int").alias("branch_id"),
            _pick(CURRENCIES, F.col("c_custkey") % 3).alias("currency"),
            F.lit("ACTIVE").alias("status"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        o = self.raw("orders")
        idc, acct = F.col("o_orderkey"), F.col("o_custkey")
        if self.hot_account is not None:
            acct = F.when(idc % 3 == 0, F.lit(self.hot_account).cast("long")).otherwise(acct)
        ttype = (F.when(idc % 10 == 7, "FEE").when(idc % 10 == 8, "TAX").when(idc % 10 == 9, "REVERSAL")
                 .when(idc % 2 == 0, "CREDIT").otherwise("DEBIT"))
        return o.select(
            idc.alias("ledger_txn_id"), acct.alias("account_id"),
            F.concat(F.lit("LDG-"), idc.cast("string")).alias("txn_ref"),
            ttype.alias("txn_type"),
            F.col("o_totalprice").cast(S.MONEY).alias("amount"),
            _pick(CURRENCIES, acct % 3).alias("currency"),
            (F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)) if self.year_end else F.col("o_orderdate").cast("date")).alias("value_date"),
            F.lit(None).cast("long").alias("batch_id"),
        )

    @cached_property
    def external(self) -> DataFrame:
        """The statement table: the feed written once per session and scale
        factor (as a real statement table would be stored)."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.hot_account, self.year_end)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialize(discrepancy_feed(self.ledger, 1 if self.year_end else 10), "external",
                                        new_run_dir(self.spark, "statement"))
        return _WRITTEN[key]

    @cached_property
    def rules(self) -> DataFrame:
        return T.match_rules(self.spark)

    @cached_property
    def sources(self) -> DataFrame:
        return T.import_sources(self.spark)

    @cached_property
    def sla_rules(self) -> DataFrame:
        return T.sla_rules(self.spark)

    # -- people -----------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        role_id = (k % 4 + 1).cast("int")
        return c.select(
            k.cast("string").alias("user_id"),
            F.col("c_name").alias("full_name"),
            role_id.alias("role_id"),
            _map(S.ROLES, role_id).alias("role"),
            F.when(k % 50 == 7, ts_lit(DELETED_AT)).alias("deleted_at"),
        )

    # -- exceptions ---------------------------------------------------------
    @cached_property
    def exceptions(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        st = (eid % 6).cast("int")
        etype = _map(EVENT_EXCEPTION_TYPE, F.col("event_type"))
        created = T.as_timestamp("ts")
        resolved = F.when(st >= 3, add_hours(created, F.floor("value").cast("int")))
        return e.select(
            eid.alias("exception_id"),
            F.lit(1).cast("long").alias("run_id"),
            F.when(F.col("event_type") != "view", eid).alias("ledger_txn_id"),
            F.when(F.col("event_type").isin("view", "error"), eid * 10).alias("ext_line_id"),
            etype.alias("exception_type"),
            F.col("value").cast(S.MONEY).alias("amount_diff"),
            _pick(S.EXCEPTION_STATUSES, st).alias("status"),
            F.when(st > 0, F.col("user_id").cast("string")).alias("assigned_to"),
            (st + 1).alias("version"),
            created.alias("created_at"),
            resolved.alias("resolved_at"),
            F.when(st >= 4, add_hours(resolved, F.lit(2))).alias("approved_at"),
            F.when(st == 5, add_hours(resolved, F.lit(3))).alias("closed_at"),
            sla_deadline(created, etype).alias("sla_deadline"),
        )

    # -- import batches -------------------------------------------------------
    @cached_property
    def batches(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        status = F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "PROCESSING").otherwise("COMPLETED")
        return s.select(
            (k + 1).alias("batch_id"),
            (k % 4 + 1).cast("int").alias("source_id"),
            F.concat(F.col("s_name"), F.lit(".csv")).alias("file_name"),
            sha256_hex("s_name").alias("file_hash"),
            F.when(status == "COMPLETED", (k * 10).cast("int")).alias("row_count"),
            status.alias("status"),
            F.col("s_nationkey").cast("string").alias("imported_by"),
            F.when(status == "COMPLETED", add_hours(ts_lit(BATCH_EPOCH), k.cast("int"))).alias("completed_at"),
        )

    # -- reversal links ---------------------------------------------------------
    def reversal_links(self, which: int = 1) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("id"))
        cond = (F.col("id") % 7).isin(1, 2, 3) if which == 1 else (F.col("id") % 30 != 0)
        return o.filter(cond).select(F.col("id").alias("child_txn_id"), (F.col("id") - 1).alias("parent_txn_id"))

    # -- background jobs ----------------------------------------------------------
    def _job_base(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        return e.select(
            eid.alias("job_id"),
            _map(EVENT_JOB_TYPE, F.col("event_type")).alias("job_type"),
            _pick(S.JOB_STATUSES, eid % 6).alias("status"),
            F.to_json(F.struct(F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("workerId")))
            .alias("payload"),
            _pick([10, 20, 30], eid % 3).cast("int").alias("priority"),
            (eid % 4).cast("int").alias("attempts"),
            F.lit(3).alias("max_attempts"),
            T.as_timestamp("ts").alias("run_at"),
            T.as_timestamp("ts").alias("created_at"),
            T.as_timestamp("ts").alias("last_heartbeat"),
            F.when((eid % 6).isin(1, 2, 3), T.as_timestamp("ts")).alias("started_at"),
            F.when(eid % 6 == 2, add_hours(T.as_timestamp("ts"), F.lit(1))).alias("completed_at"),
            F.when(eid % 6 == 3, F.lit("handler failed")).alias("error_message"),
            F.when(eid % 6 == 1, F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string"))).alias("worker_owner"),
            ((eid % 6 == 3) & (eid % 4 == 3)).alias("_dead"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return self._job_base().filter(~F.col("_dead")).drop("_dead")

    @cached_property
    def dead_letters(self) -> DataFrame:
        b = self._job_base().filter(F.col("_dead"))
        return b.select("job_id", "job_type", "payload", "priority", "attempts",
                        F.lit("max attempts reached").alias("last_error"),
                        add_hours("created_at", F.lit(1)).alias("failed_at"))

    # -- request / auth logs ----------------------------------------------------------
    @cached_property
    def requests(self) -> DataFrame:
        """API request log: idempotency key = user + event type + day."""
        e = self.raw("events")
        ts = T.as_timestamp("ts")
        return e.select(
            F.col("event_id").alias("request_id"),
            F.when(F.col("event_id") % 31 != 0, (F.col("user_id") % 20).cast("string")).alias("user_id"),
            _pick(["GET", "PATCH", "PATCH", "POST", "PATCH", "PUT", "PATCH", "DELETE"], F.col("event_id") % 8).alias("method"),
            F.concat(F.lit("/api/exceptions/"), F.col("event_type")).alias("path"),
            F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 29 == 0, F.lit(""))
            .otherwise(F.concat_ws(":", F.col("event_type"), F.date_format(ts, "yyyy-MM-dd"))).alias("idempotency_key"),
            ts.alias("ts"),
            add_hours(ts, F.lit(0)).alias("started_at"),
            F.timestamp_add("SECOND", (F.col("event_id") % 7).cast("int"), ts).alias("finished_at"),
            F.when(F.col("event_id") % 13 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
            F.col("event_type"),
        )

    @cached_property
    def bursts(self) -> DataFrame:
        """Clients that go over the rate limits: some events stand for many requests of one moment."""
        e, eid = self.raw("events"), F.col("event_id")
        n = F.when(eid % 2500 == 3, 301).when(eid % 250 == 7, 11)
        return e.filter(n.isNotNull()).select(
            F.concat(F.lit("burst-"), eid.cast("string")).alias("user_id"), T.as_timestamp("ts").alias("ts"), "event_type",
            F.explode(F.sequence(F.lit(1), n)).alias("k"))

    @cached_property
    def schedules(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").select(n.alias("schedule_id"), F.col("n_name").alias("name"), (n % 3 != 0).alias("is_active"))

    @cached_property
    def auth_events(self) -> DataFrame:
        e = self.raw("events").filter(F.col("event_type").isin("error", "signup"))
        return e.select(
            F.col("event_id"),
            F.col("user_id").cast("string").alias("user_id"),
            T.as_timestamp("ts").alias("ts"),
            (F.col("event_type") == "signup").alias("success"),
        )

    # -- staged uploads (all strings, with deterministic defects) ----------------
    @cached_property
    def statement_file(self) -> DataFrame:
        """A statement upload built from the feed: negative and unparsable
        amounts, bad currency codes, unknown accounts, duplicate refs, blank
        dates and flags in several spellings."""
        x = self.external
        k = F.col("ext_line_id")
        amt = F.col("amount").cast("string")
        return x.select(
            F.when(k % 101 == 0, F.concat(F.lit("EXT-DUP-"), (k % 7).cast("string")))
            .otherwise(F.col("external_ref")).alias("external_ref"),
            F.when(k % 103 == 0, F.concat(F.lit("ACC-X"), (k % 13).cast("string")))
            .otherwise(F.col("account_ref")).alias("account_ref"),
            F.when(k % 97 == 0, F.concat(F.lit("-"), amt)).when(k % 107 == 0, F.lit("n/a")).otherwise(amt)
            .alias("amount"),
            F.when(k % 109 == 0, F.lit("G1P")).when(k % 113 == 0, F.lower("currency")).otherwise(F.col("currency"))
            .alias("currency"),
            F.when(k % 127 == 0, F.lit(None).cast("string"))
            .otherwise(F.date_format("value_date", "yyyy-MM-dd")).alias("value_date"),
            F.date_format("settlement_date", "yyyy-MM-dd").alias("settlement_date"),
            F.when(F.col("is_batched_settlement"), F.when(k % 2 == 0, F.lit("TRUE")).otherwise(F.lit("true")))
            .when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("false")).alias("is_batched_settlement"),
        )

    @cached_property
    def ledger_file(self) -> DataFrame:
        """A ledger upload built from the order book with defects."""
        o = self.ledger
        i = F.col("ledger_txn_id")
        amt = F.col("amount").cast("string")
        return o.select(
            F.when(i % 211 == 0, F.concat(F.lit("NEW-DUP-"), (i % 5).cast("string")))
            .when(i % 157 == 0, F.col("txn_ref"))
            .otherwise(F.concat(F.lit("NEW-"), i.cast("string"))).alias("txn_ref"),
            F.when(i % 199 == 0, F.lit("ACC-UNKNOWN")).otherwise(F.concat(F.lit("ACC-"), F.col("account_id")
                                                                          .cast("string"))).alias("account_ref"),
            F.when(i % 193 == 0, F.lit("REFUND")).otherwise(F.col("txn_type")).alias("txn_type"),
            F.when(i % 191 == 0, F.concat(F.lit("-"), amt)).when(i % 181 == 0, F.lit("x")).otherwise(amt)
            .alias("amount"),
            F.lower("currency").alias("currency"),
            F.when(i % 179 == 0, F.lit(None).cast("string"))
            .otherwise(F.date_format("value_date", "yyyy-MM-dd")).alias("value_date"),
            F.when(i % 173 == 0, F.repeat(F.lit("c"), 151)).when(i % 2 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("CP "), (i % 50).cast("string"))).alias("counterparty"),
            F.when(i % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("order book")).alias("narrative"),
        )

    # -- workflow action log, notifications, reads ----------------------------------
    @cached_property
    def fresh_exceptions(self) -> DataFrame:
        """Exceptions as a run creates them (UNASSIGNED, version 1)."""
        return self.raw("events").select(F.col("event_id").alias("exception_id"), F.lit("UNASSIGNED").alias("status"),
                                         F.lit(1).alias("version"), F.lit(None).cast("string").alias("assigned_to"))

    @cached_property
    def actions(self) -> DataFrame:
        """assign -> start -> resolve (-> stale resolve) (-> analyst approve)
        -> approve -> close per exception; the analyst is the event's user."""
        e = self.raw("events").select("event_id", F.col("user_id").cast("string").alias("u"), T.as_timestamp("ts")
                                      .alias("ts"))
        roles = self.users.select(F.col("user_id").alias("u"), F.col("role").alias("u_role"))
        e = e.join(roles, "u", "left")
        eid = F.col("event_id")
        null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")
        u, ur = F.col("u"), F.col("u_role")

        def act(seq, action, actor, role, expected, assign_to, note, cond=None):
            a = F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(action).alias("action"), actor.alias("actor"),
                         role.alias("actor_role"), expected.cast("int").alias("expected_version"),
                         assign_to.alias("assign_to"), note.alias("note"))
            return a if cond is None else F.when(cond, a)

        # one scan of the events: every action of an exception as an array element
        acts = F.array(
            act(1, "assign", F.lit("1"), F.when(eid % 23 == 0, null_s).otherwise(F.lit("ADMIN")), null_i, u, null_s),
            act(2, "start", u, ur, null_i, null_s, null_s),
            act(3, "resolve", u, ur, F.when(eid % 19 == 0, null_i).otherwise(F.lit(3)), null_s,
                F.when(eid % 7 == 0, F.lit("ok")).otherwise(F.lit("matched to statement"))),
            act(4, "resolve", u, ur, F.lit(3), null_s, F.lit("late retry"), eid % 4 == 0),
            act(5, "approve", F.lit("3"), F.when(eid % 10 == 0, null_s).otherwise(F.lit("ANALYST")), F.lit(4), null_s, null_s, eid % 5 == 0),
            act(6, "approve", F.lit("1"), F.lit("ADMIN"), F.when(eid % 17 == 0, null_i).otherwise(F.lit(4)), null_s, null_s),
            act(7, "close", F.lit("1"), F.lit("ADMIN"), F.lit(5), null_s, null_s),
        )
        out = (e.select(eid.alias("exception_id"), "ts", F.explode(acts).alias("a")).filter(F.col("a").isNotNull())
               .select("exception_id", "a.*", F.col("ts")))
        return out.withColumn("acted_at", F.timestamp_add("HOUR", F.col("seq"), F.col("ts"))).drop("ts")

