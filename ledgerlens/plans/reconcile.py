"""The reconciliation run as one DataFrame job.

Order: exact -> tolerance -> batched -> exceptions; each pass excludes what
earlier passes matched.  Every pass result is written once as Parquet under
a fresh run folder in the shared checkpoint location (``materialize``):
plans stay one pass deep, later passes anti-join small written tables, and
a lost executor recomputes from those files, not from earlier passes.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.config import MatchConfig
from ledgerlens.functions.columns import ts_lit
from ledgerlens.operators import matching as M
from ledgerlens.session import materialize, new_run_dir


@dataclass
class ReconResult:
    exact: DataFrame            # (ledger_txn_id, ext_line_id, amount_diff, day_diff)
    tolerance: DataFrame        # (+ confidence_score)
    batched: DataFrame          # (ext_line_id, ledger_txn_id)
    groups: DataFrame           # match_groups
    ledger_lines: DataFrame     # (match_id, ledger_txn_id)
    external_lines: DataFrame   # (match_id, ext_line_id)
    exceptions: DataFrame       # new exceptions of this run
    run: DataFrame              # one row of run totals
    run_dir: str


def scope_inputs(led: DataFrame, ext: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """J1 scope: ledger of the run date, lines of the batch.  J2: everything."""
    if cfg.run_date is not None:
        led = led.filter(F.col("value_date") == F.lit(cfg.run_date))
    if cfg.batch_id is not None:
        ext = ext.filter(F.col("batch_id") == F.lit(cfg.batch_id))
    return led, ext


def reconcile(led: DataFrame, ext: DataFrame, acc: DataFrame, rules: DataFrame | None,
              cfg: MatchConfig = MatchConfig(),
              ledger_bridge: DataFrame | None = None, ext_bridge: DataFrame | None = None,
              prior_exceptions: DataFrame | None = None, run_dir: str | None = None) -> ReconResult:
    """Run the three passes and raise exceptions for the rest.

    ``ledger_bridge``/``ext_bridge``: ids matched by earlier runs (any group
    status).  ``prior_exceptions``: exceptions of earlier runs.
    """
    spark = led.sparkSession
    run_dir = run_dir or new_run_dir(spark, f"recon-{cfg.run_id}")
    led_s, ext_s = scope_inputs(led, ext, cfg)

    # prepared sides (id, account, currency, amount, date), written once: all
    # passes read them, and none takes over the account join's distribution
    rule = materialize(M.first_rule(rules if rules is not None else config_rules(spark, cfg), "TOLERANCE"), "rule", run_dir)
    L0 = materialize(M.exclude_matched(M.ledger_side(led_s, acc), ledger_bridge, "ledger_txn_id"), "ledger_side", run_dir)
    E0 = materialize(M.exclude_matched(M.external_side(_reachable(ext_s, rule, cfg), acc), ext_bridge, "ext_line_id"),
                     "external_side", run_dir)

    exact, L1, E1 = _rounds(lambda l, e: M.exact_matches(l, e, cfg.exact_window_days), L0, E0, cfg.rounds,
                            "pass1_exact", run_dir)
    tol, L2, E2 = _rounds(lambda l, e: M.tolerance_matches(l, e, rule), L1, E1, cfg.rounds,
                          "pass2_tolerance", run_dir)

    batched = materialize(M.batch_matches(L2, E2, cfg.same_currency_batches), "pass3_batched", run_dir)

    groups, ledger_lines, external_lines = match_groups(exact, tol, batched, cfg.run_id)

    new_lb = ledger_lines.select("ledger_txn_id")
    new_eb = external_lines.select("ext_line_id")
    lb = new_lb if ledger_bridge is None else new_lb.unionByName(ledger_bridge.select("ledger_txn_id"))
    eb = new_eb if ext_bridge is None else new_eb.unionByName(ext_bridge.select("ext_line_id"))
    ext_exc = ext_s if cfg.run_date is None else ext_s.filter(F.col("value_date") == F.lit(cfg.run_date))
    created = ts_lit(cfg.as_of)
    exc = M.unmatched(led_s, ext_exc, lb, eb, prior_exceptions, cfg.run_id, created)
    if cfg.classify_breaks:
        exc = _with_break_types(exc, led_s, ext_s, acc, lb, eb, rules, spark, cfg)
    exceptions = materialize(exc, "exceptions", run_dir)

    run = run_totals(led_s, ext_exc, groups, exceptions, cfg)
    return ReconResult(exact, tol, batched, groups, ledger_lines, external_lines, exceptions, run, run_dir)


def _reachable(ext_s: DataFrame, rule: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The lines that a run date's ledger rows can match: those inside the wider
    of the two passes' windows, and flagged ones of any date."""
    if cfg.run_date is None:
        return ext_s
    got = rule.select("date_window_days").first()
    days = max(cfg.exact_window_days, int(got[0]) if got else 0)
    low, high = cfg.run_date - dt.timedelta(days=days), cfg.run_date + dt.timedelta(days=days)
    return ext_s.filter(F.col("value_date").between(F.lit(low), F.lit(high)) | F.col("is_batched_settlement"))


def config_rules(spark, cfg: MatchConfig) -> DataFrame:
    """A rules table from the config when none is given: one TOLERANCE rule
    from ``cfg.tolerance`` / ``cfg.tolerance_window_days`` (none -> no
    tolerance pass)."""
    from ledgerlens.sources.tables import match_rules
    rows = []
    if cfg.tolerance is not None:
        rows.append((1, "config tolerance", "TOLERANCE", str(cfg.tolerance),
                     cfg.tolerance_window_days if cfg.tolerance_window_days is not None else 0, 1))
    return match_rules(spark, rows)


def _with_break_types(exc: DataFrame, led_s: DataFrame, ext_s: DataFrame, acc: DataFrame, lb: DataFrame,
                      eb: DataFrame, rules: DataFrame | None, spark, cfg: MatchConfig) -> DataFrame:
    """Replace MISSING_* by the classified type (and fill amount_diff);
    the window is the tolerance rule's."""
    from ledgerlens.operators.classify import classify_breaks
    from ledgerlens.functions.columns import sla_deadline
    r = M.first_rule(rules if rules is not None else config_rules(spark, cfg), "TOLERANCE").first()
    window = int(r["date_window_days"]) if r else cfg.exact_window_days
    kinds = classify_breaks(M.ledger_side(led_s, acc), M.external_side(ext_s, acc), lb, eb, window)
    kl = kinds.filter(F.col("ledger_txn_id").isNotNull()).select(
        "ledger_txn_id", F.col("exception_type").alias("k_type"), F.col("amount_diff").alias("k_diff"))
    ke = kinds.filter(F.col("ext_line_id").isNotNull()).select(
        "ext_line_id", F.col("exception_type").alias("k_type2"), F.col("amount_diff").alias("k_diff2"))
    out = exc.join(kl, "ledger_txn_id", "left").join(ke, "ext_line_id", "left")
    typ = F.coalesce("k_type", "k_type2", "exception_type")
    return (out.withColumn("exception_type", typ)
            .withColumn("amount_diff", F.coalesce("k_diff", "k_diff2", "amount_diff").cast(S.MONEY))
            .withColumn("sla_deadline", sla_deadline(F.col("created_at"), F.col("exception_type")))
            .drop("k_type", "k_type2", "k_diff", "k_diff2"))


def _rounds(pass_fn, led: DataFrame, ext: DataFrame, rounds: int, name: str, run_dir: str):
    """Run a 1:1 pass ``rounds`` times; each round sees only rows left
    unmatched by the earlier rounds (round 1 alone is the reference).
    -> (all matches, remaining ledger, remaining lines)."""
    found = None
    for r in range(max(1, rounds)):
        m = materialize(pass_fn(led, ext), name if r == 0 else f"{name}_round{r + 1}", run_dir)
        found = m if found is None else found.unionByName(m)
        led = M.exclude_matched(led, m, "ledger_txn_id")
        ext = M.exclude_matched(ext, m, "ext_line_id")
    return found, led, ext


def match_groups(exact: DataFrame, tol: DataFrame, batched: DataFrame, run_id: int):
    """One group per external line (a line is in at most one group, so
    ``match_id = ext_line_id`` is unique and deterministic) + two bridges."""
    g1 = exact.select("ext_line_id", F.lit(100).cast(S.CONFIDENCE).alias("confidence_score"),
                      F.lit("EXACT").alias("pass_name"))
    g2 = tol.select("ext_line_id", "confidence_score", F.lit("TOLERANCE").alias("pass_name"))
    g3 = batched.select("ext_line_id").distinct().select(
        "ext_line_id", F.lit(100).cast(S.CONFIDENCE).alias("confidence_score"), F.lit("BATCH").alias("pass_name"))
    groups = (g1.unionByName(g2).unionByName(g3)
              .select(F.col("ext_line_id").alias("match_id"), F.lit(run_id).cast("long").alias("run_id"),
                      F.lit(None).cast("int").alias("rule_id"), F.lit("AUTO").alias("match_type"),
                      "confidence_score", F.lit("CONFIRMED").alias("status"), "pass_name"))
    ledger_lines = (exact.select("ext_line_id", "ledger_txn_id")
                    .unionByName(tol.select("ext_line_id", "ledger_txn_id"))
                    .unionByName(batched.select("ext_line_id", "ledger_txn_id"))
                    .select(F.col("ext_line_id").alias("match_id"), "ledger_txn_id"))
    external_lines = groups.select("match_id", F.col("match_id").alias("ext_line_id"))
    return groups, ledger_lines, external_lines


def run_totals(led_s: DataFrame, ext_s: DataFrame, groups: DataFrame, exceptions: DataFrame,
               cfg: MatchConfig) -> DataFrame:
    """Ledger rows in scope, lines in scope, matched *groups*, exceptions."""
    tagged = (led_s.select(F.lit("i").alias("t")).unionByName(ext_s.select(F.lit("e").alias("t")))
              .unionByName(groups.select(F.lit("m").alias("t")))
              .unionByName(exceptions.select(F.lit("x").alias("t"))))
    return (tagged.agg(*[F.count_if(F.col("t") == k).alias(n) for k, n in
                         [("i", "total_internal"), ("e", "total_external"), ("m", "matched_count"),
                          ("x", "exception_count")]])
            .select(F.lit(cfg.run_id).cast("long").alias("run_id"),
                    (F.lit(cfg.run_date) if cfg.run_date else F.lit(None)).cast("date").alias("run_date"),
                    F.lit("COMPLETED").alias("status"),
                    F.col("total_internal").cast("long"), F.col("total_external").cast("long"),
                    F.col("matched_count").cast("long"), F.col("exception_count").cast("long")))


def runs_by_date(led: DataFrame, ext: DataFrame, res: ReconResult) -> DataFrame:
    """One run row per ledger value date from a global run (fixture for run
    history and the auto-match KPI).  A group's date is its earliest ledger
    row's date; MISSING_INTERNAL exceptions count on the line's date."""
    gdate = (res.ledger_lines.join(led.select("ledger_txn_id", "value_date"), "ledger_txn_id")
             .groupBy("match_id").agg(F.min("value_date").alias("run_date")))
    matched = gdate.groupBy("run_date").agg(F.count(F.lit(1)).alias("matched_count"))
    exc_l = (res.exceptions.filter(F.col("ledger_txn_id").isNotNull())
             .join(led.select("ledger_txn_id", F.col("value_date").alias("run_date")), "ledger_txn_id"))
    exc_e = (res.exceptions.filter(F.col("ext_line_id").isNotNull())
             .join(ext.select("ext_line_id", F.col("value_date").alias("run_date")), "ext_line_id"))
    excs = (exc_l.select("run_date").unionByName(exc_e.select("run_date"))
            .groupBy("run_date").agg(F.count(F.lit(1)).alias("exception_count")))
    internal = led.groupBy(F.col("value_date").alias("run_date")).agg(F.count(F.lit(1)).alias("total_internal"))
    external = ext.groupBy(F.col("value_date").alias("run_date")).agg(F.count(F.lit(1)).alias("total_external"))
    out = (internal.join(external, "run_date", "left").join(matched, "run_date", "left")
           .join(excs, "run_date", "left"))
    return out.select(
        F.date_format("run_date", "yyyyMMdd").cast("long").alias("run_id"), "run_date",
        F.lit("COMPLETED").alias("status"),
        F.col("total_internal").cast("long"),
        F.coalesce("total_external", F.lit(0)).cast("long").alias("total_external"),
        F.coalesce("matched_count", F.lit(0)).cast("long").alias("matched_count"),
        F.coalesce("exception_count", F.lit(0)).cast("long").alias("exception_count"),
        (F.dayofmonth("run_date") % 5).cast("string").alias("triggered_by"),
        F.timestamp_add("HOUR", F.lit(18), F.col("run_date").cast("timestamp")).alias("started_at"))
