"""Matching passes D1-D5 with mutual-best ranking (F1) and running sums (F2).

Design (all set-based, no pair explosion inside hot accounts):

* Rows of one side that share (account, currency, amount, value_date) have
  the same candidate partners, so each side is first reduced to one row per
  such key carrying its smallest id (a partial aggregation, map-side
  combined).  Only the smallest id of a key can ever be somebody's best
  partner, because ranks break ties on the other side's id.
* In the exact pass the date becomes an equi key by blocks of days: a ledger
  key goes to the one or two blocks that its window touches, so it is hardly
  ever copied, and meets at most a block's days of the same amount.
* The tolerance band is searched without pairs: a key probes the dates of its
  window that the other side has, and running frames by amount over each (account, currency, date)
  yield the nearest other-side amount below and above -- the only possible
  best partners, since the band test is monotone in the distance.  A hot
  account's frames are cut into ranges of amounts (``running.Pieces``).
* Mutual best = ``min(struct(distance, other_id))`` per side over the
  candidate set, then an equi join of the two "best" lists on both ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.columns import tolerance_confidence
from ledgerlens.operators import running
from ledgerlens.operators.running import Pieces, salted_join
from ledgerlens.session import materialize

KEY = ["account_id", "currency"]


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------

def ledger_side(led: DataFrame, acc: DataFrame) -> DataFrame:
    """Ledger rows whose account exists, narrowed to the matching columns."""
    rows = led.select("ledger_txn_id", "account_id", "currency", "amount", "value_date")
    return salted_join(rows, acc, "account_id", "ledger_txn_id", [])


def external_side(ext: DataFrame, acc: DataFrame, flagged_only: bool = False) -> DataFrame:
    """Statement lines resolved to an account through ``account_ref``."""
    e = ext
    if flagged_only:
        e = e.filter(F.col("is_batched_settlement"))
    a = acc.select(F.col("external_ref").alias("account_ref"), "account_id")
    rows = e.select("ext_line_id", "account_ref", "currency", "amount", "value_date", "is_batched_settlement")
    return salted_join(rows, a, "account_ref", "ext_line_id", ["account_id"]).drop("account_ref")


def exclude_matched(df: DataFrame, bridge: DataFrame | None, key: str) -> DataFrame:
    """Drop rows already in a match bridge (NOT IN == anti join: keys are NOT NULL)."""
    if bridge is None:
        return df
    return df.join(bridge.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def first_rule(rules: DataFrame, rule_type: str) -> DataFrame:
    """First active rule of a type by priority (tie: rule_id); 0 or 1 row."""
    r = rules.filter((F.col("rule_type") == rule_type) & F.col("is_active"))
    best = r.agg(F.min(F.struct("priority", "rule_id")).alias("b")).filter(F.col("b").isNotNull())
    return (best.select(F.col("b.rule_id").alias("rule_id"))
            .join(r, "rule_id")
            .select("rule_id", "amount_tolerance", "date_window_days"))


# ---------------------------------------------------------------------------
# Mutual best over a candidate set
# ---------------------------------------------------------------------------

def _mutual_best(cand: DataFrame, dist: str, carry: list[str] = ()) -> DataFrame:
    """cand(l_id, e_id, <dist>, *carry) -> pairs where each side ranks the other
    first, with the pair's distance and carried columns.

    Ranking: smallest distance, ties to the smaller id of the other side.
    """
    lbest = (cand.groupBy("l_id").agg(F.min(F.struct(dist, "e_id", *carry)).alias("b"))
             .select("l_id", "b.*"))
    ebest = (cand.groupBy("e_id").agg(F.min(F.struct(dist, "l_id")).alias("b"))
             .select("e_id", F.col("b.l_id").alias("l_id")))
    return lbest.join(ebest, ["l_id", "e_id"])


def _keys(df: DataFrame, id_col: str, alias: str) -> DataFrame:
    cols = KEY + ["amount", "value_date"]
    return df.groupBy(*cols).agg(F.min(id_col).alias(alias))


# ---------------------------------------------------------------------------
# D1 exact
# ---------------------------------------------------------------------------

#: Keys of the same account, currency and amount meet in blocks of so many days.
EXACT_BLOCK_DAYS = 32


def exact_matches(led: DataFrame, ext: DataFrame, window_days: int = 2) -> DataFrame:
    """D1 + F1.  led/ext: the prepared sides (see ``ledger_side``/``external_side``).

    -> (ledger_txn_id, ext_line_id, amount_diff, day_diff)
    """
    lk = _keys(led, "ledger_txn_id", "l_id")
    ek = _keys(ext, "ext_line_id", "e_id").withColumnRenamed("value_date", "e_date")
    size = max(EXACT_BLOCK_DAYS, 2 * window_days)
    block = lambda day: F.floor(day / size)
    day = F.unix_date("value_date")
    # each ledger key once, or twice if its window reaches into the next block
    probe = lk.withColumn("block", F.explode(F.sequence(block(day - window_days), block(day + window_days))))
    lines = ek.withColumn("block", block(F.unix_date("e_date")))
    cand = (probe.join(lines, KEY + ["amount", "block"])
            .select("l_id", "e_id", F.abs(F.datediff("e_date", "value_date")).alias("day_diff"))
            .filter(F.col("day_diff") <= window_days))
    pairs = _mutual_best(materialize(cand, "exact_candidates"), "day_diff")
    return pairs.select(F.col("l_id").alias("ledger_txn_id"), F.col("e_id").alias("ext_line_id"),
                        F.lit(0).cast(S.MONEY).alias("amount_diff"), F.col("day_diff").cast("int").alias("day_diff"))


# ---------------------------------------------------------------------------
# D2 tolerance
# ---------------------------------------------------------------------------

CELL = KEY + ["cdate"]


def _nearest(probes: DataFrame, cells: DataFrame, probe_id: str, cell_id: str, even: bool = False) -> DataFrame:
    """For every probe row, the cell rows nearest below-or-equal and above in
    amount with the same (account, currency, date):
    probes(acct.., cdate, amt, probe_id, off) x cells(acct.., cdate, amt, cell_id)
    -> (probe_id, off, probe_amt, cand_amt, cell_id); at most two per probe row.
    Running frames over the union by amount -- no pairs are formed, and a hot
    (account, currency, date) is cut into ranges of amounts (``Pieces``, as is ``even``)."""
    u = (cells.select(*CELL, "amt", F.col(cell_id).alias("cid"), F.lit(None).cast("long").alias("pid"),
                      F.lit(None).cast("int").alias("off"), F.lit(0).alias("kind"))
         .unionByName(probes.select(*CELL, "amt", F.lit(None).cast("long").alias("cid"),
                                    F.col(probe_id).alias("pid"), F.col("off").cast("int"), F.lit(1).alias("kind"))))
    pieces = Pieces(u, CELL, "amt", even=even)
    cell = F.when(F.col("kind") == 0, F.struct(F.col("amt").alias("a"), F.col("cid").alias("id")))
    # the last cell row before the probe by rising amount, and by falling
    # amount (there, equal amounts come after it)
    near = pieces.last(pieces.rows, cell, ["amt", "kind"], "b")
    near = pieces.last(near, cell, ["amt", "kind"], "c", descending=True).filter(F.col("kind") == 1)
    return (near.select(F.col("pid").alias(probe_id), "off", F.col("amt").alias("probe_amt"), F.explode(F.array("b", "c")).alias("n"))
            .filter(F.col("n").isNotNull())
            .select(probe_id, "off", "probe_amt", F.col("n.a").alias("cand_amt"), F.col("n.id").alias(cell_id)))


def tolerance_matches(led: DataFrame, ext: DataFrame, rule: DataFrame) -> DataFrame:
    """D2 + F1 + D9.  ``rule``: 0/1 row (rule_id, amount_tolerance, date_window_days).

    Candidate: same account and currency, |d_l - d_e| <= window and
    |a_l - a_e| <= a_l * tolerance.  Rank by |a_l - a_e| (ties: the other
    side's id).  No rule -> no rows.

    Each side's best partner is found without forming pairs: a key probes the
    2w+1 dates of its window, and running frames by amount give the nearest
    other-side amounts of each date, below-or-equal and above.  The band test is
    monotone in the distance, so if the nearest amount on a side fails it,
    every farther one fails too: the best partner is always one of those.
    -> (ledger_txn_id, ext_line_id, amount_diff, day_diff, confidence_score)
    """
    got = rule.select("amount_tolerance", "date_window_days").limit(1).collect()
    if not got:
        return led.sparkSession.createDataFrame(
            [], "ledger_txn_id long, ext_line_id long, amount_diff decimal(18,2), day_diff int, "
                "confidence_score decimal(5,2)")
    tol_d, win = got[0]["amount_tolerance"], int(got[0]["date_window_days"])
    tol = F.lit(tol_d).cast(S.TOLERANCE)
    # each side's keys are probes and cells: written once, read twice
    lk = materialize(_keys(led, "ledger_txn_id", "l_id").withColumnRenamed("amount", "l_amount"), "ledger_keys")
    ek = materialize(_keys(ext, "ext_line_id", "e_id").withColumnRenamed("amount", "e_amount"), "line_keys")
    offsets = F.explode(F.sequence(F.lit(-win), F.lit(win)))
    # a date of an account and currency has at most one row of each of its keys
    sizes = lk.select(*KEY).unionByName(ek.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    even = (sizes.agg(F.max("n")).first()[0] or 0) <= running.LEAST_ROWS

    def near(side: DataFrame, other: DataFrame, own: str, theirs: str) -> DataFrame:
        # a date on which the other side has nothing isn't probed: a run date's ledger
        # is of one date (the table of dates is bounded by the calendar)
        there = F.broadcast(other.select(F.col("value_date").alias("there")).distinct())
        probes = (side.withColumn("off", offsets).withColumn("cdate", F.date_add("value_date", F.col("off")))
                  .join(there, F.col("cdate").eqNullSafe(F.col("there")), "left_semi")
                  .withColumn("amt", F.col(f"{own}_amount")))
        cells = other.withColumn("cdate", F.col("value_date")).withColumn("amt", F.col(f"{theirs}_amount"))
        return (_nearest(probes, cells, f"{own}_id", f"{theirs}_id", even)
                .withColumnsRenamed({"probe_amt": f"{own}_amount", "cand_amt": f"{theirs}_amount"}))

    lnear, enear = near(lk, ek, "l", "e"), near(ek, lk, "e", "l")

    diff = F.abs(F.col("l_amount") - F.col("e_amount"))
    in_band = diff <= F.col("l_amount") * tol
    lc = lnear.filter(in_band).select("l_id", "e_id", diff.alias("amount_diff"), F.abs("off").alias("day_diff"))
    ec = enear.filter(in_band).select("l_id", "e_id", diff.alias("amount_diff"))
    lbest = (lc.groupBy("l_id").agg(F.min(F.struct("amount_diff", "e_id", "day_diff")).alias("b"))
             .select("l_id", "b.*"))
    ebest = (ec.groupBy("e_id").agg(F.min(F.struct("amount_diff", "l_id")).alias("b"))
             .select("e_id", F.col("b.l_id").alias("l_id")))
    pairs = lbest.join(ebest, ["l_id", "e_id"])
    return pairs.select(F.col("l_id").alias("ledger_txn_id"), F.col("e_id").alias("ext_line_id"),
                        F.col("amount_diff").cast(S.MONEY).alias("amount_diff"),
                        F.col("day_diff").cast("int").alias("day_diff"),
                        tolerance_confidence(F.col("amount_diff")).alias("confidence_score"))


# ---------------------------------------------------------------------------
# D3 batched settlement
# ---------------------------------------------------------------------------

def running_totals(led: DataFrame, chunk_bits: int = 20) -> DataFrame:
    """F2 as a chunked prefix sum.  The order is (value_date, ledger_txn_id)
    per account; a chunk is (account, value_date, id >> chunk_bits), so chunks
    follow that order and none holds more than 2^chunk_bits rows.  Running
    sum = sum inside the chunk + total of the account's earlier chunks (a
    window over per-chunk totals, not over rows).  Same result as one window
    over the whole account, but no task needs a whole account or account-day.
    """
    c = led.withColumn("chunk", F.shiftright("ledger_txn_id", chunk_bits))
    wrow = (Window.partitionBy("account_id", "value_date", "chunk").orderBy("ledger_txn_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = c.withColumn("chunk_run", F.sum("amount").over(wrow))
    totals = c.groupBy("account_id", "value_date", "chunk").agg(F.sum("amount").alias("chunk_total"))
    wchunk = (Window.partitionBy("account_id").orderBy("value_date", "chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = totals.withColumn("before", F.coalesce(F.sum("chunk_total").over(wchunk), F.lit(0)))
    return (inner.join(before.select("account_id", "value_date", "chunk", "before"),
                       ["account_id", "value_date", "chunk"])
            .withColumn("running_total", (F.col("before") + F.col("chunk_run")).cast("decimal(38,2)"))
            .drop("before", "chunk_run", "chunk"))


def batch_matches(led: DataFrame, ext: DataFrame, same_currency: bool = False) -> DataFrame:
    """D3.  led: prepared unmatched ledger; ext: prepared unmatched lines.

    Per account, the smallest flagged ``ext_line_id`` whose amount equals a
    running total R_k of the account's unmatched rows (order value_date, id)
    takes every row with R_k <= amount; at most one line per account matches
    in a run (amounts are positive, so a later line would need a used row).
    -> (ext_line_id, ledger_txn_id)
    """
    lines = materialize(ext.filter(F.col("is_batched_settlement"))
                        .select("ext_line_id", "account_id", F.col("amount").alias("total"),
                                F.col("currency").alias("line_currency")), "flagged_lines")
    cand_led = salted_join(led, lines.select("account_id").distinct(), "account_id", "ledger_txn_id", [])
    if same_currency:
        cand_led = cand_led.join(lines.select("account_id", F.col("line_currency").alias("currency")).distinct(),
                                 ["account_id", "currency"], "left_semi")
    # written before and after the windows, so that these deal the rows out by
    # (account, date, chunk) and are computed once for the three reads below
    rt = materialize(running_totals(materialize(cand_led, "batch_ledger")), "running_totals")
    hit_cond = [rt.account_id == lines.account_id, rt.running_total == lines.total]
    if same_currency:
        hit_cond.append(rt.currency == lines.line_currency)
    hits = (rt.join(lines, hit_cond).groupBy(rt.account_id)
            .agg(F.min("ext_line_id").alias("ext_line_id")))
    winners = materialize(hits.join(lines.select("ext_line_id", "total"), "ext_line_id"), "winners")
    members = salted_join(rt, winners, "account_id", "ledger_txn_id", ["ext_line_id", "total"]) \
        .filter(F.col("running_total") <= F.col("total"))
    if same_currency:
        members = members.join(lines.select("ext_line_id", "line_currency"), "ext_line_id") \
            .filter(F.col("currency") == F.col("line_currency"))
    return members.select("ext_line_id", "ledger_txn_id")


# ---------------------------------------------------------------------------
# D5 unmatched -> exceptions
# ---------------------------------------------------------------------------

def unmatched(led: DataFrame, ext: DataFrame, ledger_bridge: DataFrame, ext_bridge: DataFrame,
              prior_exceptions: DataFrame | None, run_id: int, created_at) -> DataFrame:
    """D5 + H2: MISSING_EXTERNAL for unmatched ledger rows, MISSING_INTERNAL for
    unmatched lines; rows that already carry an exception are skipped.

    exception_id is deterministic and collision free: a row gets at most one
    exception ever, so 2*ledger_txn_id / 2*ext_line_id+1 identify it.
    """
    l = exclude_matched(led.select("ledger_txn_id"), ledger_bridge, "ledger_txn_id")
    e = exclude_matched(ext.select("ext_line_id"), ext_bridge, "ext_line_id")
    if prior_exceptions is not None:
        l = exclude_matched(l, prior_exceptions.select("ledger_txn_id"), "ledger_txn_id")
        e = exclude_matched(e, prior_exceptions.select("ext_line_id"), "ext_line_id")
    me = l.select((F.col("ledger_txn_id") * 2).alias("exception_id"), "ledger_txn_id",
                  F.lit(None).cast("long").alias("ext_line_id"), F.lit("MISSING_EXTERNAL").alias("exception_type"))
    mi = e.select((F.col("ext_line_id") * 2 + 1).alias("exception_id"), F.lit(None).cast("long").alias("ledger_txn_id"),
                  "ext_line_id", F.lit("MISSING_INTERNAL").alias("exception_type"))
    from ledgerlens.functions.columns import sla_deadline
    return (me.unionByName(mi)
            .withColumn("run_id", F.lit(run_id).cast("long"))
            .withColumn("amount_diff", F.lit(None).cast(S.MONEY))
            .withColumn("status", F.lit("UNASSIGNED"))
            .withColumn("assigned_to", F.lit(None).cast("string"))
            .withColumn("version", F.lit(1))
            .withColumn("created_at", created_at)
            .withColumn("sla_deadline", sla_deadline(F.col("created_at"), F.col("exception_type"))))
