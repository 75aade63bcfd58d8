"""Classify unmatched rows into break types (off by default; the
reference itself only raises MISSING_* exceptions).

Order of tests per leftover row:
  DUPLICATE        a *matched* row of the same side has the same account,
                   currency, amount and value date;
  TIMING           a leftover row of the other side has the same account,
                   currency and amount (so only the date window kept them apart);
  AMOUNT_MISMATCH  a leftover row of the other side of the same account and
                   currency lies within the date window; amount_diff is the
                   smallest absolute difference;
  MISSING_*        otherwise.
DUPLICATE and TIMING are semi joins on pre-aggregated keys; the nearest
amount comes from windows over amount buckets of (account, currency, date)
cells, with the date window exploded into probe dates as in the matching passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas as S

K = ["account_id", "currency"]


#: Amounts within a factor of exp(1/16) of each other share a bucket.
BUCKETS_PER_E = 16


def _nearest(left: DataFrame, other: DataFrame, window_days: int) -> DataFrame:
    """left(id, account, currency, amount, value_date) -> (id, amount_diff):
    the smallest |amount difference| to an other-side row of the same account
    and currency within the window.

    A cell is (account, currency, date).  Inside a logarithmic amount bucket
    the nearest amounts come from a window over the bucket; beyond it only the
    largest amount of the next lower bucket in use and the smallest of the
    next higher one can be nearer, and these come from a window over the
    cell's bucket sums (a few hundred rows at most).  So no task holds a whole
    account-day."""
    from ledgerlens.operators.matching import _nearest as nearest_in_cells
    amount = F.col("amt").cast("double")
    bucket = F.when(amount > 0, F.floor(F.ln(amount) * BUCKETS_PER_E)).otherwise(F.lit(-(10 ** 6))).cast("long")
    probes = (left.withColumn("off", F.explode(F.sequence(F.lit(-window_days), F.lit(window_days))))
              .withColumn("cdate", F.date_add("value_date", F.col("off"))).withColumn("amt", F.col("amount"))
              .withColumn("bkt", bucket).select("id", "off", *K, "cdate", "bkt", "amt"))
    cells = (other.groupBy(*K, "value_date", "amount").agg(F.min("id").alias("oid"))
             .select(*K, F.col("value_date").alias("cdate"), F.col("amount").alias("amt"), "oid").withColumn("bkt", bucket))
    inside = nearest_in_cells(probes, cells, "id", "oid").select("id", F.abs(F.col("probe_amt") - F.col("cand_amt")).alias("d"))
    sums = cells.groupBy(*K, "cdate", "bkt").agg(F.min("amt").alias("lo"), F.max("amt").alias("hi"))
    asked = probes.select(*K, "cdate", "bkt").distinct()
    both = sums.withColumn("asked", F.lit(0)).unionByName(
        asked.withColumn("lo", F.lit(None).cast(S.MONEY)).withColumn("hi", F.lit(None).cast(S.MONEY)).withColumn("asked", F.lit(1)))
    both = both.groupBy(*K, "cdate", "bkt").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("asked").alias("asked"))
    up = Window.partitionBy(*K, "cdate").orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*K, "cdate").orderBy(F.desc("bkt")).rowsBetween(Window.unboundedPreceding, -1)
    ends = (both.withColumn("below", F.last("hi", ignorenulls=True).over(up))
            .withColumn("above", F.last("lo", ignorenulls=True).over(down)).filter("asked = 1")
            .select(*K, "cdate", "bkt", "below", "above").filter("below is not null or above is not null"))
    beyond = probes.join(ends, K + ["cdate", "bkt"]).select(
        "id", F.least(F.abs(F.col("amt") - F.col("below")), F.abs(F.col("amt") - F.col("above"))).alias("d"))
    return inside.unionByName(beyond).groupBy("id").agg(F.min("d").cast(S.MONEY).alias("amount_diff"))


def _classify(left: DataFrame, matched_same: DataFrame, other_left: DataFrame, missing: str,
              window_days: int) -> DataFrame:
    dup = left.join(matched_same.select(*K, "amount", "value_date").distinct(), K + ["amount", "value_date"],
                    "left_semi").select("id", F.lit(1).alias("is_dup"))
    timing = left.join(other_left.select(*K, "amount").distinct(), K + ["amount"], "left_semi") \
        .select("id", F.lit(1).alias("is_timing"))
    near = _nearest(left, other_left, window_days)
    out = left.select("id").join(dup, "id", "left").join(timing, "id", "left").join(near, "id", "left")
    kind = (F.when(F.col("is_dup").isNotNull(), "DUPLICATE").when(F.col("is_timing").isNotNull(), "TIMING")
            .when(F.col("amount_diff").isNotNull(), "AMOUNT_MISMATCH").otherwise(missing))
    return out.select("id", kind.alias("exception_type"),
                      F.when(kind == "AMOUNT_MISMATCH", F.col("amount_diff")).alias("amount_diff"))


def classify_breaks(led_side: DataFrame, ext_side: DataFrame, ledger_bridge: DataFrame, ext_bridge: DataFrame,
                    window_days: int = 3) -> DataFrame:
    """led_side/ext_side: the prepared sides (``matching.ledger_side`` /
    ``external_side``).  -> (ledger_txn_id, ext_line_id, exception_type, amount_diff)."""
    l = led_side.withColumnRenamed("ledger_txn_id", "id")
    e = ext_side.withColumnRenamed("ext_line_id", "id")
    lb = ledger_bridge.select(F.col("ledger_txn_id").alias("id"))
    eb = ext_bridge.select(F.col("ext_line_id").alias("id"))
    l_left, l_done = l.join(lb, "id", "left_anti"), l.join(lb, "id", "left_semi")
    e_left, e_done = e.join(eb, "id", "left_anti"), e.join(eb, "id", "left_semi")
    led_types = _classify(l_left, l_done, e_left, "MISSING_EXTERNAL", window_days)
    ext_types = _classify(e_left, e_done, l_left, "MISSING_INTERNAL", window_days)
    return (led_types.select(F.col("id").alias("ledger_txn_id"), F.lit(None).cast("long").alias("ext_line_id"),
                             "exception_type", "amount_diff")
            .unionByName(ext_types.select(F.lit(None).cast("long").alias("ledger_txn_id"),
                                          F.col("id").alias("ext_line_id"), "exception_type", "amount_diff")))
