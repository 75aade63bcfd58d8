"""Deterministic discrepancy feed (ledger -> external statement lines).

The feed reproduces the mix of a real settlement file -- clean lines, small
rounding differences, dropped lines, duplicates, an orphan line and batched
settlements -- from a deterministic bucket of the ledger id (never
``random``), so every scale factor gives the same answer in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas as S

# Fixed values of the feed (shares of ids by id % 100, orphan amount, ids).
CLEAN_BELOW = 85            # k < 85: clean, value date shifted by id % 3 days
ROUNDING_UPTO = 91          # 85 <= k <= 91: amount off by at most 0.8 %
DUPLICATE_FROM = 97         # k >= 97: line twice; 92..96 dropped
ORPHAN_EVERY = 250          # id % 250 = 0: an extra line of 125.50
ORPHAN_AMOUNT = "125.50"
BATCH_ACCOUNT_EVERY = 10    # accounts with acct % 10 = 0 settle in one batched line
BATCH_ROWS = 3              # ... covering their first three ledger rows
BATCH_LINE_BASE = 100_000_000


def discrepancy_feed(led: DataFrame, n_batches: int = 10, source_id: int = 4) -> DataFrame:
    """ledger(ledger_txn_id, account_id, amount, currency, value_date) -> external lines."""
    base = led.select("ledger_txn_id", "account_id", "amount", "currency", "value_date")
    idc, acct = F.col("ledger_txn_id"), F.col("account_id")
    k = idc % 100
    plain = base.filter(acct % BATCH_ACCOUNT_EVERY != 0)

    clean = plain.filter(k < CLEAN_BELOW).select(
        (idc * 10).alias("ext_line_id"), acct, F.col("amount"), F.col("currency"),
        F.date_add("value_date", (idc % 3).cast("int")).alias("value_date"),
        F.lit(False).alias("is_batched_settlement"))

    cents = (F.col("amount") * 100).cast("long")
    delta = F.floor(cents * F.abs(idc % 17 - 8) / 1000).cast("long")
    signed = F.when(idc % 17 < 8, -delta).otherwise(delta)
    rounding = plain.filter((k >= CLEAN_BELOW) & (k <= ROUNDING_UPTO)).select(
        (idc * 10).alias("ext_line_id"), acct,
        ((cents + signed).cast("decimal(20,0)") / 100).cast(S.MONEY).alias("amount"),
        F.col("currency"), F.col("value_date"), F.lit(False).alias("is_batched_settlement"))

    dup = plain.filter(k >= DUPLICATE_FROM).select(
        F.explode(F.array(idc * 10, idc * 10 + 1)).alias("ext_line_id"), acct, F.col("amount"),
        F.col("currency"), F.col("value_date"), F.lit(False).alias("is_batched_settlement"))

    orphan = base.filter(idc % ORPHAN_EVERY == 0).select(
        (idc * 10 + 5).alias("ext_line_id"), acct, F.lit(ORPHAN_AMOUNT).cast(S.MONEY).alias("amount"),
        F.col("currency"), F.col("value_date"), F.lit(False).alias("is_batched_settlement"))

    # first three rows per account by (value_date, id): row_number <= 3 is
    # planned as a per-partition group limit before the shuffle.
    w = Window.partitionBy("account_id").orderBy("value_date", "ledger_txn_id")
    batched = (base.filter(acct % BATCH_ACCOUNT_EVERY == 0)
               .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= BATCH_ROWS)
               .groupBy("account_id")
               .agg(F.sum("amount").cast(S.MONEY).alias("amount"), F.first("currency").alias("currency"),
                    F.max("value_date").alias("value_date"))
               .select((F.lit(BATCH_LINE_BASE) + acct * 10 + 9).cast("long").alias("ext_line_id"), acct,
                       "amount", "currency", "value_date", F.lit(True).alias("is_batched_settlement")))

    lines = clean.unionByName(rounding).unionByName(dup).unionByName(orphan).unionByName(batched)
    return lines.select(
        F.col("ext_line_id").cast("long").alias("ext_line_id"),
        (F.lit(1) + acct % n_batches).cast("long").alias("batch_id"),
        F.lit(source_id).cast("int").alias("source_id"),
        F.concat(F.lit("EXT-"), F.col("ext_line_id").cast("string")).alias("external_ref"),
        F.concat(F.lit("ACC-"), acct.cast("string")).alias("account_ref"),
        F.col("amount").cast(S.MONEY).alias("amount"),
        F.col("currency"),
        F.col("value_date"),
        F.col("value_date").alias("settlement_date"),
        F.col("is_batched_settlement"),
    )
