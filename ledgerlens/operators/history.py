"""Change capture, retention, job disposition,
rate limits, reference-data upsert and the month-partitioned audit sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions.columns import retry_delay_seconds


def _asof(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def audit_diff(before: DataFrame, after: DataFrame, key: str, table_name: str) -> DataFrame:
    """Two snapshots -> INSERT / UPDATE / DELETE rows with the old and new
    row as JSON and the names of the changed columns (null-safe compare).
    Unchanged rows produce nothing."""
    cols = [c for c in before.columns if c != key]
    b = before.select(key, F.struct(*cols).alias("old"))
    a = after.select(key, F.struct(*cols).alias("new"))
    j = b.join(a, key, "full")
    op = (F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE")
          .when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE"))
    changed = F.filter(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c))
                                 for c in cols]), lambda x: x.isNotNull())
    return (j.withColumn("op", op).filter(F.col("op").isNotNull())
            .select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("record_id"), "op",
                    F.when(F.col("op") == "UPDATE", changed).alias("changed_columns"),
                    F.to_json("old").alias("old_data"), F.to_json("new").alias("new_data")))


def write_monthly(df: DataFrame, path: str, ts_col: str = "created_at") -> None:
    """Append audit rows partitioned by year and month of ``ts_col``
    (partitions appear on write; readers prune on y/m).  Rows are rebalanced by
    month first: few files a month, and a large month is split over tasks."""
    (df.withColumn("y", F.date_format(ts_col, "yyyy")).withColumn("m", F.date_format(ts_col, "MM")).hint("rebalance", "y", "m")
     .write.mode("append").partitionBy("y", "m").parquet(path))


def read_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """The rows of one month; only its partition is opened."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.filter((F.col("y").cast("string") == f"{year:04d}") & (F.lpad(F.col("m").cast("string"), 2, "0") == f"{month:02d}")).drop("y", "m")


def archive_split(df: DataFrame, archived: DataFrame | None, key: str, status: str, ts_col: str,
                  as_of, days: int = S.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Rows with ``status`` and ``ts_col`` older than ``days`` leave the
    live table; those not yet in the archive are appended to it."""
    now = _asof(as_of)
    old = (F.col("status") == status) & (F.col(ts_col) < F.timestamp_add("DAY", F.lit(-days), now))
    due = df.filter(old)
    live = df.filter(~F.coalesce(old, F.lit(False)))
    new_arch = due if archived is None else due.join(archived.select(key), key, "left_anti")
    return live, new_arch


def job_disposition(jobs: DataFrame, as_of, timeout_seconds: int = S.HEARTBEAT_ACTIVE_SECONDS) -> DataFrame:
    """RUNNING jobs whose heartbeat is older than the timeout: RETRYING
    with run_at = as_of + 2^attempts*10 s while attempts < max, else DEAD_LETTER."""
    now = _asof(as_of)
    stalled = jobs.filter((F.col("status") == "RUNNING") &
                          (F.col("last_heartbeat") < F.timestamp_add("SECOND", F.lit(-timeout_seconds), now)))
    retry = F.col("attempts") < F.col("max_attempts")
    return stalled.select(
        "job_id", "attempts", "max_attempts",
        F.when(retry, "RETRYING").otherwise("DEAD_LETTER").alias("disposition"),
        F.when(retry, F.timestamp_add("SECOND", retry_delay_seconds("attempts"), now)).alias("next_run_at"),
        F.when(retry, F.lit("Worker heartbeat timed out"))
        .otherwise(F.lit("Worker heartbeat timed out (Max retries exceeded)")).alias("error_message"))


def rate_limit_violations(log: DataFrame, key_col: str, ts_col: str, window_minutes: int,
                          max_requests: int, limit_name: str) -> DataFrame:
    """Fixed (epoch-aligned) windows per key with more than ``max_requests``."""
    w = F.window(ts_col, f"{window_minutes} minutes")
    return (log.groupBy(w.alias("w"), F.col(key_col).alias("client"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .filter(F.col("requests") > max_requests)
            .select(F.lit(limit_name).alias("limit_name"), "client", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), F.col("requests").cast("long")))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Union old and new rows, latest ``order_col`` wins per key
    (ties: the new side).  ``max_by`` is a partial aggregate -- no sort of
    whole key groups."""
    cols = [c for c in old.columns if c not in keys]
    u = (old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
         .withColumn("__ord", F.struct(F.col(order_col), F.col("__src"))))
    return (u.groupBy(*keys).agg(F.max_by(F.struct(*cols), "__ord").alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols]))
