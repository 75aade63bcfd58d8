"""Statement and ledger CSV uploads.

Files are read as all-string columns (never inferred); headers are trimmed
and lower-cased, values trimmed, empty strings become NULL.  Typing is a
separate step that uses ``try_cast`` so a bad cell becomes NULL and is
reported by the CAST_ERROR rule instead of failing the job.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas as S
from ledgerlens.session import materialize, with_dense_ids

#: A batch's rows are numbered from batch_id * BATCH_ROWS on; a larger batch is refused.
BATCH_ROWS = 2 ** 31
#: Batch ids end here, so that twice a row's id (an exception's) still is a long.
BATCH_IDS = 2 ** 31 - 1


class CsvHeaderError(ValueError):
    """A required column is missing or a name comes twice: the whole upload is rejected."""

    code = "CSV_HEADER_ERROR"


class BatchTooLarge(ValueError):
    """More rows or a higher batch id than the ids have room for."""

    code = "BATCH_TOO_LARGE"


#: Whether a row has more or fewer fields than its header, or a quote that never ends.
MALFORMED = "is_malformed"


def _layouts(spark: SparkSession, path: str) -> list[tuple[str, bool, list[str]]]:
    """(header line, has quoted line breaks, files) of the uploads under a path.

    One splittable scan of the lines: the first line of each file, and whether
    any line has an odd number of quotes.  A header is one short row a file."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value",
        (F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).alias("odd"))
    files = lines.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.max("odd").alias("odd"))
    return [(r["header"], r["odd"], sorted(r["files"])) for r in
            files.groupBy("header", "odd").agg(F.collect_list("file").alias("files")).collect()]


_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True,
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__raw"}


def read_csv_strings(spark: SparkSession, path: str, sep: str = ",", kind: str | None = None) -> DataFrame:
    """Raw upload: each file's own header row, every column a string, blank
    lines skipped, doubled quotes and quoted line breaks as RFC 4180 has them.
    Rows that don't fit their header are kept and marked (``MALFORMED``).
    With a ``kind``, every file's header must have its columns."""
    out = None
    for header, broken, files in sorted(_layouts(spark, path)):
        names = [c.strip().lower() for c in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]
        check_names(names)
        if kind:
            check_headers(names, kind)
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))]
                              + [T.StructField("__raw", T.StringType())])
        if broken:
            raw = _split_records(spark, files).select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {
                k: str(v).lower() if isinstance(v, bool) else v for k, v in (_OPTIONS | {"sep": sep}).items()}).alias("r")).select("r.*")
        else:
            # with pruning, short and long rows pass unnoticed
            raw = spark.read.schema(schema).options(header=True, sep=sep, columnPruning=False, **_OPTIONS).csv(files)
        one = raw.select(*[F.nullif(F.trim(F.col(f"c{k}")), F.lit("")).alias(n) for k, n in enumerate(names)],
                         F.col("__raw").isNotNull().alias(MALFORMED))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], f"{MALFORMED} boolean")


def _split_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(record) of files with quoted line breaks, headers left out, read in as many tasks as they have splits.

    A line break ends a record if an even number of quotes precedes it in its
    file.  Each split counts its quotes; the sums before it (one row a split)
    tell whether it begins inside quotes.  Then each split numbers its records
    by itself, and a split's first lines that go on with an earlier record are
    given to the last split in which one began.  Only records of several lines
    are put together again, so no task holds more than a split or a record."""
    lines = spark.read.text(files, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value", (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"))
    lines = materialize(lines, "csv-lines")
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("inside"))
    own = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(splits, ["file", "split"]).withColumn("starts", ((F.col("inside") + before) % 2 == 0).cast("int"))
    marked = materialize(marked.withColumn("n", F.sum("starts").over(own)).select("file", "split", "at", "n", "value"), "csv-marked")
    last = marked.groupBy("file", "split").agg(F.max("n").alias("last"))
    began = F.last(F.when(F.col("last") > 0, F.struct(F.col("split").alias("from"), F.col("last").alias("n"))), ignorenulls=True).over(earlier)
    last = last.select("file", F.col("split"), began.alias("before"))
    placed = marked.join(last, ["file", "split"]).select(
        "file", F.when(F.col("n") == 0, F.col("before.from")).otherwise(F.col("split")).alias("from"),
        F.when(F.col("n") == 0, F.col("before.n")).otherwise(F.col("n")).alias("n"), "split", "at", "value")
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    whole = placed.groupBy("file", "from", "n").agg(parts.alias("lines")).select(
        "file", "from", "n", F.rtrim(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"), F.lit("\r")).alias("record"))
    whole = materialize(whole.filter(F.trim("record") != ""), "csv-records")
    heads = whole.groupBy("file").agg(F.min(F.struct("from", "n")).alias("h")).select("file", "h.from", "h.n")
    return whole.join(heads, ["file", "from", "n"], "left_anti").select("record")


def check_names(names: list[str]) -> None:
    """A header names each column once, else CsvHeaderError."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise CsvHeaderError(f"CSV repeats column(s): {', '.join(twice)}")


def check_headers(columns: list[str], kind: str) -> None:
    """A3: every required column present, else CsvHeaderError."""
    need = S.STATEMENT_REQUIRED if kind == "statement" else S.LEDGER_REQUIRED
    have = {c.strip().lower() for c in columns}
    missing = [c for c in need if c not in have]
    if missing:
        raise CsvHeaderError(f"CSV is missing required column(s): {', '.join(missing)}")


def check_size(raw: DataFrame, max_rows: int | None = None) -> str | None:
    """A4: 'EMPTY_FILE' / 'ROW_LIMIT' / None; no limit unless one is given
    (the upload path's is ``schemas.IMPORT_MAX_ROWS``)."""
    if raw.isEmpty():
        return "EMPTY_FILE"
    if max_rows is not None and raw.limit(max_rows + 1).count() > max_rows:
        return "ROW_LIMIT"
    return None


def read_statement(spark: SparkSession, path: str) -> DataFrame:
    """A1: statement upload -> raw string columns (each file's header checked)."""
    raw = read_csv_strings(spark, path, kind="statement")
    check_headers(raw.columns, "statement")  # an upload without a line has no header
    return conform(raw, S.STATEMENT_COLUMNS)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A2: ledger upload -> raw string columns (each file's header checked)."""
    raw = read_csv_strings(spark, path, kind="ledger")
    check_headers(raw.columns, "ledger")
    return conform(raw, S.LEDGER_COLUMNS)


def conform(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the known columns in order; optional ones missing become NULL.  The
    mark of malformed rows stays."""
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns],
                      *[c for c in raw.columns if c == MALFORMED])


def _date(c: str):
    return F.try_to_date(F.col(c), "yyyy-MM-dd")


def type_statement(raw: DataFrame) -> DataFrame:
    """Staging types: decimal(15,2) amount, dates, flag true only for 'true'."""
    return raw.select(
        "external_ref", "account_ref",
        F.col("amount").try_cast(S.STAGING_MONEY).alias("amount"),
        "currency", _date("value_date").alias("value_date"), _date("settlement_date").alias("settlement_date"),
        F.coalesce(F.lower(F.col("is_batched_settlement")) == "true", F.lit(False)).alias("is_batched_settlement"))


def type_ledger(raw: DataFrame) -> DataFrame:
    return raw.select(
        "txn_ref", "account_ref", "txn_type", F.col("amount").try_cast(S.MONEY).alias("amount"), "currency",
        _date("value_date").alias("value_date"), "counterparty", "narrative")


def _numbered(rows: DataFrame, order: list[str], id_col: str, batch_id: int) -> DataFrame:
    """Rows numbered inside the batch's own range of ids, which must hold them all."""
    if not 0 <= batch_id < BATCH_IDS:
        raise BatchTooLarge(f"batch id {batch_id} is out of range")
    try:
        return with_dense_ids(rows, order, id_col, batch_id * BATCH_ROWS, BATCH_ROWS - 1)
    except OverflowError as e:
        raise BatchTooLarge(f"batch {batch_id} has more than {BATCH_ROWS - 1} rows") from e


def publish_statement(typed: DataFrame, batch_id: int, source_id: int) -> DataFrame:
    """Staged -> main columns: upper-case currency, stamped batch/source.
    ``ext_line_id`` numbers the batch's rows from batch_id * BATCH_ROWS + 1 on,
    by external_ref and then the other columns."""
    order = ["external_ref", *[c for c in typed.columns if c not in ("external_ref", MALFORMED)]]
    numbered = _numbered(typed.drop(MALFORMED), order, "ext_line_id", batch_id)
    return numbered.select(
        "ext_line_id",
        F.lit(batch_id).cast("long").alias("batch_id"), F.lit(source_id).cast("int").alias("source_id"),
        "external_ref", "account_ref", F.col("amount").cast(S.MONEY).alias("amount"),
        F.upper("currency").alias("currency"), "value_date", "settlement_date",
        F.coalesce("is_batched_settlement", F.lit(False)).alias("is_batched_settlement"))


def publish_ledger(typed: DataFrame, acc: DataFrame, batch_id: int) -> DataFrame:
    """Staged ledger joined to accounts on external_ref (rows without an
    account drop out), upper-case currency, blank counterparty/narrative NULL.
    ``ledger_txn_id`` numbers the rows as in ``publish_statement``, by txn_ref."""
    a = acc.select(F.col("external_ref").alias("account_ref"), "account_id")
    known = typed.drop(MALFORMED).join(a, "account_ref")
    order = ["txn_ref", "account_ref", "txn_type", "amount", "currency", "value_date", "counterparty", "narrative"]
    return _numbered(known, order, "ledger_txn_id", batch_id).select(
        "ledger_txn_id", "account_id", "txn_ref", "txn_type",
        "amount", F.upper("currency").alias("currency"), "value_date",
        F.nullif("counterparty", F.lit("")).alias("counterparty"), F.nullif("narrative", F.lit("")).alias("narrative"),
        F.lit(batch_id).cast("long").alias("batch_id"))


def write_batch(df: DataFrame, batch_dir: str, manifest_row: DataFrame, manifest_dir: str) -> None:
    """All-or-nothing publish: the batch directory is written once (the
    committer renames it into place), then the manifest row is appended as
    the commit marker.  Readers only trust batches listed in the manifest."""
    df.write.mode("errorifexists").parquet(batch_dir)
    manifest_row.write.mode("append").parquet(manifest_dir)
