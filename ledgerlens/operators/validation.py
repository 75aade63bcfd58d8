"""Set-based validation of staged uploads and integrity audits.

Output contract: one row per failed rule ``(rule, message, n_rows,
samples)``; a file is publishable iff the result is empty.  Row rules are
conditional counts of one aggregation; set rules are anti/semi joins with
``distinct``.  Samples are the smallest values (a bounded top-k), never a
collect of the whole offending set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S

# Rule messages (fixed values).
MESSAGES = {
    "REQUIRED_FIELDS": "Missing required fields (external_ref, account_ref, amount, currency, or value_date) on some rows",
    "AMOUNT_NOT_POSITIVE": "Transaction amount must be a positive number on all rows",
    "CURRENCY_CODE": "Currency must be a 3-letter alphabetical ISO code",
    "ACCOUNT_NOT_FOUND": "Account reference(s) not found in system",
    "DUPLICATE_IN_FILE": "Duplicate external reference(s) found within file",
    "ALREADY_COMMITTED": "Duplicate external reference(s) already committed in database",
    "LEDGER_REQUIRED_FIELDS": "Missing required ledger fields on some rows",
    "TXN_TYPE": "txn_type must be CREDIT, DEBIT, FEE, TAX, or REVERSAL",
    "LEDGER_AMOUNT_NOT_POSITIVE": "Ledger amount must be a positive number on all rows",
    "LEDGER_DUPLICATE_IN_FILE": "Duplicate transaction reference(s) in file",
    "LEDGER_ALREADY_EXISTS": "Transaction reference(s) already exist",
    "CAST_ERROR": "Malformed CSV",
    "EMPTY_FILE": "CSV file is empty",
    "ROW_LIMIT": "CSV file exceeds the row limit",
}

_OUT = "rule string, message string, n_rows long, samples array<string>"


def _row_rules(df: DataFrame, rules: dict[str, Column], max_rows: int | None) -> DataFrame:
    """One aggregation pass: a count per predicate (+ file size rules)."""
    aggs = [F.count_if(pred).alias(name) for name, pred in rules.items()] + [F.count(F.lit(1)).alias("__n")]
    a = df.agg(*aggs)
    stack = [F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n_rows")) for n in rules]
    stack.append(F.struct(F.lit("EMPTY_FILE").alias("rule"),
                          F.when(F.col("__n") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_rows")))
    if max_rows is not None:
        stack.append(F.struct(F.lit("ROW_LIMIT").alias("rule"),
                              F.when(F.col("__n") > max_rows, F.col("__n")).otherwise(F.lit(0)).cast("long")
                              .alias("n_rows")))
    return (a.select(F.explode(F.array(*stack)).alias("r"))
            .select("r.rule", "r.n_rows", F.lit(None).cast("array<string>").alias("samples")))


def _set_rule(values: DataFrame, rule: str, k: int) -> DataFrame:
    """values(v): distinct offending values -> (rule, n_rows, k smallest samples).

    The count is one aggregate, the samples a bounded top-k; the two one-row
    results are combined by a union and a final aggregate (no join)."""
    n = values.agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
        .select("n_rows", F.lit(None).cast("array<string>").alias("samples"))
    top = (values.orderBy(F.col("v").asc_nulls_first()).limit(k)
           .agg(F.sort_array(F.collect_list(F.coalesce("v", F.lit("<null>")))).alias("samples"))
           .select(F.lit(None).cast("long").alias("n_rows"), "samples"))
    return (n.unionByName(top)
            .agg(F.max("n_rows").alias("n_rows"), F.first("samples", ignorenulls=True).alias("samples"))
            .select(F.lit(rule).alias("rule"), "n_rows", "samples"))


def _finish(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    msg = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return (out.filter(F.col("n_rows") > 0)
            .select("rule", msg[F.col("rule")].alias("message"), "n_rows", "samples"))


def _too_long(col: str, width: int) -> Column:
    return F.length(F.col(col)) > width


def validate_statement(raw: DataFrame, acc: DataFrame, existing: DataFrame,
                       max_rows: int | None = None) -> DataFrame:
    """B1-B6, B12 (+A4) over a raw statement upload (all strings)."""
    amount = F.col("amount").try_cast(S.STAGING_MONEY)
    vd = F.try_to_date(F.col("value_date"), "yyyy-MM-dd")
    sd = F.try_to_date(F.col("settlement_date"), "yyyy-MM-dd")
    cast_err = ((F.col("amount").isNotNull() & amount.isNull())
                | (F.col("value_date").isNotNull() & vd.isNull())
                | (F.col("settlement_date").isNotNull() & sd.isNull()))
    for c, w in S.STATEMENT_WIDTHS.items():
        cast_err = cast_err | F.coalesce(_too_long(c, w), F.lit(False))
    if "is_malformed" in raw.columns:  # rows that don't fit their header
        cast_err = cast_err | F.col("is_malformed")
    rows = _row_rules(raw, {
        "REQUIRED_FIELDS": F.greatest(*[F.col(c).isNull() for c in S.STATEMENT_REQUIRED]),
        "AMOUNT_NOT_POSITIVE": F.coalesce(amount <= 0, F.lit(False)),
        "CURRENCY_CODE": F.coalesce((F.length("currency") != 3) | F.col("currency").rlike("[^a-zA-Z]"), F.lit(False)),
        "CAST_ERROR": cast_err,
    }, max_rows)
    refs = raw.select(F.col("account_ref").alias("v")).distinct()
    unknown = refs.join(acc.select(F.col("external_ref").alias("v")), "v", "left_anti")
    dups = (raw.groupBy(F.col("external_ref").alias("v")).agg(F.count(F.lit(1)).alias("c"))
            .filter(F.col("c") > 1).select("v"))
    committed = (raw.select(F.col("external_ref").alias("v")).distinct()
                 .join(existing.select(F.col("external_ref").alias("v")), "v", "left_semi"))
    return _finish([rows,
                    _set_rule(unknown, "ACCOUNT_NOT_FOUND", S.VALIDATION_SAMPLE_REFS),
                    _set_rule(dups, "DUPLICATE_IN_FILE", S.VALIDATION_SAMPLE_DUPES),
                    _set_rule(committed, "ALREADY_COMMITTED", S.VALIDATION_SAMPLE_DUPES)])


def validate_ledger(raw: DataFrame, acc: DataFrame, existing: DataFrame,
                    max_rows: int | None = None) -> DataFrame:
    """B7-B12 (+A4) over a raw ledger upload."""
    amount = F.col("amount").try_cast(S.MONEY)
    vd = F.try_to_date(F.col("value_date"), "yyyy-MM-dd")
    cast_err = ((F.col("amount").isNotNull() & amount.isNull()) | (F.col("value_date").isNotNull() & vd.isNull()))
    for c, w in S.LEDGER_WIDTHS.items():
        cast_err = cast_err | F.coalesce(_too_long(c, w), F.lit(False))
    if "is_malformed" in raw.columns:
        cast_err = cast_err | F.col("is_malformed")
    rows = _row_rules(raw, {
        "LEDGER_REQUIRED_FIELDS": F.greatest(*[F.col(c).isNull() for c in S.LEDGER_REQUIRED]),
        "TXN_TYPE": F.coalesce(~F.col("txn_type").isin(S.TXN_TYPES), F.lit(False)),
        "LEDGER_AMOUNT_NOT_POSITIVE": F.coalesce(amount <= 0, F.lit(False)),
        "CAST_ERROR": cast_err,
    }, max_rows)
    refs = raw.select(F.col("account_ref").alias("v")).distinct()
    unknown = refs.join(acc.select(F.col("external_ref").alias("v")), "v", "left_anti")
    dups = (raw.groupBy(F.col("txn_ref").alias("v")).agg(F.count(F.lit(1)).alias("c"))
            .filter(F.col("c") > 1).select("v"))
    exists = (raw.select(F.col("txn_ref").alias("v")).distinct()
              .join(existing.select(F.col("txn_ref").alias("v")), "v", "left_semi"))
    return _finish([rows,
                    _set_rule(unknown, "ACCOUNT_NOT_FOUND", S.VALIDATION_SAMPLE_REFS),
                    _set_rule(dups, "LEDGER_DUPLICATE_IN_FILE", S.VALIDATION_SAMPLE_DUPES),
                    _set_rule(exists, "LEDGER_ALREADY_EXISTS", S.VALIDATION_SAMPLE_DUPES)])


# ---------------------------------------------------------------------------
# B13 integrity audit, B14 double-match guard
# ---------------------------------------------------------------------------

class _Table:
    """A table of an audit: row rules, unique keys, and foreign keys into other tables of the audit."""

    def __init__(self, name: str, rows: DataFrame, rules: dict[str, Column], unique: list[list[str]], foreign: list[tuple[str, str, str, str]]):
        self.name, self.rows, self.rules, self.unique, self.foreign = name, rows, rules, unique, foreign


def _audit(tables: list[_Table]) -> DataFrame:
    """(table_name, rule, n_rows) of every rule, zero counts kept; each table is scanned once.

    A row becomes one mark for the rules that it breaks, one for each unique key
    and one for each foreign key or key that others refer to.  A mark carries
    what it stands for, the key's columns and how often; equal marks are summed
    before the one shuffle by key.  A key referred to is an orphan if no mark of
    the owning column is there, a unique key is broken if it has two rows."""
    owned = {(t, c) for table in tables for _, _, t, c in table.foreign}
    marks, names = None, []
    text = lambda c: F.col(c).cast("string")
    for table in tables:
        mark = lambda kind, what, key, n=F.lit(1): F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("what"), key.alias("key"), n.cast("long").alias("n"))
        own = []
        for rule, broken in table.rules.items():
            names.append((table.name, rule))
            own.append(mark("rule", f"{table.name}.{rule}", F.array().cast("array<string>"), F.coalesce(broken, F.lit(False)).cast("long")))
        for keys in table.unique:
            names.append((table.name, "unique_" + "_".join(keys)))
            own.append(mark("unique", f"{table.name}.unique_{'_'.join(keys)}", F.array(*[text(c) for c in keys])))
        for rule, column, to, key in table.foreign:
            names.append((table.name, rule))
            own.append(F.when(F.col(column).isNotNull(), mark(f"{table.name}.{rule}", f"{to}.{key}", F.array(text(column)))))
        own += [F.when(F.col(c).isNotNull(), mark("owner", f"{t}.{c}", F.array(text(c)))) for t, c in sorted(owned) if t == table.name]
        got = table.rows.select(F.explode(F.array(*own)).alias("m")).filter("m IS NOT NULL").select("m.*")
        marks = got if marks is None else marks.unionByName(got)
    # "owner" and the foreign keys into it share ``what`` and key, so they meet in one group
    group = marks.groupBy("what", "key").agg(
        F.max(F.col("kind") == "owner").alias("owned"), F.sum(F.when(F.col("kind") == "rule", F.col("n"))).alias("broken"),
        F.sum(F.when(F.col("kind") == "unique", F.col("n"))).alias("rows"),
        *[F.sum(F.when(F.col("kind") == f"{t.name}.{rule}", F.col("n"))).alias(f"{t.name}.{rule}") for t in tables for rule, *_ in t.foreign])
    refs = [f"{t.name}.{rule}" for t in tables for rule, *_ in t.foreign]
    told = group.select(F.explode(F.array(
        F.struct(F.when(F.col("broken").isNotNull() | F.col("rows").isNotNull(), F.col("what")).alias("what"),
                 F.coalesce("broken", (F.col("rows") > 1).cast("long")).alias("n")),
        *[F.struct(F.when(~F.col("owned"), F.lit(r)).alias("what"), F.col(f"`{r}`").alias("n")) for r in refs])).alias("x")) \
        .select("x.*").filter("what IS NOT NULL").groupBy("what").agg(F.sum("n").alias("n"))
    spark = marks.sparkSession
    every = spark.createDataFrame([(t, r, f"{t}.{r}") for t, r in names], "table_name string, rule string, what string")
    return every.join(F.broadcast(told), "what", "left").select("table_name", "rule", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def integrity_audit(led: DataFrame, ext: DataFrame, acc: DataFrame, exc: DataFrame,
                    batches: DataFrame) -> DataFrame:
    """(table, rule, n_rows) for enum domains, positive amounts, the
    at-least-one-side rule, FK orphans and unique keys; zero counts kept."""
    ledger, lines, excs, uploads, accounts = ("ledger_transactions", "external_statement_lines", "reconciliation_exceptions",
                                              "import_batches", "accounts")
    return _audit([
        _Table(ledger, led, {"txn_type_domain": ~F.col("txn_type").isin(S.TXN_TYPES), "amount_positive": ~(F.col("amount") > 0)},
               [["ledger_txn_id"]], [("fk_account", "account_id", accounts, "account_id")]),
        _Table(lines, ext, {"amount_positive": ~(F.col("amount") > 0)}, [["ext_line_id"]],
               [("fk_account_ref", "account_ref", accounts, "external_ref"), ("fk_batch", "batch_id", uploads, "batch_id")]),
        _Table(excs, exc, {"exception_type_domain": ~F.col("exception_type").isin(S.EXCEPTION_TYPES),
                           "status_domain": ~F.col("status").isin(S.EXCEPTION_STATUSES),
                           "at_least_one_side": F.col("ledger_txn_id").isNull() & F.col("ext_line_id").isNull()}, [],
               [("fk_ledger", "ledger_txn_id", ledger, "ledger_txn_id"), ("fk_external", "ext_line_id", lines, "ext_line_id")]),
        _Table(uploads, batches, {"status_domain": ~F.col("status").isin(S.BATCH_STATUSES)}, [["source_id", "file_hash"]], []),
        _Table(accounts, acc, {}, [["external_ref"]], []),
    ])


def match_audit(groups: DataFrame, ledger_lines: DataFrame, external_lines: DataFrame, led: DataFrame,
                ext: DataFrame) -> DataFrame:
    """B13 for the matches: domains of groups, keys and foreign keys of both
    bridges; zero counts kept."""
    matches, ledger, lines = "match_groups", "ledger_transactions", "external_statement_lines"
    return _audit([
        _Table(matches, groups, {"match_type_domain": ~F.col("match_type").isin(S.MATCH_TYPES),
                                 "status_domain": ~F.col("status").isin(S.MATCH_STATUSES)}, [["match_id"]], []),
        _Table("match_group_ledger_lines", ledger_lines, {}, [["match_id", "ledger_txn_id"]],
               [("fk_match", "match_id", matches, "match_id"), ("fk_ledger", "ledger_txn_id", ledger, "ledger_txn_id")]),
        _Table("match_group_external_lines", external_lines, {}, [["match_id", "ext_line_id"]],
               [("fk_match", "match_id", matches, "match_id"), ("fk_external", "ext_line_id", lines, "ext_line_id")]),
        _Table(ledger, led, {}, [], []), _Table(lines, ext, {}, [], []),
    ])


def double_matches(groups: DataFrame, ledger_lines: DataFrame) -> DataFrame:
    """Ledger rows that sit in more than one CONFIRMED group."""
    confirmed = groups.filter(F.col("status") == "CONFIRMED").select("match_id")
    return (ledger_lines.join(confirmed, "match_id", "left_semi")
            .groupBy("ledger_txn_id").agg(F.count(F.lit(1)).alias("n_groups"))
            .filter(F.col("n_groups") > 1))
