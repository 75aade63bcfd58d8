"""Types, enumerations and the fixed values that must equal the reference's.

Money is ``decimal(18,2)`` everywhere matching happens; never ``double``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
STAGING_MONEY = T.DecimalType(15, 2)
TOLERANCE = T.DecimalType(6, 4)
CONFIDENCE = T.DecimalType(5, 2)

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# ---------------------------------------------------------------------------
TXN_TYPES = ["CREDIT", "DEBIT", "FEE", "TAX", "REVERSAL"]
RULE_TYPES = ["EXACT", "TOLERANCE", "FUZZY_REF", "BATCH_SUM"]
EXCEPTION_TYPES = ["MISSING_EXTERNAL", "MISSING_INTERNAL", "AMOUNT_MISMATCH", "DUPLICATE", "TIMING"]
EXCEPTION_STATUSES = ["UNASSIGNED", "ASSIGNED", "IN_PROGRESS", "RESOLVED", "APPROVED", "CLOSED"]
OPEN_QUEUE_STATUSES = ["UNASSIGNED", "ASSIGNED", "IN_PROGRESS", "RESOLVED", "APPROVED"]
ACTIVE_QUEUE_STATUSES = ["UNASSIGNED", "ASSIGNED", "IN_PROGRESS"]
DONE_STATUSES = ["APPROVED", "CLOSED"]
NO_REASSIGN_STATUSES = ["RESOLVED", "APPROVED", "CLOSED"]
BATCH_STATUSES = ["PROCESSING", "COMPLETED", "FAILED"]
JOB_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "RETRYING", "CANCELLED"]
RUN_STATUSES = ["RUNNING", "COMPLETED", "FAILED"]
MATCH_TYPES = ["AUTO", "MANUAL"]
MATCH_STATUSES = ["CONFIRMED", "REVERSED"]

# SLA hours per exception type; anything else gets the default.
SLA_HOURS = {
    "MISSING_EXTERNAL": 24,
    "MISSING_INTERNAL": 24,
    "AMOUNT_MISMATCH": 48,
    "DUPLICATE": 12,
    "TIMING": 72,
}
SLA_DEFAULT_HOURS = 24

# Roles: id -> name.
ROLES = {1: "ADMIN", 2: "APPROVER", 3: "ANALYST", 4: "AUDITOR"}
SEE_ALL_ROLES = ["ADMIN", "APPROVER", "AUDITOR"]
APPROVER_ROLES = ["ADMIN", "APPROVER"]
WORKER_ROLES = ["ANALYST", "APPROVER", "ADMIN"]

# Import sources: (source_id, source_name, file_format).
IMPORT_SOURCES = [
    (1, "INTERNAL_LEDGER", "DATABASE"),
    (2, "SWIFT_MT940", "TXT"),
    (3, "CARD_NETWORK", "JSON"),
    (4, "CSV_STATEMENT", "CSV"),
]

# Required CSV headers and the full column lists of the two upload formats.
STATEMENT_REQUIRED = ["external_ref", "account_ref", "amount", "currency", "value_date"]
STATEMENT_COLUMNS = STATEMENT_REQUIRED + ["settlement_date", "is_batched_settlement"]
LEDGER_REQUIRED = ["txn_ref", "account_ref", "txn_type", "amount", "currency", "value_date"]
LEDGER_COLUMNS = LEDGER_REQUIRED + ["counterparty", "narrative"]

# Staging column widths (text longer than these aborts the load).
STATEMENT_WIDTHS = {"external_ref": 100, "account_ref": 50, "currency": 3}
LEDGER_WIDTHS = {"txn_ref": 64, "account_ref": 50, "txn_type": 20, "currency": 3, "counterparty": 150}

IMPORT_MAX_ROWS = 100_000          # per-file cap of the upload path
VALIDATION_SAMPLE_REFS = 10        # samples for "account not found"
VALIDATION_SAMPLE_DUPES = 5        # samples for duplicate refs
VALIDATION_MAX_MESSAGES = 50

RESOLUTION_NOTE_MIN = 5
LOCKOUT_FAILURES = 5
LOCKOUT_MINUTES = 15
# Rate limits: (name, window minutes, max requests).
RATE_LIMITS = [("api", 15, 300), ("import", 60, 10), ("login", 15, 10)]
HEARTBEAT_ACTIVE_SECONDS = 30
RETRY_BASE_SECONDS = 10
RETENTION_DAYS = 30
CHAIN_MAX_DEPTH = 20
TOLERANCE_MAX_PENALTY = 20         # confidence = 100 - min(20, diff * 100)

# Default match rules: (rule_id, rule_name, rule_type, tolerance, window_days, priority).
DEFAULT_RULES = [
    (1, "Exact match same-day", "EXACT", "0.0000", 2, 10),
    (2, "FX rounding tolerance 1%", "TOLERANCE", "0.0100", 3, 20),
    (3, "Batched settlement sum", "BATCH_SUM", "0.0000", 5, 30),
]

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ACCOUNTS = _s(("account_id", T.LongType()), ("external_ref", T.StringType()), ("client_id", T.LongType()),
              ("branch_id", T.IntegerType()), ("currency", T.StringType()), ("status", T.StringType()))
LEDGER = _s(("ledger_txn_id", T.LongType()), ("account_id", T.LongType()), ("txn_ref", T.StringType()),
            ("txn_type", T.StringType()), ("amount", MONEY), ("currency", T.StringType()),
            ("value_date", T.DateType()), ("batch_id", T.LongType()))
EXTERNAL = _s(("ext_line_id", T.LongType()), ("batch_id", T.LongType()), ("source_id", T.IntegerType()),
              ("external_ref", T.StringType()), ("account_ref", T.StringType()), ("amount", MONEY),
              ("currency", T.StringType()), ("value_date", T.DateType()), ("settlement_date", T.DateType()),
              ("is_batched_settlement", T.BooleanType()))
MATCH_RULES = _s(("rule_id", T.IntegerType()), ("rule_name", T.StringType()), ("rule_type", T.StringType()),
                 ("amount_tolerance", TOLERANCE), ("date_window_days", T.IntegerType()),
                 ("priority", T.IntegerType()), ("is_active", T.BooleanType()))
IMPORT_SOURCE = _s(("source_id", T.IntegerType()), ("source_name", T.StringType()), ("file_format", T.StringType()))
SLA_RULES = _s(("exception_type", T.StringType()), ("max_resolution_hours", T.IntegerType()))
