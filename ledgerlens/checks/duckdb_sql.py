"""DuckDB SQL of the fixtures and of every registered query (the oracle).

The driver runs these next to the Spark queries on the same Parquet tables
(pre-registered as views).  Each is written from the operator's definition in
a form of its own -- least pairs, sums over earlier rows, anti joins, stepwise
recursion -- so that a wrong Spark form can't be wrong in the same way.
"""

from __future__ import annotations

# name -> (dependencies, body)
FIXTURES: dict[str, tuple[list[str], str]] = {}


def _fx(name: str, deps: list[str], body: str) -> None:
    FIXTURES[name] = (deps, body)


_fx("accounts", [], """
SELECT c_custkey AS account_id, 'ACC-' || CAST(c_custkey AS VARCHAR) AS external_ref, c_custkey AS client_id,
       CAST(c_nationkey AS INTEGER) AS branch_id,
       CASE c_custkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, 'ACTIVE' AS status
FROM customer""")

_fx("ledger", [], """
SELECT o_orderkey AS ledger_txn_id, o_custkey AS account_id, 'LDG-' || CAST(o_orderkey AS VARCHAR) AS txn_ref,
       CASE WHEN o_orderkey % 10 = 7 THEN 'FEE' WHEN o_orderkey % 10 = 8 THEN 'TAX'
            WHEN o_orderkey % 10 = 9 THEN 'REVERSAL' WHEN o_orderkey % 2 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS txn_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       CASE o_custkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
       CAST(o_orderdate AS DATE) AS value_date, CAST(NULL AS BIGINT) AS batch_id
FROM orders""")

_fx("external", ["ledger"], """
SELECT CAST(ext_line_id AS BIGINT) AS ext_line_id, CAST(1 + acct % 10 AS BIGINT) AS batch_id, 4 AS source_id,
       'EXT-' || CAST(ext_line_id AS VARCHAR) AS external_ref, 'ACC-' || CAST(acct AS VARCHAR) AS account_ref,
       CAST(amount AS DECIMAL(18,2)) AS amount, currency, value_date, value_date AS settlement_date,
       is_batched_settlement
FROM (
  SELECT ledger_txn_id * 10 AS ext_line_id, account_id AS acct, amount, currency,
         value_date + CAST(ledger_txn_id % 3 AS INTEGER) AS value_date, false AS is_batched_settlement
  FROM ledger WHERE account_id % 10 <> 0 AND ledger_txn_id % 100 < 85
  UNION ALL
  SELECT ledger_txn_id * 10, account_id, CAST(CAST(c + CASE WHEN ledger_txn_id % 17 < 8 THEN -1 ELSE 1 END
                                                   * ((c * abs(ledger_txn_id % 17 - 8)) // 1000) AS DECIMAL(18,0))
                                              * 0.01 AS DECIMAL(18,2)),
         currency, value_date, false
  FROM (SELECT *, CAST(amount * 100 AS BIGINT) AS c FROM ledger)
  WHERE account_id % 10 <> 0 AND ledger_txn_id % 100 BETWEEN 85 AND 91
  UNION ALL
  SELECT ledger_txn_id * 10 + d, account_id, amount, currency, value_date, false
  FROM ledger, (VALUES (0), (1)) t(d) WHERE account_id % 10 <> 0 AND ledger_txn_id % 100 >= 97
  UNION ALL
  SELECT ledger_txn_id * 10 + 5, account_id, CAST(125.50 AS DECIMAL(18,2)), currency, value_date, false
  FROM ledger WHERE ledger_txn_id % 250 = 0
  UNION ALL
  SELECT 100000000 + account_id * 10 + 9, account_id, sum(amount), min(currency), max(value_date), true
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY value_date, ledger_txn_id) AS rn
        FROM ledger WHERE account_id % 10 = 0)
  WHERE rn <= 3 GROUP BY account_id
)""")

_fx("rules", [], """
SELECT * FROM (VALUES
  (1, 'Exact match same-day', 'EXACT', CAST(0 AS DECIMAL(6,4)), 2, 10, true),
  (2, 'FX rounding tolerance 1%', 'TOLERANCE', CAST(0.01 AS DECIMAL(6,4)), 3, 20, true),
  (3, 'Batched settlement sum', 'BATCH_SUM', CAST(0 AS DECIMAL(6,4)), 5, 30, true))
  t(rule_id, rule_name, rule_type, amount_tolerance, date_window_days, priority, is_active)""")

_fx("sources", [], """
SELECT * FROM (VALUES (1, 'INTERNAL_LEDGER', 'DATABASE'), (2, 'SWIFT_MT940', 'TXT'),
                      (3, 'CARD_NETWORK', 'JSON'), (4, 'CSV_STATEMENT', 'CSV')) t(source_id, source_name, file_format)""")

_fx("sla_rules", [], """
SELECT * FROM (VALUES ('MISSING_EXTERNAL', 24), ('MISSING_INTERNAL', 24), ('AMOUNT_MISMATCH', 48),
                      ('DUPLICATE', 12), ('TIMING', 72)) t(exception_type, max_resolution_hours)""")

_fx("users", [], """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS full_name, CAST(r AS INTEGER) AS role_id,
       CASE r WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'APPROVER' WHEN 3 THEN 'ANALYST' ELSE 'AUDITOR' END AS role,
       CASE WHEN c_custkey % 50 = 7 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at
FROM (SELECT *, c_custkey % 4 + 1 AS r FROM customer)""")

_fx("bursts", [], """
SELECT 'burst-' || event_id AS user_id, CAST(ts AS TIMESTAMP) AS ts, event_type
FROM events, unnest(range(CASE WHEN event_id % 2500 = 3 THEN 301 WHEN event_id % 250 = 7 THEN 11 ELSE 0 END)) AS k(i)""")

_fx("schedules", [], "SELECT n_nationkey AS schedule_id, n_name AS name, n_nationkey % 3 <> 0 AS is_active FROM nation")

_fx("exceptions", [], """
SELECT event_id AS exception_id, CAST(1 AS BIGINT) AS run_id,
       CASE WHEN event_type <> 'view' THEN event_id END AS ledger_txn_id,
       CASE WHEN event_type IN ('view', 'error') THEN event_id * 10 END AS ext_line_id,
       exception_type, CAST(value AS DECIMAL(18,2)) AS amount_diff,
       CASE st WHEN 0 THEN 'UNASSIGNED' WHEN 1 THEN 'ASSIGNED' WHEN 2 THEN 'IN_PROGRESS' WHEN 3 THEN 'RESOLVED'
               WHEN 4 THEN 'APPROVED' ELSE 'CLOSED' END AS status,
       CASE WHEN st > 0 THEN CAST(user_id AS VARCHAR) END AS assigned_to,
       CAST(st + 1 AS INTEGER) AS version, created_at, resolved_at,
       CASE WHEN st >= 4 THEN resolved_at + INTERVAL 2 HOUR END AS approved_at,
       CASE WHEN st = 5 THEN resolved_at + INTERVAL 3 HOUR END AS closed_at,
       created_at + to_hours(CASE exception_type WHEN 'MISSING_EXTERNAL' THEN 24 WHEN 'MISSING_INTERNAL' THEN 24
                                  WHEN 'AMOUNT_MISMATCH' THEN 48 WHEN 'DUPLICATE' THEN 12 WHEN 'TIMING' THEN 72
                                  ELSE 24 END) AS sla_deadline
FROM (SELECT *, CAST(event_id % 6 AS INTEGER) AS st, CAST(ts AS TIMESTAMP) AS created_at,
             CASE WHEN event_id % 6 >= 3 THEN CAST(ts AS TIMESTAMP) + to_hours(CAST(floor(value) AS BIGINT)) END
               AS resolved_at,
             CASE event_type WHEN 'click' THEN 'MISSING_EXTERNAL' WHEN 'view' THEN 'MISSING_INTERNAL'
                             WHEN 'error' THEN 'AMOUNT_MISMATCH' WHEN 'purchase' THEN 'DUPLICATE'
                             WHEN 'signup' THEN 'TIMING' END AS exception_type
      FROM events)""")

_fx("batches", [], """
SELECT s_suppkey + 1 AS batch_id, CAST(s_suppkey % 4 + 1 AS INTEGER) AS source_id, s_name || '.csv' AS file_name,
       sha256(s_name) AS file_hash, CASE WHEN st = 'COMPLETED' THEN CAST(s_suppkey * 10 AS INTEGER) END AS row_count,
       st AS status, CAST(s_nationkey AS VARCHAR) AS imported_by,
       CASE WHEN st = 'COMPLETED' THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey) END AS completed_at
FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'FAILED' WHEN s_suppkey % 5 = 1 THEN 'PROCESSING'
                     ELSE 'COMPLETED' END AS st FROM supplier)""")

_fx("links1", [], "SELECT o_orderkey AS child_txn_id, o_orderkey - 1 AS parent_txn_id FROM orders "
                  "WHERE o_orderkey % 7 IN (1, 2, 3)")
_fx("links2", [], "SELECT o_orderkey AS child_txn_id, o_orderkey - 1 AS parent_txn_id FROM orders "
                  "WHERE o_orderkey % 30 <> 0")

_fx("job_base", [], """
SELECT event_id AS job_id,
       CASE event_type WHEN 'click' THEN 'RECONCILIATION_RUN' WHEN 'view' THEN 'REFRESH_SUMMARY'
                       WHEN 'error' THEN 'IMPORT_STATEMENT' WHEN 'purchase' THEN 'ARCHIVE' ELSE 'NOTIFY' END AS job_type,
       CASE event_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED'
                         WHEN 4 THEN 'RETRYING' ELSE 'CANCELLED' END AS status,
       '{"workerId":"w' || CAST(user_id % 5 AS VARCHAR) || '"}' AS payload,
       CAST(CASE event_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS INTEGER) AS priority,
       CAST(event_id % 4 AS INTEGER) AS attempts, 3 AS max_attempts,
       CAST(ts AS TIMESTAMP) AS run_at, CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) AS last_heartbeat,
       CASE WHEN event_id % 6 IN (1, 2, 3) THEN CAST(ts AS TIMESTAMP) END AS started_at,
       CASE WHEN event_id % 6 = 2 THEN CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR END AS completed_at,
       CASE WHEN event_id % 6 = 3 THEN 'handler failed' END AS error_message,
       CASE WHEN event_id % 6 = 1 THEN 'w' || CAST(user_id % 5 AS VARCHAR) END AS worker_owner,
       (event_id % 6 = 3 AND event_id % 4 = 3) AS dead
FROM events""")
_fx("jobs", ["job_base"], "SELECT * EXCLUDE (dead) FROM job_base WHERE NOT dead")
_fx("dead_letters", ["job_base"], """
SELECT job_id, job_type, payload, priority, attempts, 'max attempts reached' AS last_error,
       created_at + INTERVAL 1 HOUR AS failed_at
FROM job_base WHERE dead""")

_fx("requests", [], """
SELECT event_id AS request_id, CASE WHEN event_id % 31 <> 0 THEN CAST(user_id % 20 AS VARCHAR) END AS user_id,
       ['GET', 'PATCH', 'PATCH', 'POST', 'PATCH', 'PUT', 'PATCH', 'DELETE'][1 + event_id % 8] AS method,
       '/api/exceptions/' || event_type AS path,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 29 = 0 THEN ''
            ELSE event_type || ':' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') END AS idempotency_key,
       CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS TIMESTAMP) AS started_at,
       CAST(ts AS TIMESTAMP) + to_seconds(event_id % 7) AS finished_at,
       CASE WHEN event_id % 13 = 0 THEN 500 ELSE 200 END AS status_code, event_type
FROM events""")

_fx("auth_events", [], """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS TIMESTAMP) AS ts, event_type = 'signup' AS success
FROM events WHERE event_type IN ('error', 'signup')""")

_fx("tol_rule", ["rules"], """
SELECT amount_tolerance, date_window_days FROM rules r WHERE rule_type = 'TOLERANCE' AND is_active
AND (priority, rule_id) = (SELECT min((priority, rule_id)) FROM rules WHERE rule_type = 'TOLERANCE' AND is_active)""")


def _passes(p: str, ledger: str, external: str) -> None:
    """The three passes over two tables as CTEs ``<p>exact``, ``<p>tolerance`` and ``<p>batched``.

    Each side's choice is the least (distance, other id) of its candidates,
    and a pair is a match if both choose each other.  Running totals are sums
    over all earlier rows of the account.
    """
    _fx(f"{p}rows", [ledger, "accounts"], f"SELECT * FROM {ledger} SEMI JOIN accounts USING (account_id)")
    _fx(f"{p}lines", [external, "accounts"], f"""
SELECT s.*, a.account_id FROM {external} s, accounts a WHERE a.external_ref = s.account_ref""")

    def mutual(cand: str, dist: str, carry: str) -> str:
        return f"""cand AS ({cand}),
mine AS (SELECT l, arg_min(c, ({dist}, e)) AS c FROM cand c GROUP BY l),
theirs AS (SELECT e, arg_min(c, ({dist}, l)) AS c FROM cand c GROUP BY e)
SELECT mine.l AS ledger_txn_id, theirs.e AS ext_line_id, {carry}
FROM mine, theirs WHERE mine.c.e = theirs.e AND theirs.c.l = mine.l"""

    _fx(f"{p}exact", [f"{p}rows", f"{p}lines"], f"""
WITH {mutual(f"""SELECT ledger_txn_id AS l, ext_line_id AS e, abs(r.value_date - x.value_date) AS days
  FROM {p}rows r JOIN {p}lines x USING (account_id, currency, amount) WHERE abs(r.value_date - x.value_date) <= 2""",
             "c.days", "CAST(0 AS DECIMAL(18,2)) AS amount_diff, mine.c.days AS day_diff")}""")

    _fx(f"{p}tolerance", [f"{p}rows", f"{p}lines", f"{p}exact", "tol_rule"], f"""
WITH {mutual(f"""SELECT ledger_txn_id AS l, ext_line_id AS e, abs(r.amount - x.amount) AS gap, abs(r.value_date - x.value_date) AS days
  FROM (SELECT * FROM {p}rows ANTI JOIN {p}exact USING (ledger_txn_id)) r
  JOIN (SELECT * FROM {p}lines ANTI JOIN {p}exact USING (ext_line_id)) x USING (account_id, currency)
  WHERE abs(r.value_date - x.value_date) <= (SELECT date_window_days FROM tol_rule)
    AND abs(r.amount - x.amount) <= r.amount * (SELECT amount_tolerance FROM tol_rule)""",
             "c.gap", "CAST(mine.c.gap AS DECIMAL(18,2)) AS amount_diff, mine.c.days AS day_diff, "
                      "CAST(100 - least(20, mine.c.gap * 100) AS DECIMAL(5,2)) AS confidence_score")}""")

    _fx(f"{p}batched", [f"{p}rows", f"{p}lines", f"{p}exact", f"{p}tolerance"], f"""
WITH free AS (SELECT ledger_txn_id AS id, account_id, value_date, amount FROM {p}rows
              WHERE ledger_txn_id NOT IN (SELECT ledger_txn_id FROM {p}exact UNION SELECT ledger_txn_id FROM {p}tolerance)),
flagged AS (SELECT ext_line_id, account_id, amount FROM {p}lines WHERE is_batched_settlement
            AND ext_line_id NOT IN (SELECT ext_line_id FROM {p}exact UNION SELECT ext_line_id FROM {p}tolerance)),
asked AS (SELECT f.* FROM free f SEMI JOIN flagged USING (account_id)),
upto AS (SELECT x.account_id, x.id, sum(y.amount) AS so_far FROM asked x JOIN asked y ON y.account_id = x.account_id
         AND (y.value_date < x.value_date OR y.value_date = x.value_date AND y.id <= x.id) GROUP BY ALL),
taken AS (SELECT account_id, arg_min(f, f.ext_line_id) AS f FROM flagged f JOIN upto USING (account_id)
          WHERE so_far = amount GROUP BY account_id)
SELECT taken.f.ext_line_id AS ext_line_id, upto.id AS ledger_txn_id FROM taken JOIN upto USING (account_id) WHERE so_far <= taken.f.amount""")


_passes("", "ledger", "external")

_fx("ledger_bridge", ["exact", "tolerance", "batched"], """
SELECT ext_line_id AS match_id, ledger_txn_id FROM exact UNION ALL
SELECT ext_line_id, ledger_txn_id FROM tolerance UNION ALL
SELECT ext_line_id, ledger_txn_id FROM batched""")

_fx("match_groups", ["exact", "tolerance", "batched"], """
SELECT ext_line_id AS match_id, CAST(1 AS BIGINT) AS run_id, CAST(NULL AS INTEGER) AS rule_id, 'AUTO' AS match_type,
       CAST(100 AS DECIMAL(5,2)) AS confidence_score, 'CONFIRMED' AS status, 'EXACT' AS pass_name FROM exact
UNION ALL
SELECT ext_line_id, 1, NULL, 'AUTO', confidence_score, 'CONFIRMED', 'TOLERANCE' FROM tolerance
UNION ALL
SELECT DISTINCT ext_line_id, 1, NULL, 'AUTO', CAST(100 AS DECIMAL(5,2)), 'CONFIRMED', 'BATCH' FROM batched""")

_fx("recon_exceptions", ["ledger", "external", "ledger_bridge", "match_groups"], """
SELECT ledger_txn_id * 2 AS exception_id, ledger_txn_id, CAST(NULL AS BIGINT) AS ext_line_id,
       'MISSING_EXTERNAL' AS exception_type
FROM ledger lt WHERE NOT EXISTS (SELECT 1 FROM ledger_bridge b WHERE b.ledger_txn_id = lt.ledger_txn_id)
UNION ALL
SELECT ext_line_id * 2 + 1, NULL, ext_line_id, 'MISSING_INTERNAL'
FROM external ex WHERE NOT EXISTS (SELECT 1 FROM match_groups g WHERE g.match_id = ex.ext_line_id)""")


def with_fixtures(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first).  A body
    starting with ``,`` continues the WITH list with its own CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FIXTURES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n][1]}\n)" for n in order)
    body = body.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ctes}" + (body if body.startswith(",") else "\n" + body)

_fx("statement_file", ["external"], """
SELECT CASE WHEN ext_line_id % 101 = 0 THEN 'EXT-DUP-' || CAST(ext_line_id % 7 AS VARCHAR) ELSE external_ref END
         AS external_ref,
       CASE WHEN ext_line_id % 103 = 0 THEN 'ACC-X' || CAST(ext_line_id % 13 AS VARCHAR) ELSE account_ref END
         AS account_ref,
       CASE WHEN ext_line_id % 97 = 0 THEN '-' || CAST(amount AS VARCHAR) WHEN ext_line_id % 107 = 0 THEN 'n/a'
            ELSE CAST(amount AS VARCHAR) END AS amount,
       CASE WHEN ext_line_id % 109 = 0 THEN 'G1P' WHEN ext_line_id % 113 = 0 THEN lower(currency) ELSE currency END
         AS currency,
       CASE WHEN ext_line_id % 127 = 0 THEN NULL ELSE strftime(value_date, '%Y-%m-%d') END AS value_date,
       strftime(settlement_date, '%Y-%m-%d') AS settlement_date,
       CASE WHEN is_batched_settlement THEN (CASE WHEN ext_line_id % 2 = 0 THEN 'TRUE' ELSE 'true' END)
            WHEN ext_line_id % 3 = 0 THEN NULL ELSE 'false' END AS is_batched_settlement
FROM external""")

_fx("ledger_file", ["ledger"], """
SELECT CASE WHEN ledger_txn_id % 211 = 0 THEN 'NEW-DUP-' || CAST(ledger_txn_id % 5 AS VARCHAR)
            WHEN ledger_txn_id % 157 = 0 THEN txn_ref ELSE 'NEW-' || CAST(ledger_txn_id AS VARCHAR) END AS txn_ref,
       CASE WHEN ledger_txn_id % 199 = 0 THEN 'ACC-UNKNOWN' ELSE 'ACC-' || CAST(account_id AS VARCHAR) END
         AS account_ref,
       CASE WHEN ledger_txn_id % 193 = 0 THEN 'REFUND' ELSE txn_type END AS txn_type,
       CASE WHEN ledger_txn_id % 191 = 0 THEN '-' || CAST(amount AS VARCHAR) WHEN ledger_txn_id % 181 = 0 THEN 'x'
            ELSE CAST(amount AS VARCHAR) END AS amount,
       lower(currency) AS currency,
       CASE WHEN ledger_txn_id % 179 = 0 THEN NULL ELSE strftime(value_date, '%Y-%m-%d') END AS value_date,
       CASE WHEN ledger_txn_id % 173 = 0 THEN repeat('c', 151) WHEN ledger_txn_id % 2 = 0 THEN NULL
            ELSE 'CP ' || CAST(ledger_txn_id % 50 AS VARCHAR) END AS counterparty,
       CASE WHEN ledger_txn_id % 3 = 0 THEN NULL ELSE 'order book' END AS narrative
FROM ledger""")

_fx("actions", ["users"], """
WITH e AS (SELECT ev.event_id, CAST(ev.user_id AS VARCHAR) AS u, CAST(ev.ts AS TIMESTAMP) AS ts, us.role AS u_role
           FROM events ev LEFT JOIN users us ON us.user_id = CAST(ev.user_id AS VARCHAR))
SELECT event_id AS exception_id, CAST(seq AS BIGINT) AS seq, action, actor, actor_role,
       CAST(expected_version AS INTEGER) AS expected_version, assign_to, note, ts + to_hours(seq) AS acted_at FROM (
  SELECT event_id, ts, 1 AS seq, 'assign' AS action, '1' AS actor, CASE WHEN event_id % 23 <> 0 THEN 'ADMIN' END AS actor_role,
         CAST(NULL AS INTEGER) AS expected_version, u AS assign_to, CAST(NULL AS VARCHAR) AS note FROM e
  UNION ALL SELECT event_id, ts, 2, 'start', u, u_role, NULL, NULL, NULL FROM e
  UNION ALL SELECT event_id, ts, 3, 'resolve', u, u_role, CASE WHEN event_id % 19 <> 0 THEN 3 END, NULL,
                   CASE WHEN event_id % 7 = 0 THEN 'ok' ELSE 'matched to statement' END FROM e
  UNION ALL SELECT event_id, ts, 4, 'resolve', u, u_role, 3, NULL, 'late retry' FROM e WHERE event_id % 4 = 0
  UNION ALL SELECT event_id, ts, 5, 'approve', '3', CASE WHEN event_id % 10 <> 0 THEN 'ANALYST' END, 4, NULL, NULL FROM e WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, ts, 6, 'approve', '1', 'ADMIN', CASE WHEN event_id % 17 <> 0 THEN 4 END, NULL, NULL FROM e
  UNION ALL SELECT event_id, ts, 7, 'close', '1', 'ADMIN', 5, NULL, NULL FROM e)""")

_CODE = """CASE WHEN a.action = 'assign' THEN (CASE WHEN coalesce(a.actor_role, '') NOT IN ('ADMIN', 'APPROVER') THEN 'FORBIDDEN'
                 WHEN st.status IN ('RESOLVED', 'APPROVED', 'CLOSED') THEN 'INVALID_STATE' END)
     WHEN a.action = 'start' THEN (CASE WHEN coalesce(a.actor_role, '') NOT IN ('ANALYST', 'APPROVER', 'ADMIN') THEN 'FORBIDDEN'
                 WHEN coalesce(st.assigned_to <> a.actor, true) OR st.status <> 'ASSIGNED' THEN 'INVALID_STATE' END)
     WHEN a.action = 'resolve' THEN (CASE WHEN coalesce(a.actor_role, '') NOT IN ('ANALYST', 'APPROVER', 'ADMIN') THEN 'FORBIDDEN'
                 WHEN coalesce(length(trim(a.note)), 0) < 5 THEN 'VALIDATION'
                 WHEN st.version IS DISTINCT FROM a.expected_version THEN 'VERSION_CONFLICT' END)
     WHEN a.action IN ('approve', 'close') THEN (CASE WHEN coalesce(a.actor_role, '') NOT IN ('ADMIN', 'APPROVER') THEN 'FORBIDDEN'
                 WHEN st.version IS DISTINCT FROM a.expected_version THEN 'VERSION_CONFLICT' END)
     ELSE 'UNKNOWN_ACTION' END"""

_fx("acts", ["actions"], "SELECT *, row_number() OVER (PARTITION BY exception_id ORDER BY seq) AS step FROM actions")

_fx("wf", ["acts"], f"""
SELECT event_id AS exception_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action,
       CAST(NULL AS VARCHAR) AS code, 'UNASSIGNED' AS status, 1 AS version, CAST(NULL AS VARCHAR) AS assigned_to,
       0 AS n_accepted, 0 AS n_rejected
FROM events
UNION ALL
SELECT exception_id, step, seq, action, code,
       CASE WHEN code IS NULL THEN ns ELSE status END, version + CASE WHEN code IS NULL THEN 1 ELSE 0 END,
       CASE WHEN code IS NULL AND action = 'assign' THEN assign_to ELSE assigned_to END,
       n_accepted + CASE WHEN code IS NULL THEN 1 ELSE 0 END, n_rejected + CASE WHEN code IS NULL THEN 0 ELSE 1 END
FROM (SELECT st.exception_id, a.step, a.seq, a.action, a.assign_to, st.status, st.version, st.assigned_to,
             st.n_accepted, st.n_rejected,
             CASE a.action WHEN 'assign' THEN 'ASSIGNED' WHEN 'start' THEN 'IN_PROGRESS' WHEN 'resolve' THEN 'RESOLVED'
                           WHEN 'approve' THEN 'APPROVED' WHEN 'close' THEN 'CLOSED' END AS ns,
             {_CODE} AS code
      FROM wf st JOIN acts a ON a.exception_id = st.exception_id AND a.step = st.step + 1)""")


def _hot(body: str) -> str:
    return body.replace("o_custkey", "(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END)")


_fx("hot_ledger", [], _hot(FIXTURES["ledger"][1]))
_fx("hot_external", ["hot_ledger"], FIXTURES["external"][1].replace("FROM ledger", "FROM hot_ledger"))
_passes("hot_", "hot_ledger", "hot_external")

# the feed as the import publishes it, and a run's scope: one date, the newest batch that can be used
_fx("imp_external", ["external"], """
SELECT 1 * 2147483648 + row_number() OVER (ORDER BY external_ref) AS ext_line_id, * EXCLUDE (ext_line_id) FROM external""")
_passes("imp_", "ledger", "imp_external")

_fx("usable", ["batches", "sources", "external"], """
SELECT b.* FROM batches b SEMI JOIN external USING (batch_id)
WHERE status = 'COMPLETED' AND source_id NOT IN (SELECT source_id FROM sources WHERE file_format = 'DATABASE')""")
_fx("newest", ["usable"], """
SELECT * FROM usable a WHERE NOT EXISTS (SELECT 1 FROM usable b WHERE b.completed_at > a.completed_at
  OR a.completed_at IS NULL AND b.completed_at IS NOT NULL OR b.completed_at IS NOT DISTINCT FROM a.completed_at AND b.batch_id > a.batch_id)""")
_fx("sc_ledger", ["ledger"], "SELECT * FROM ledger WHERE value_date = DATE '1998-12-31'")
_fx("sc_external", ["external", "newest"], "SELECT * FROM external SEMI JOIN newest USING (batch_id)")
_passes("sc_", "sc_ledger", "sc_external")

# a year's rows on its last day, all lines in one batch, and the run of the first such day
_fx("ye_ledger", [], FIXTURES["ledger"][1].replace("CAST(o_orderdate AS DATE)", "make_date(year(CAST(o_orderdate AS DATE)), 12, 31)"))
_fx("ye_external", ["ye_ledger"], FIXTURES["external"][1].replace("FROM ledger", "FROM ye_ledger").replace("1 + acct % 10", "1"))
_fx("ye_day", ["ye_ledger"], "SELECT * FROM ye_ledger WHERE value_date = (SELECT min(value_date) FROM ye_ledger)")
_passes("ye_", "ye_day", "ye_external")

# all year-end dates in sequence: no window reaches from one to the next, so the first two passes are those of the
# whole tables; running totals are of one date, and a flagged line goes to the first date with its amount
_passes("yr_", "ye_ledger", "ye_external")
_fx("yr_free", ["yr_exact", "yr_tolerance"], """
SELECT ledger_txn_id AS id, account_id, value_date, sum(amount) OVER (PARTITION BY account_id, value_date ORDER BY ledger_txn_id) AS so_far
FROM yr_rows ANTI JOIN (SELECT ledger_txn_id FROM yr_exact UNION ALL SELECT ledger_txn_id FROM yr_tolerance) USING (ledger_txn_id)""")
_fx("yr_hit", ["yr_free"], """
SELECT ext_line_id, x.account_id, x.amount, min(f.value_date) AS value_date
FROM yr_lines x JOIN yr_free f ON f.account_id = x.account_id AND f.so_far = x.amount
WHERE is_batched_settlement AND ext_line_id NOT IN (SELECT ext_line_id FROM yr_exact UNION SELECT ext_line_id FROM yr_tolerance) GROUP BY ALL""")
