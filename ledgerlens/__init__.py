"""ledgerlens: ledger-to-statement reconciliation and break analytics on Spark.

Every operator is a function from DataFrames to a DataFrame.  The package is
laid out by role:

* ``sources``   -- readers (CSV statements / ledgers, bank extract, batch
                   manifests) and the deterministic fixtures derived from the
                   shared Parquet test tables.
* ``operators`` -- matching passes, validation rules, exception queues,
                   reversal chains, workflow replay, history/audit jobs.
* ``functions`` -- small column expressions (money casts, SLA deadlines,
                   confidence scores, ...).
* ``plans``     -- composite jobs: the reconciliation run and the reports.
* ``streaming`` -- Structured Streaming twins of ingest, matching, dedupe,
                   break counts and workflow state.
"""

from ledgerlens.config import MatchConfig
from ledgerlens.session import get_spark, materialize

__all__ = ["MatchConfig", "get_spark", "materialize"]
