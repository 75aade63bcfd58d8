"""Driver contract: entry smoke and Spark vs DuckDB on sf0.001."""
import pytest

import __spark_entry__ as E
from ledgerlens.checks.compare import compare, duck

from conftest import SF

FAST = ["exact_match", "tolerance_match", "batch_match", "recon_exceptions", "recon_run_totals", "daily_summary",
        "exception_trend", "ops_kpis", "sla_deadlines", "reversal_chains", "validate_statement", "validate_ledger",
        "workflow_replay", "audit_diff", "upsert_latest", "integrity_audit", "exception_page"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ledger_txn_id", "ext_line_id", "amount_diff", "day_diff"]


def test_every_query_has_oracle_or_is_a_fold():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) <= {"op1_importance_sample", "op2_byte_bpe", "pipeline"}


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    con = duck(SF)
    res = compare(spark, con, E.queries()[name](spark, SF), E.oracle_sql()[name])
    assert res["columns_match"] and res["values_match"], res


def test_global_run_expected_counts(spark):
    """FIXTURES.md §4, sf0.001 row: the counts of the global run."""
    from pyspark.sql import functions as F
    from ledgerlens.catalog import global_run
    from ledgerlens.sources.fixtures import Fixtures
    fx = Fixtures(spark, SF)
    r = global_run(fx)
    assert fx.ledger.count() == 1500 and fx.external.count() == 1337
    assert str(fx.external.agg(F.sum("amount")).first()[0]) == "339065889.10"
    assert r.exact.count() == 1181 and r.tolerance.count() == 92
    assert r.batched.select("ext_line_id").distinct().count() == 15 and r.batched.count() == 45
    types = {x.exception_type: x["count"] for x in r.exceptions.groupBy("exception_type").count().collect()}
    assert types == {"MISSING_EXTERNAL": 182, "MISSING_INTERNAL": 49}


def test_plans_have_no_cross_products_or_python(spark, monkeypatch):
    """Plan-quality guard: no registered query of the reference's own operators
    plans a cartesian product, a nested-loop join or a Python UDF, nor do the
    steps that it writes on its way."""
    import contextlib
    import io
    import sys

    from ledgerlens import catalog, session
    plans, write = [], session.materialize

    def seen(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plans.append(buf.getvalue())
        return df

    def watched(df, *args, **kwargs):
        return write(seen(df), *args, **kwargs)

    users = [m for n, m in sys.modules.items() if n.startswith("ledgerlens") and getattr(m, "materialize", None) is write]
    for m in users:
        monkeypatch.setattr(m, "materialize", watched)
    for cache in (catalog._RECON_CACHE, catalog._WF_CACHE, catalog._SCOPED_CACHE, catalog._YEAR_END_CACHE, catalog._FACTS, catalog._IMPORTED):
        monkeypatch.setattr(catalog, next(k for k, v in vars(catalog).items() if v is cache), {})
    bad = {}
    for name, q in catalog.QUERIES.items():
        plans.clear()
        seen(q(spark, SF))
        found = {k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups") for p in plans if k in p}
        if found:
            bad[name] = found
    assert bad == {}
