"""Registered queries against their SQL, and the entry's guard."""
import pytest

import __spark_entry__ as E
from ledgerlens.checks.compare import compare, duck
from ledgerlens.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    res = compare(spark, duck(SF), Q.QUERIES[name](spark, SF), Q.ORACLE[name])
    assert res["columns_match"] and res["values_match"], res


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op5_secret_links", "op7_quality_rules", "op10_host_rank"])
def test_no_python_in_native_plans(spark, name, capsys):
    Q.QUERIES[name](spark, SF).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow", "MapIn"))
