"""How often queries read their tables, and that no date's rows are held together, from Spark's plans."""

import re
from datetime import date

import pytest

from fundamentals_spark.operators import filings
from fundamentals_spark.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_modes_in_one_pass(spark):
    assert "Union" not in plan_of(registry.queries()["c03_exercise_order"](spark, SF))


def test_scope_without_window_over_all_rows(spark):
    d = date(2024, 3, 31)
    rows = [(0, d, "b", 2, "DF Individual", 1.0), (0, d, "a", 3, "DF Individual", 2.0), (None, d, "a", 4, None, 3.0), (1, None, "a", 5, "DF Consolidado", 4.0), (1, None, "a", 6, "DF Individual", 5.0)]
    df = spark.createDataFrame(rows, "company int, ref_date date, code string, ordinal int, scope string, value double")
    out = filings.select_registered_scope(df, spark.createDataFrame([(0, "Consolidado"), (1, "auto")], "company int, statement_scope string"))
    assert sorted((r.ordinal, r.value, r.scope_error) for r in out.collect()) == [(3, None, "scope_not_found"), (4, 3.0, None), (5, 4.0, None)]
    assert not re.search(r"max\([^\n]*windowspecdefinition", plan_of(out))


@pytest.mark.parametrize("name,tables", [("e14_cycle_accounts", 3), ("e12_sector_cycle", 9)])
def test_cycle_reads_its_filings_once(spark, name, tables):
    """Three tables a pass: the accounts; for the cycle also the flows, and balances at both ends of the period."""
    assert len(re.findall(r"(?<!Local)Relation \[", plan_of(registry.queries()[name](spark, SF)))) == tables


@pytest.mark.parametrize("name", ["e14_cycle_accounts", "e12_sector_cycle", "e07_ltm"])
def test_lines_are_shuffled_once(spark, name):
    """To their orders, which know their companies by then; names of accounts are sent to the tasks, lines without one are dropped before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = [(re.search("[A-Za-z]", x).start(), x) for x in plan.splitlines() if re.search("[A-Za-z]", x)]
    scans = [i for i, (_, x) in enumerate(nodes) if "FileScan" in x and "l_orderkey" in x]
    assert scans
    for i in scans:
        depth, above = nodes[i][0], []
        for d, x in reversed(nodes[:i]):
            if d < depth:
                depth = d
                above.append(x)
        below = above[: next(k for k, x in enumerate(above) if "HashAggregate" in x)]
        assert sum("Exchange hashpartitioning" in x for x in below) == 1, "\n".join(below)
        first = next(k for k, x in enumerate(below) if "Exchange" in x)
        assert "to_code" not in "".join(above) or any("Filter" in x and "1.01.01|Conta 0" in x for x in below[:first])
