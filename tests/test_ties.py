"""Rows that the declared order leaves equal: the first stored one stands, as in the SQL."""

from datetime import datetime

import pytest

from fundamentals_spark.plans import registry

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two companies; every order has line 7 four times, and each time another part and price."""
    d = str(tmp_path_factory.mktemp("ties"))
    day = datetime(1998, 5, 4)
    lines = [(k, part, 0, 7, 1.0, 100.0 * part + k, 0.0, 0.0, flag, "F", day) for part in (3, 1, 4, 2) for k, flag in ((1, "R"), (2, "A"), (3, "R"))]
    spark.createDataFrame(lines, LINE).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, 0, "F", day), (2, 1, "O", day), (3, 1, "F", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0, 5), (1, 6)], "c_custkey long, c_nationkey long").write.parquet(f"{d}/customer.parquet")
    return d


@pytest.fixture(params=["10m", "-1"])
def joins(spark, request):
    """Equal rows come in another order out of joins by broadcast and by merge."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_master_accounts_of_equal_rows(spark, tables, joins):
    got = {(r.statement, r.code): r.description for r in registry.queries()["d01_master_accounts"](spark, tables).collect()}
    assert got == {("BP", "1.01.01"): "Conta 3", ("DRE", "3.01.01"): "Conta 3"}


def test_latest_restatement_of_equal_rows(spark, tables, joins):
    got = {(r.company, r.code): (r.value, r.version) for r in registry.queries()["c05_latest_restatement"](spark, tables).collect()}
    assert got == {(5, "3.01.01"): (301.0, 7), (6, "3.01.01"): (303.0, 7)}
