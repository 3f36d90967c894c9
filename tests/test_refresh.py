"""Recomputation that writes: only what changed, in order of the graph, and nothing on a second run."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.operators import indicators
from fundamentals_spark.plans.recompute import DERIVED, refresh
from fundamentals_spark.sources import store as S

# the market value needs the net debt: two tables that depend on one another
PAIR = {n: DERIVED[n] for n in ("net_debt", "enterprise_value")}
DAY = date(2026, 3, 31)
BP = "company int, ref_date date, code string, description string, value double, sector string"


def put(spark, path, rows, schema, decimals=()):
    df = spark.createDataFrame(rows, schema)
    S.replace_partitions(df.withColumns({c: F.col(c).cast("decimal(38,4)") for c in decimals}), path, ["sector"])


def balances(company, cash, debt, sector):
    return [(company, DAY, "1.01.01", "x", cash, sector), (company, DAY, "2.01.04", "x", debt, sector)]


def done(df):
    return {(r.derived, r.sector): r.status for r in df.collect()}


def files_below(path):
    return {(str(p), p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet") if "_recomputed" not in str(p)}


def test_refresh(spark, tmp_path):
    top = str(tmp_path)
    put(spark, f"{top}/balances", balances(1, 5.0, 9.0, "retail") + balances(1, 1.0, 2.0, "health"), BP, ["value"])
    first = refresh(spark, top)
    assert {r.missing_input for r in first.filter("status = 'missing_inputs'").collect()} == {"market_caps", "quarter_facts", "retail_observations"}
    assert {v for (n, s), v in done(first).items() if n == "net_debt"} == {"success"}
    debt = lambda: {r.sector: float(r.net_debt) for r in spark.read.parquet(f"{top}/net_debt").collect()}
    assert debt() == {"retail": 4.0, "health": 1.0}  # company 1 of two sectors stays apart

    put(spark, f"{top}/market_caps", [(1, DAY, 100.0, "validated", "retail"), (1, DAY, 10.0, "validated", "health")], "company int, ref_date date, market_cap double, status string, sector string")
    second = done(refresh(spark, top, derived=PAIR))
    assert second[("net_debt", "retail")] == "unchanged" and second[("enterprise_value", "retail")] == "success"
    ev = lambda: {r.sector: r.ev for r in spark.read.parquet(f"{top}/enterprise_value").collect()}
    assert ev() == {"retail": 104.0, "health": 11.0}

    before = files_below(top)
    assert {s for s in done(refresh(spark, top, derived=PAIR)).values()} == {"unchanged"} and files_below(top) == before

    put(spark, f"{top}/balances", balances(1, 5.0, 19.0, "retail"), BP, ["value"])  # one sector changes
    health = {f for f in before if "sector=health" in f[0]}
    market = done(refresh(spark, top, "market", PAIR))  # its net debt is out of scope and stands
    assert market[("net_debt", None)] == "skipped_by_scope" and market[("enterprise_value", "retail")] == "unchanged"
    third = done(refresh(spark, top, derived=PAIR))
    assert {k: third[k] for k in third if k[0] in ("net_debt", "enterprise_value")} == {("net_debt", "retail"): "success", ("net_debt", "health"): "unchanged", ("enterprise_value", "retail"): "success", ("enterprise_value", "health"): "unchanged"}
    assert debt() == {"retail": 14.0, "health": 1.0} and ev()["retail"] == 114.0 and health <= files_below(top)

    put(spark, f"{top}/balances", [(1, DAY, "9.99", "other", 3.0, "retail")] + balances(1, 5.0, 19.0, "retail"), BP, ["value"])  # no effect on net debt
    fourth = done(refresh(spark, top, derived=PAIR))
    assert fourth[("net_debt", "retail")] == "success" and fourth[("enterprise_value", "retail")] == "unchanged"

    S.delete(spark, f"{top}/balances/sector=health")
    fifth = done(refresh(spark, top, derived=PAIR))
    assert fifth[("net_debt", "health")] == "success" and debt() == {"retail": 14.0} and ev() == {"retail": 114.0}
    assert set(done(refresh(spark, top, derived=PAIR)).values()) == {"unchanged"}
    sixth = done(refresh(spark, top, derived=PAIR, version=2))
    assert {sixth[(n, "retail")] for n in PAIR} == {"success"}


def test_refresh_after_a_run_that_died(spark, tmp_path):
    top = str(tmp_path)
    put(spark, f"{top}/balances", balances(1, 5.0, 9.0, "a/b=c"), BP, ["value"])

    def dies(bp):
        raise RuntimeError("lost")

    rules = {"net_debt": ("financial", ("balances",), indicators.net_debt)}
    refresh(spark, top, derived=rules)
    put(spark, f"{top}/balances", balances(1, 5.0, 8.0, "a/b=c"), BP, ["value"])
    with pytest.raises(RuntimeError):
        refresh(spark, top, derived={"net_debt": ("financial", ("balances",), dies)})
    put(spark, f"{top}/balances", balances(1, 5.0, 9.0, "a/b=c"), BP, ["value"])  # back to what was logged before the run died
    assert done(refresh(spark, top, derived=rules)) == {("net_debt", "a/b=c"): "success"}
    assert float(spark.read.parquet(f"{top}/net_debt").first().net_debt) == 4.0


def test_refresh_of_retail_rows(spark, tmp_path):
    top = str(tmp_path)
    schema = "ticker string, period string, metric string, value double, scope string, status string, segment string, area_basis string, ordinal int, origin string, sector string"
    rows = [("A", "1T26", "digital_revenue_brl", 30.0, None, "valid", "consolidated", None, 1, None, "retail"), ("A", "1T26", "comparable_total_revenue_brl", 60.0, None, "valid", "consolidated", None, 2, "reported", "retail"), ("A", "1T26", "digital_revenue_brl", 99.0, None, "valid", "consolidated", None, 3, "derived", "retail")]
    put(spark, f"{top}/retail_observations", rows, schema)
    assert done(refresh(spark, top, "retail"))[("retail_derived", "retail")] == "success"
    got = {r.metric: r.value for r in spark.read.parquet(f"{top}/retail_derived").collect()}
    assert got == {"digital_revenue_share": 0.5, "physical_revenue_per_sqm": None}
