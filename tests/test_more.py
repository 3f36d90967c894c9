"""Operators without a registered query, and edge cases."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__
from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import evidence, governance, indicators, market
from fundamentals_spark.plans.recompute import recompute

day = dt.date.fromisoformat


def test_mojibake_and_basis(spark):
    df = spark.createDataFrame([("VendasÃ©",), ("Ã",), ("ok é",), (None,)], "t string")
    assert [r[0] for r in df.select(T.repair_mojibake(F.col("t"))).collect()] == ["Vendasé", "Ã", "ok é", None]
    b = spark.createDataFrame([("VGV (100%)",), ("% Companhia",), ("VGV",)], "t string")
    assert [r[0] for r in b.select(T.ownership_basis(F.col("t"))).collect()] == ["one_hundred_percent", "company_share", "unknown"]


def test_depreciation_ladder(spark):
    df = spark.createDataFrame([(None, -3.0, 1.0, None), (None, None, None, [4.0]), (None, None, None, [4.0, 5.0]), (2.0, 1.0, None, None), (None, None, None, None)], "explicit double, dva double, combined double, candidates array<double>")
    assert [(r.da, r.error) for r in indicators.depreciation_ladder(df).collect()] == [(3.0, None), (4.0, None), (None, "ambiguous_candidates"), (2.0, None), (None, None)]


def test_cycle_from_records(spark):
    b = spark.createDataFrame([(1, day("2024-12-31"), 100.0, 10.0, 5.0), (1, day("2025-12-31"), 200.0, 10.0, 5.0), (2, day("2024-12-31"), 1.0, 1.0, 1.0)], "company int, ref_date date, receivables double, inventories double, payables double")
    f = spark.createDataFrame([(1, day("2025-10-01"), day("2025-12-31"), 1.0, -1.0), (1, day("2025-01-01"), day("2025-12-31"), 1000.0, -500.0), (2, day("2025-01-01"), day("2025-12-31"), 9.0, -9.0)], "company int, start date, end date, revenue double, cogs double")
    got = {r.company: r for r in indicators.cash_cycle_records(b, f, F.lit("2025-12-31").cast("date")).collect()}
    assert (got[1].days, got[1].pmr) == (365, 54.75) and got[2].error == "missing_balance"


def test_income_statement_lines(spark):
    d = day("2025-12-31")
    facts = spark.createDataFrame([(1, d, "3.01", "Receita", 10.0), (1, d, "3.02", "Custo", -4.0), (1, d, "3.05", "EBIT", 3.0)], "company int, ref_date date, code string, description string, value double")
    lines = spark.createDataFrame([(1, d, "3.02", "Margem", 0.6)], "company int, ref_date date, after string, description string, value double")
    got = [(r.description, r.sign) for r in indicators.augment_income_statement(facts, lines).orderBy("place").collect()]
    assert got == [("Receita", "+"), ("Custo", "-"), ("Margem", "+"), ("EBIT", "+")]


def test_flags(spark):
    r = spark.range(2).select(indicators.flags((F.col("id") > 0, "ebitda", "incomplete", "less than four quarters"), (F.lit(False), "x", "y", "z")).alias("f")).collect()
    assert [len(x.f) for x in r] == [0, 1] and r[1].f[0].status == "incomplete"


def test_build_and_flatten_observations(spark):
    cells = spark.createDataFrame([("d", "INNC3", "launches_vgv", "VGV lançado (100%)", "1T26", 250000.0, "R$ mil", "markdown", ""), ("d", "INNC3", "sales", "Vendas", None, -1.0, "R$ mil", "markdown", "% companhia"), ("d", "X", None, "?", None, 1.0, "", "markdown", "")], "doc string, ticker string, metric string, label string, period string, value double, unit string, source string, context string")
    profile = spark.createDataFrame([("INNC3", "sales", "one_hundred_percent", "positive")], "ticker string, metric string, expected_basis string, expected_sign string")
    got = {r.metric: r for r in evidence.build_observations(cells, profile).collect()}
    assert set(got) == {"launches_vgv", "sales"}
    assert (got["launches_vgv"].value, got["launches_vgv"].unit, got["launches_vgv"].ownership_basis) == (250.0, "BRL million", "one_hundred_percent")
    assert got["sales"].validation_flags == ["unexpected_basis", "unexpected_sign", "missing_period"]
    docs = spark.createDataFrame([("T", {"m": [(1.0, "1T26"), (2.0, "2T26")]}), ("U", {})], "ticker string, metrics map<string, array<struct<value: double, period: string>>>")
    assert sorted(map(tuple, evidence.flatten_observations(docs).collect())) == [("T", "m", 1.0, "1T26"), ("T", "m", 2.0, "2T26")]


def test_override_validation_and_manifest_scope(spark):
    o = spark.createDataFrame([("A", "retail", "m", 1, 1.0), ("A", "health", "m", 1, 1.0), ("A", "retail", "?", 1, 1.0), ("A", "retail", "m", 5, 1.0), ("A", "retail", "m", 1, float("inf")), ("A", "retail", "m", 1, None)], "ticker string, sector string, metric string, q int, value double")
    assert governance.validate_overrides(o, spark.createDataFrame([("A", "retail")], "ticker string, sector string"), ["m"]).count() == 1
    prev = spark.createDataFrame([("override", "o"), ("financial", "f0"), ("operational", "p0")], "component string, path string")
    cur = spark.createDataFrame([("financial", "f1"), ("operational", "p1")], "component string, path string")
    paths = lambda scope: sorted(r.path for r in governance.merge_manifest_scope(prev, cur, scope).collect())
    assert (paths("all"), paths("financial"), paths("operational")) == (["f1", "o", "p1"], ["f1", "o", "p0"], ["f0", "o", "p0", "p1"])


def test_snapshot_gate(spark):
    s = spark.createDataFrame([("retail", "v1", 3, None), ("health", "v1", 3, None), ("retail", None, 0, None), ("retail", "v1", 0, "empty_accepted")], "sector string, version string, observations int, state string")
    assert [r.errors for r in governance.validate_snapshots(s, "retail", ("version",)).collect()] == [[], ["wrong_sector"], ["missing_version", "no_observations"], []]


def test_return_diagnostics(spark):
    r = spark.createDataFrame([(1, day("2025-03-31"), 30, 10.0, 0.9), (1, day("2025-06-30"), 30, None, None), (1, day("2025-09-30"), 30, 200.0, 0.5)], "sector int, ref_date date, horizon int, used_cap double, top_weight double")
    assert [(x.concentrated, x.cap_change, x.jump) for x in market.return_diagnostics(r).orderBy("ref_date").collect()] == [(True, None, False), (None, None, False), (False, 20.0, True)]


def test_recompute(spark, tmp_path):
    bp = spark.createDataFrame([(1, day("2026-03-31"), "1.01.01", "x", 5.0), (1, day("2026-03-31"), "2.01.04", "x", 9.0)], "company int, ref_date date, code string, description string, value double")
    bp.withColumn("value", F.col("value").cast("decimal(38,4)")).write.parquet(str(tmp_path / "balances"))
    out, missing = recompute(spark, str(tmp_path))
    assert float(out["net_debt"].first().net_debt) == 4.0
    assert sorted(map(tuple, missing.collect())) == [("ebitda_ltm", "quarter_facts"), ("enterprise_value", "market_caps")]


def test_every_oracle_has_a_query(spark):
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q)
    assert __spark_entry__.entry(spark).count() > 0
