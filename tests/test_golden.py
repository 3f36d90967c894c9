"""Hand-computed results of the fundamentals operators."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import accounts, evidence, filings, governance, indicators, market
from fundamentals_spark.operators.asof import asof

day = dt.date.fromisoformat


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_net_debt(spark):
    bp = spark.createDataFrame([(1, day("2026-03-31"), c, "x", D(v)) for c, v in (("1.01.01", 100), ("1.01.02", 50), ("2.01.04", 300), ("2.02.01", 500))], "company int, ref_date date, code string, description string, value decimal(38,4)")
    r = one(indicators.net_debt(bp))
    assert (r.net_debt, r.deducted, r.error) == (D(650), D(50), None)
    assert one(indicators.net_debt(bp.filter("code not like '2%'"))).error == "no_debt_account"
    assert one(indicators.net_debt(bp.filter("code <> '1.01.01'"))).error == "no_cash_account"


def test_ebitda_and_ltm(spark):
    q = spark.createDataFrame([(1, 2025, 3, 30.0, False), (1, 2025, 4, 40.0, False), (1, 2026, 1, 10.0, True), (1, 2026, 2, 30.0, True)], "company int, year int, q int, ebitda double, is_ytd boolean")
    iso = accounts.isolate_quarters(q, ["company"], "ebitda")
    assert {(r.year, r.q): r.ebitda for r in iso.collect()}[2026, 2] == 20.0
    out = {(r.year, r.q): r.ebitda_ltm for r in indicators.ltm(iso, "ebitda", ["company"]).collect()}
    assert out[2026, 2] == 100.0 and out[2026, 1] is None
    m = one(indicators.margins(spark.createDataFrame([(1000.0, -400.0, 100.0, 25.0)], "revenue double, cost double, ebit double, da double")))
    assert (m.ebitda, m.gross_margin, m.ebitda_margin) == (125.0, 60.0, 12.5)


def test_cash_cycle(spark):
    bp = spark.createDataFrame([(1, day("2024-12-31"), 100.0, 10.0, 5.0), (1, day("2025-12-31"), 200.0, 10.0, 5.0)], "company int, ref_date date, receivables double, inventories double, payables double")
    flows = spark.createDataFrame([(1, day("2025-01-01"), day("2025-12-31"), 1000.0, -500.0), (2, day("2025-01-01"), day("2025-12-31"), 1.0, -1.0)], "company int, start date, end date, revenue double, cogs double")
    got = {r.company: r for r in indicators.cash_cycle(bp, flows).collect()}
    assert got[1].pmr == 54.75 and got[1].error is None
    assert got[2].error == "missing_balance" and got[2].cycle is None


@pytest.mark.parametrize(
    "market_n,official,status,quantity",
    [(100000, 104000, "validated", 100000), (95962000, 95962, "validated", 95962000), (195434352, 1954343520, "shares_discrepancy", None), (None, 123456, "cvm_scale_ambiguous", None), (100, 110, "shares_discrepancy", None), (7, None, "yahoo_only", 7), (None, None, "missing", None)],
)
def test_share_validation(spark, market_n, official, status, quantity):
    df = spark.createDataFrame([(1, market_n, official)], "company int, market long, official long")
    r = one(market.validate_shares(market.infer_share_scale(df)))
    assert (r.status, r.quantity) == (status, quantity)


def test_proven_scale_validates_the_fallback(spark):
    df = spark.createDataFrame([(1, 100000, 100001), (1, None, 123456)], "company int, market long, official long")
    assert {r.official: (r.status, r.quantity) for r in market.validate_shares(market.infer_share_scale(df)).collect()}[123456] == ("cvm_fallback_validated_scale", 123456)


def test_prices_through_a_split(spark):
    p = spark.createDataFrame([(1, day("2025-08-26"), 6.60, 6.6, 0.0), (1, day("2025-08-28"), 8.25, 8.25, 0.05)], "company int, date date, close double, adj_close double, split_factor double")
    at = spark.createDataFrame([(1, day("2025-08-27")), (1, day("2025-08-28")), (1, day("2025-09-26"))], "company int, at date")
    assert {r["at"].isoformat(): r.price for r in market.price_as_of(p, at).collect()} == {"2025-08-27": 0.33, "2025-08-28": 8.25, "2025-09-26": None}


def test_classes(spark):
    c = spark.createDataFrame([(1, 20.0, 10, 1.0), (1, 25.0, 20, 1.0), (2, None, 5, 1.0), (2, 3.0, 5, 1.0)], "company int, price double, quantity long, weight double")
    assert {r.company: r.market_cap for r in market.class_market_cap(c, ["company"]).collect()} == {1: 700.0, 2: None}


def test_variation(spark):
    s = spark.createDataFrame([(1, day("2025-01-01") + dt.timedelta(days=d), p) for d, p in ((0, 80.0), (270, 100.0), (330, 110.0), (360, 120.0))], "company int, date date, adj_close double")
    assert {r.horizon: round(r.change_pct, 6) for r in market.price_variation(s).collect()} == {30: round((120 / 110 - 1) * 100, 6), 90: 20.0, 360: 50.0}


def test_sector_shares_and_multiple(spark):
    d = day("2026-03-31")
    caps = spark.createDataFrame([(1, d, "A", 100.0, None), (1, d, "B", 300.0, None), (1, d, "C", None, None), (1, d, "D", -1.0, None)], "sector int, ref_date date, company string, market_cap double, status string")
    got = {r.company: (r.share_pct, r.reason) for r in market.market_cap_share(caps).collect()}
    assert got == {"A": (25.0, None), "B": (75.0, None), "C": (None, "missing"), "D": (None, "not_positive")}
    assert [r.company for r in market.top_k(caps, 1).collect()] == ["B"]
    ev = spark.createDataFrame([(1, d, 1000.0, 100.0), (1, d, 500.0, -20.0), (2, d, 1000.0, 0.0), (2, d, 500.0, -20.0)], "sector int, ref_date date, ev double, ebitda_ltm double")
    assert {r.sector: r.ev_ebitda for r in market.sector_ev_ebitda(ev).collect()} == {1: 18.75, 2: None}


def test_sector_returns(spark):
    ref, start = day("2026-06-30"), day("2026-06-30") - dt.timedelta(days=360)
    reg = spark.createDataFrame([(1, 1), (1, 2)], "sector int, company int")
    caps = spark.createDataFrame([(1, start, 100.0, None), (2, start, 300.0, None)], "company int, ref_date date, market_cap double, status string")
    prices = spark.createDataFrame([(1, start, 10.0), (1, ref, 20.0), (2, start, 10.0), (2, ref, 5.0)], "company int, date date, adj_close double")
    dates = spark.createDataFrame([(1, ref)], "sector int, ref_date date")
    assert one(market.sector_returns(caps, prices, reg, dates, (360,))).weighted_return == -0.125
    assert one(market.sector_returns(caps, prices.filter("company = 1"), reg, dates, (360,))).weighted_return is None
    r = one(market.sector_returns(caps.filter("company = 1"), prices, reg.filter("company = 1").union(spark.createDataFrame([(1, 3)], reg.schema)), dates, (360,)))
    assert r.weighted_return is None and r.value_coverage is None


def test_identity(spark):
    reg = spark.createDataFrame([(1, "014460", "73178600000118"), (2, "000002", "2")], "company int, cvm_code string, cnpj string")
    f = spark.createDataFrame([(1, "014460", "73178600000118"), (2, None, "73178600000118"), (3, "014460", "2"), (4, "9", "9")], "k int, cvm_code string, cnpj string")
    assert {r.k: (r.company, r.match, r.error) for r in filings.resolve_issuer(f, reg).collect()} == {1: (1, "cd_cvm", None), 2: (1, "cnpj_fallback", None), 3: (None, None, "identity_conflict"), 4: (None, None, "not_registered")}


def test_cash_flow_methods(spark):
    f = spark.createDataFrame([(1, day("2022-06-30"), 1, "MI"), (1, day("2022-09-30"), 1, "MD"), (2, day("2022-06-30"), 1, "MI"), (2, day("2022-06-30"), 1, "MD")], "company int, ref_date date, version int, method string")
    rows, errors = filings.latest_cash_flow(f)
    assert sorted(r.company for r in rows.collect()) == [1, 1] and one(errors).company == 2


def test_units_numbers_periods(spark):
    df = spark.createDataFrame([("7.395", "R$ MM"), ("814.000", "R$ mil"), ("24,15", "R$ milhões"), ("24,15", "R$ bilhoes")], "n string, u string")
    got = [r.u.value for r in df.select(T.norm_unit(T.parse_number(F.col("n"), "operational").cast("double"), F.col("u")).alias("u")).collect()]
    assert got == pytest.approx([7395, 814, 24.15, 24150])
    nums = spark.createDataFrame([("1.234",), ("1.234,5",), ("(3,5)",), ("-",), ("n/d",), ("12%",), ("R$ 7",), ("1,234.5",), ("",), ("nan",), (None,)], "n string")
    assert [None if r[0] is None else float(r[0]) for r in nums.select(T.parse_number(F.col("n"))).collect()] == [1.234, 1234.5, -3.5, None, None, None, 7.0, 1234.5, None, None, None]
    p = spark.createDataFrame([("1T26",), ("2q2025",), ("6M26",), ("FY25",), ("2025",), ("LTM 3T25",), ("5T25",), ("1T99",)], "p string").select(T.parse_period(F.col("p"), 2026).alias("p"))
    assert [r.p and (r.p.label, r.p.kind) for r in p.collect()] == [("1T26", "quarter"), ("2T25", "quarter"), ("6M26", "ytd"), ("FY2025", "annual"), ("FY2025", "annual"), ("LTM 3T25", "ltm"), None, None]


def test_composite_cells(spark):
    df = spark.createDataFrame([("Vendas<br>6M26<br>6M25<br>Var%", "5.154<br>6.302<br>-18%")], "header string, text string")
    assert [(r.period, r.value) for r in evidence.explode_composite(df).collect()] == [("6M26", "5.154"), ("6M25", "6.302")]


def test_vso_roe_credit(spark):
    o = [("A", "s", 2025, 4, "inventory", 700.0), ("A", "s", 2026, 1, "net_sales", 300.0), ("A", "s", 2026, 1, "launches", 300.0), ("A", "s", 2026, 1, "inventory", 700.0)]
    r = evidence.vso(spark.createDataFrame(o, "ticker string, basis string, year int, q int, metric string, value double")).filter("year = 2026").first()
    assert (r.vso, r.status, r.reconciled) == (0.3, "ok", True)
    assert one(evidence.roe(spark.createDataFrame([(120.0, 900.0, 1100.0)], "income double, equity_open double, equity_close double"))).roe == 0.12
    c = one(evidence.credit_loss_proxy(spark.createDataFrame([(-20.0, None, 180.0)], "allowance double, gross double, net double")))
    assert (c.gross_used, c.proxy) == (200.0, 0.1)


def test_annualize_and_quarantine(spark):
    o = [("f", "flow", 2025, q, float(q)) for q in (1, 2, 3, 4)] + [("g", "flow", 2025, 1, 1.0), ("s", "stock", 2025, 4, 9.0), ("r", "ratio", 2025, 4, 1.0)]
    got = {r.metric: r.value for r in evidence.annualize(spark.createDataFrame(o, "metric string, nature string, year int, q int, value double"), ["metric"]).collect()}
    assert got == {"f": 10.0, "s": 9.0}
    x = [
        ("Por Região", "| Total | **7.395** | R$ MM |", 0.626625, None, "breakdown_as_total"), ("Total consolidado", "| Total consolidado | **814.000** |", 0.000814, "R$ mil", "scale_incompatible_with_evidence"),
        ("Vendas", "**814**", 814.0, None, None), ("Total por região", "**7**", 7.0, None, None), ("Vendas", "814.000 sem negrito", 0.1, None, None), ("By product", "", 1.0, None, "breakdown_as_total"),
        ("Vendas", "**9000** **8000** **7000** **6000** **1**", 1.0, None, "scale_incompatible_with_evidence"), ("Vendas", "**9000** **1**", 1.0, None, None), ("Vendas", "**9**", 0.0, None, None), (None, None, None, None, None),
    ]
    got = evidence.quarantine(spark.createDataFrame(x, "label string, evidence string, value double, unit string, want string")).collect()
    assert [r.rejection_reason for r in got] == [r.want for r in got]


def test_mixed_filings_are_isolated_once(spark):
    rows = [(1, 2025, 1, 10.0, True), (1, 2025, 2, 25.0, True), (1, 2025, 2, 15.0, False), (1, 2025, 3, 55.0, True), (1, 2025, 3, 30.0, False), (2, 2025, 3, 9.0, True)]
    got = accounts.isolate_quarters(spark.createDataFrame(rows, "company int, year int, q int, v double, is_ytd boolean"), ["company"], "v")
    assert sorted((r.company, r.q, r.v, r.source) for r in got.filter("company = 1").collect()) == [
        (1, 1, 10.0, "periodo_isolado"), (1, 2, 15.0, "periodo_isolado"), (1, 2, 15.0, "ytd_menos_ytd_anterior"), (1, 3, 30.0, "periodo_isolado"), (1, 3, 30.0, "ytd_menos_ytd_anterior"),
    ]
    assert one(got.filter("company = 2")).v is None


def test_totals_are_single_accounts(spark):
    d = day("2025-12-31")
    rows = [("1", 100.0), ("1.01", 60.0), ("1.01.01", 60.0), ("1.010", 5.0), ("2", 100.0), ("2.01", 30.0), ("2.01.04", 30.0), ("3.01", 200.0), ("3.05", 50.0)]
    bp = spark.createDataFrame([(1, d, c, v) for c, v in rows], "company int, ref_date date, code string, value double")
    r = one(accounts.balance_check(bp))
    assert (r.assets, r.liabilities, r.status) == (100.0, 100.0, "OK")
    assert one(accounts.balance_check(bp.filter("code <> '2'"))).status == "VERIFY"
    w = one(indicators.working_capital(bp, bp.filter("code = '3.01'").select("company", "ref_date", F.col("value").alias("revenue"))))
    assert (w.working_capital, w.pct_of_revenue) == (30.0, 15.0)
    v = {r.code: r.vertical for r in indicators.vertical(bp, ["company", "ref_date"], "value").collect()}
    assert (v["1"], v["1.01"], v["2.01.04"], v["3.05"]) == (100.0, 60.0, 30.0, 25.0)
    named = spark.createDataFrame([(1, "1.9", "Ativo Total", 50.0), (1, "1.01", "Caixa", 5.0)], "company int, code string, description string, value double")
    assert {r.code: r.vertical for r in indicators.vertical(named, ["company"], "value", description="description").collect()} == {"1.9": 100.0, "1.01": 10.0}


def test_horizontal_signs_and_gaps(spark):
    rows = [(1, "a", 1, -100.0), (1, "a", 2, -150.0), (1, "b", 1, 10.0), (1, "b", 3, 15.0), (1, "a", 3, 0.0), (1, "a", 4, 5.0)]
    df = spark.createDataFrame(rows, "company int, code string, p int, v double")
    assert {(r.code, r.p): r.horizontal for r in indicators.horizontal(df, ["company", "code"], "p", "v").collect()} == {("a", 1): None, ("a", 2): 50.0, ("a", 3): -100.0, ("a", 4): None, ("b", 1): None, ("b", 3): None}
    assert {(r.code, r.p): r.horizontal for r in indicators.horizontal(df, ["company", "code"], "p", "v", "last_seen").collect()}["b", 3] == 50.0


def test_share_tolerance_is_of_the_filed_count(spark):
    df = spark.createDataFrame([(1, 1051, 1000), (2, 951, 1000), (3, 195434352, 1954343520)], "company int, market long, official long")
    got = {r.company: (r.status, r.difference_pct, r.quantity_source) for r in market.validate_shares(market.infer_share_scale(df)).collect()}
    assert got == {1: ("shares_discrepancy", 5.1, None), 2: ("validated", 4.9, "market"), 3: ("shares_discrepancy", 90.0, None)}


def test_current_cap_of_several_classes(spark):
    d = day("2026-06-30")
    p = spark.createDataFrame([(c, d, 20.0) for c in (1, 2, 3, 4)], "company int, date date, close double")
    s = spark.createDataFrame([(1, d, 100), (2, d, 30), (3, d, 7), (4, d, 9)], "company int, date date, shares long")
    c = spark.createDataFrame([(1, 10, 1.0, 20.0), (1, 20, 1.0, 20.0), (2, 10, 1.0, 30.0), (2, 20, 1.0, None), (4, None, 1.0, 1.0)], "company int, quantity long, weight double, price double")
    got = {r.company: (r.market_cap, r.status, r.components) for r in market.current_market_cap(p, s, c).collect()}
    assert got == {1: (None, "shares_discrepancy", 2), 2: (700.0, "validated_class_sum", 2), 3: (140.0, "single_class", None), 4: (None, "missing_share_class_data", 1)}


def test_blocked_statuses(spark):
    rows = [(1.0, None, None), (1.0, " Blocked ", None), (1.0, "validated", "UNRESOLVED"), (-1.0, None, None), (None, None, None), (float("inf"), None, None)]
    df = spark.createDataFrame(rows, "market_cap double, status string, status_market_cap string")
    assert [r[0] for r in df.select(market.valid_cap(df)).collect()] == [True, False, False, False, False, False]


def test_vso_opening_and_status(spark):
    o = [
        ("A", "s", 2025, 2, "inventory", 100.0), ("A", "s", 2025, 3, "net_sales", 10.0), ("A", "s", 2025, 4, "net_sales", 10.0), ("A", "s", 2025, 4, "launches", 10.0), ("A", "s", 2025, 4, "inventory", 50.0),
        ("A", "unknown", 2025, 4, "inventory", 50.0), ("A", "unknown", 2026, 1, "net_sales", 1.0), ("A", "unknown", 2026, 1, "launches", 1.0), ("A", "s", 2026, 1, "net_sales", 30.0), ("A", "s", 2026, 1, "launches", 50.0), ("A", "s", 2026, 1, "inventory", 60.0),
    ]
    got = {(r.basis, r.year, r.q): r for r in evidence.vso(spark.createDataFrame(o, "ticker string, basis string, year int, q int, metric string, value double")).collect()}
    assert got["s", 2025, 4].calculation_status == "missing_components"  # the quarter before has observations but no inventory
    assert got["unknown", 2026, 1].calculation_status == "incompatible_basis"
    r = got["s", 2026, 1]
    assert (r.vso, r.reconciliation, r.confidence) == (0.3, "material_difference", "medium")


def test_numbers_basis_and_types(spark):
    nums = spark.createDataFrame([("1-2",), ("2024-05",), ("-5",), ("(-5)",), ("5-",), ("-(5)",), ("+7,5",)], "n string")
    for mode in ("statement", "operational"):
        assert [None if r[0] is None else float(r[0]) for r in nums.select(T.parse_number(F.col("n"), mode)).collect()] == [None, None, -5.0, 5.0, None, None, 7.5]
    b = {"participação de mercado": "unknown", "ex permuta": "company_share", "total projects": "one_hundred_percent", "% companhia 100%": "company_share", "Cem por cento": "one_hundred_percent", "%EZ": "company_share"}
    assert {r.t: r.b for r in spark.createDataFrame([(k,) for k in b], "t string").select("t", T.ownership_basis(F.col("t")).alias("b")).collect()} == b
    d = {"Transcrição do webcast 2T26": "TRANSCRICAO_WEBCAST", "webcast ao vivo": None, "Planilha de fundamentos 2T26 Excel": "PLANILHA_RESULTADOS", "Previa operacional": "PREVIA_OPERACIONAL", "Release de resultados 2T26": "RELEASE_RESULTADOS", "Vídeo": None, "x": None}
    assert {r.t: r.d for r in spark.createDataFrame([(k,) for k in d], "t string").select("t", T.classify_document(F.col("t")).alias("d")).collect()} == d


def test_sector_reasons_and_messages(spark):
    d = day("2026-03-31")
    ev = spark.createDataFrame([(1, d, "A", 1000.0, 100.0), (1, d, "B", None, 5.0), (1, d, "C", 3.0, None), (2, d, "D", None, None)], "sector int, ref_date date, company string, ev double, ebitda_ltm double")
    got = {r.sector: r for r in market.sector_ev_ebitda(ev).collect()}
    assert [tuple(x) for x in got[1].excluded_reasons] == [("B", "missing_enterprise_value"), ("C", "missing_ebitda_ltm")] and got[2].diagnostics == "no_valid_company"
    caps = spark.createDataFrame([(1, d, "A", 100.0, "validated")], "sector int, ref_date date, company string, market_cap double, status string")
    reg = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "sector int, company string")
    assert sorted((r.company, r.reason, r.coverage) for r in market.market_cap_share(caps, reg).collect()) == [("A", None, 0.5), ("B", "missing", 0.5)]


def test_contract_and_latest(spark):
    rows = [("T", "m", 1.0, "1T26", "u", "reported", "d", None, 1), ("T", "m", 1.0, "1T26", "u", "derived", "d", None, 2), ("X", "m", float("nan"), "5T26", "v", None, None, None, 3), ("T", "?", None, None, None, None, None, None, 4)]
    o = spark.createDataFrame(rows, "ticker string, metric string, value double, period string, unit string, nature string, source_document string, formula string, ordinal int")
    rules = spark.createDataFrame([("m", "u")], "metric string, unit string")
    got = {r.ordinal: r.errors for r in evidence.check_observations(o, rules, ["metric", "period"], "t").collect()}
    assert got == {1: [], 2: ["duplicate_key", "missing_formula"], 3: ["ticker_mismatch", "missing_value", "bad_period", "unit_mismatch", "missing_nature"], 4: ["unknown_metric"]}
    latest = spark.createDataFrame([("T", "m", 2025, 4, 1.0, "high", 1), ("T", "m", 2025, None, 2.0, "high", 2)], "ticker string, metric string, year int, q int, value double, confidence string, ordinal int")
    assert one(evidence.latest_metric(latest)).value == 2.0


def test_margins_of_ifrs17_companies(spark):
    df = spark.createDataFrame([(1, 1000.0, -400.0, 100.0, 25.0, 50.0), (2, 1000.0, -400.0, 100.0, 25.0, 50.0)], "company int, revenue double, cost double, ebit double, da double, net_income double")
    got = {r.company: r for r in indicators.margins(df, spark.createDataFrame([(2, True)], "company int, ifrs17 boolean")).collect()}
    assert (got[1].net_margin, got[1].margin_flag, got[2].gross_margin, got[2].ebitda, got[2].margin_flag) == (5.0, None, None, 125.0, "not_comparable")


def test_leaves_and_roots(spark):
    df = spark.createDataFrame([(1, "1.02", D(999)), (1, "1.02.01", D(310)), (1, "1.02.02", D(160)), (1, "3", D(5))], "company int, code string, value decimal(38,4)")
    assert sorted(r.code for r in accounts.leaves_only(df, ["company"]).collect()) == ["1.02.01", "1.02.02", "3"]
    assert one(accounts.root_or_leaf_sum(df.filter("code <> '1.02'"), ["1.02"], ["company"])).value == D(470)
    dup = df.union(df.filter("code = '1.02'"))
    assert one(accounts.root_or_leaf_sum(dup, ["1.02"], ["company"])).error == "duplicate_root"


def test_cagr(spark):
    df = spark.createDataFrame([(1, 2024, 100.0), (1, 2025, 121.0), (2, 2025, 3.0)], "company int, year int, v double")
    assert {r.company: r.cagr and round(r.cagr, 9) for r in indicators.cagr(df, "v", ["company"]).collect()} == {1: 21.0, 2: None}


def test_overrides_and_tracking(spark):
    obs = spark.createDataFrame([("T", "m", 2026, 1, 5.0, "low", 1), ("T", "n", 2026, 1, 91250.0, "medium", 2)], "ticker string, metric string, year int, q int, value double, confidence string, ordinal int")
    man = spark.createDataFrame([("T", "m", 2026, 1, 82575.0), ("T", "n", 2026, 1, 1.0)], "ticker string, metric string, year int, q int, value double")
    assert {r.metric: (r.status, r.used_value) for r in governance.resolve_overrides(obs, man).collect()} == {"m": ("active", 82575.0), "n": ("superseded", 91250.0)}
    events = {
        1: ["discovered", "published"], 2: ["discovered", "accepted", "accepted", "downloaded", "converted", "read", "parsed", "published", "extraction_error"], 3: ["discovered", "discovered", "rejected"], 4: ["accepted"], 5: ["discovered", "lost"],
    }
    rows = [(d, s, i, None) for d, states in events.items() for i, s in enumerate(states)] + [(6, "discovered", 0, None), (6, "accepted", 1, {"run_id": "another"})]
    ev = spark.createDataFrame(rows, "document int, state string, at int, fields map<string, string>").withColumn("ordinal", F.col("at"))
    errors = {(r.document, r["at"]): r.error for r in governance.check_transitions(ev).collect() if r.error}
    assert errors == {(1, 1): "illegal_transition", (2, 8): "after_terminal_state", (4, 0): "illegal_transition", (5, 1): "unknown_state", (6, 1): "reserved_fields"}
    run = spark.createDataFrame([(1, "discovered", 1, None), (1, "accepted", 2, None), (1, "read", 3, None), (1, "validated", 4, 0)], "document int, state string, at int, observations_count long").withColumn("ordinal", F.col("at"))
    s = one(governance.run_summary(run))
    assert (s.found, s.accepted, s.processed, s.with_observations, s.events, s.coverage) == (1, 1, 1, 0, 4, "complete")


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", day("2025-01-05"), 1), ("a", None, 2), (None, day("2025-01-05"), 3)], "k string, at date, n int")
    right = spark.createDataFrame([("a", day("2025-01-05"), 7.0), ("a", day("2025-01-06"), 8.0), ("a", None, 9.0)], "k string, d date, v double")
    assert {r.n: r.v for r in asof(left, right, ["k"], "at", "d", ["v"]).collect()} == {1: 7.0, 2: None, 3: None}
    assert asof(left.limit(0), right, ["k"], "at", "d", ["v"]).count() == 0
    assert {r.n: r.v for r in asof(left, right.limit(0), ["k"], "at", "d", ["v"]).collect()} == {1: None, 2: None, 3: None}
