"""Operators under rules of companies, metrics and documents: golden values and edge cases."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import evidence, filings, governance, indicators
from fundamentals_spark.sources import files

day = dt.date.fromisoformat


def test_period_text(spark):
    rows = [("2024-01-01 2024-04-01 2024-06-30",), ("2024-01-01/2024-06-30",), ("em 2024-06-30",), ("01/01/2024 a 30/06/2024",), ("31/12/2023",), ("31/02/2024",), ("1T24",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(T.parse_period_text(F.col("t")).alias("p")).collect()
    want = [("2024-01-01", "2024-04-01", "2024-06-30"), ("2024-06-30", "2024-01-01", "2024-06-30"), ("2024-06-30",) * 3, ("2024-06-30", "2024-01-01", "2024-06-30"), ("2023-12-31",) * 3, None, None, None, None]
    assert [None if r.p is None else tuple(str(x) for x in r.p) for r in got] == want


def test_company_debt_rules(spark):
    d = day("2024-12-31")
    rows = [
        (1, "1.01.01", "Caixa", 10), (1, "1.01.02", "Aplicações", 5), (1, "2.01.04", "Empréstimos", 100), (1, "2.01.04.01", "Parte", 60), (1, "2.02.01.01", "Folha", 40), (1, "2.02.01.02", "Passivo de arrendamento", 7),
        (2, "1.01.01", "Caixa", 1), (2, "1.01.02", "Aplicações", 5), (2, "2.01.04", "Empréstimos", 100), (2, "2.02.09", "Leasing", 9), (2, "2.03", "Outro", 3),
        (3, "1.01.01", "Caixa", 1), (4, "2.01.04", "Empréstimos", 1), (5, "2.01.04", "Empréstimos", 1), (5, "2.01.04", "Empréstimos", 1), (5, "1.01.01", "Caixa", 1),
    ]
    bp = spark.createDataFrame([(c, d, code, t, Decimal(v)) for c, code, t, v in rows], "company int, ref_date date, code string, description string, value decimal(38,4)")
    codes = spark.createDataFrame([(2, "cash", "1.01.01"), (2, "cash", "1.01.02"), (2, "short", "2.01.04"), (2, "short", "2.03")], "company int, part string, code string")
    options = spark.createDataFrame([(2, False, True), (1, None, None)], "company int, deduct_investments boolean, include_leases boolean")
    net, audit = indicators.net_debt_by_company(bp, codes, options)
    got = {r.company: (r.gross_debt, r.net_debt, r.error) for r in net.collect()}
    assert got[1] == (Decimal("147"), Decimal("132"), None)  # the lease is a counted leaf of the long debt
    assert got[2] == (Decimal("112"), Decimal("106"), None)
    assert (got[3][2], got[4][2], got[5][2]) == ("no_debt_account", "no_cash_account", "duplicate_root")
    assert got[3][1] is None and got[5][1] is None
    assert {(r.part, r.code) for r in audit.filter("company = 2").collect()} == {("cash", "1.01.01"), ("cash", "1.01.02"), ("investments", "1.01.02"), ("short", "2.01.04"), ("short", "2.03"), ("leases", "2.02.09")}
    plain, _ = indicators.net_debt_by_company(bp)
    assert {r.company: r.net_debt for r in plain.collect()}[1] == Decimal("132")
    assert indicators.net_debt_by_company(bp.limit(0), codes, options)[0].count() == 0


def test_growth_variants(spark):
    rows = [(1, 2020 + i, 4, True, 100.0 * 2**i, 10.0) for i in range(6)] + [(2, 2024, 4, True, 100.0, None)] + [(2, 2024, q, False, 10.0 * q, 1.0) for q in (1, 2, 3)] + [(3, 2024, 1, False, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "company int, year int, q int, is_ytd boolean, revenue double, profit double")
    got = {r.company: r for r in indicators.cagr_periods(df, ["revenue", "profit"], ["company"]).collect()}
    assert got[1].points == 5 and round(got[1].cagr_revenue, 6) == 100.0 and round(got[1].cagr_profit, 6) == 0.0
    assert got[2].points == 4 and not got[2].annual and round(got[2].cagr_revenue, 4) == round((10 ** (1 / 3) - 1) * 100, 4) and got[2].cagr_profit is None
    assert got[3].cagr_revenue is None
    years = spark.createDataFrame([(1, 2020, 100.0), (1, 2024, 1600.0), (2, 2024, 1.0), (3, 2020, -1.0), (3, 2021, 4.0)], "company int, year int, v double")
    assert {r.company: None if r.cagr_v is None else round(r.cagr_v, 6) for r in indicators.cagr_years(years, ["v"], ["company"]).collect()} == {1: 100.0, 2: None, 3: None}


def test_reconciliation_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "company int, ebitda_contabil double, ebitda_ajustado_divulgado double")
    rows = indicators.reconciliation_rows(df, ["company"]).collect()
    assert len(rows) == 33
    assert {r.company: (r.difference, r.classification) for r in rows if r.metric == "ebitda_contabil_vs_ajustado"} == {1: (5.0, "NOT_COMPARABLE"), 2: (1.0, "METHODOLOGY_DIFFERENCE"), 3: (None, "MISSING_DATA")}
    assert {r.classification for r in rows if r.metric == "lucro_liquido"} == {"MISSING_DATA"}


def test_judged_observations(spark):
    rules = spark.createDataFrame([("N. Pacientes", ["Paciente-dia"], ["Beneficiários", "paciente-dia"], 82), ("Receita Bruta", None, None, None)], "metric string, allowed_proxies array<string>, forbidden_contexts array<string>, proxy_score int")
    rows = [
        ("N. Pacientes", "Paciente-dia", "total", 150.0, None, "spreadsheet_row", False), ("N. Pacientes", "Pacientes", "beneficiarios", 150.0, None, "release_table", False), ("N. Pacientes", "Pacientes", None, 150.0, None, "release_table", False),
        ("N. Pacientes", "Pacientes-dia", None, 2025.0, None, "pdf", True), ("Receita Bruta", "Receita", "", 9.0, None, "pdf", False), ("Receita Bruta", "Receita", "", 9.0, "%", "pdf", False), ("Outra", None, None, None, None, None, None),
    ]
    obs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, metric string, label string, context string, value double, unit string, source string, calculated boolean")
    got = [(r.nature, r.proxy_for, r.rejection_reason, r.score, r.confidence, r.plausible) for r in evidence.judge_observations(obs, rules).orderBy("i").collect()]
    assert got == [
        ("proxy", "Paciente-dia", None, 82, "medium", True), ("reported", None, "Beneficiários", 35, "low", True), ("reported", None, None, 86, "high", True),
        ("calculated", "formula", "pacientes-dia_is_not_unique_patients", 35, "low", False), ("reported", None, "gross_revenue_value_incompatible_with_unit", 35, "low", True), ("reported", None, None, 76, "medium", True), ("reported", None, None, 76, "medium", False),
    ]


def test_evidence_status(spark):
    ok = ("T", "m", "1T24", 1.0, "R$", "d", "high")
    rows = [(*ok, None), (*ok[:3], 0.0, *ok[4:], None), (*ok, ["unexpected_sign"]), (*ok, ["breakdown_without_explicit_total", "unexpected_sign"]), (*ok[:6], None, None), (*ok[:5], "", "high", ["other"])]
    obs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ticker string, metric string, period string, value double, unit string, source_document string, confidence string, validation_flags array<string>")
    got = evidence.evidence_status(obs).orderBy("i").collect()
    assert [r.validation_status for r in got] == ["valid", "low_confidence", "quarantined", "quarantined_scope", "low_confidence", "low_confidence"]
    assert got[1].validation_missing_fields == ["value"] and got[5].validation_missing_fields == ["source_document"]


def test_retail_ratios(spark):
    rows = [
        ("A", "1T24", "digital_revenue_brl", 30.0, "x", "valid", "consolidated", None), ("A", "1T24", "comparable_total_revenue_brl", 120.0, "x", "valid", "consolidated", None), ("A", "1T24", "physical_revenue_brl", 90.0, None, "valid", "consolidated", None),
        ("A", "1T24", "sales_area_sqm", 9.0, None, "valid", "consolidated", ""), ("A", "2T24", "digital_revenue_brl", 30.0, "x", "valid", "consolidated", None), ("A", "2T24", "comparable_total_revenue_brl", 120.0, "y", "valid", "consolidated", None),
        ("A", "2T24", "sales_area_sqm", 0.0, None, "valid", "consolidated", "average"), ("B", "1T24", "digital_revenue_brl", 30.0, "x", "quarantined", "consolidated", None),
    ]
    obs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ticker string, period string, metric string, value double, scope string, status string, segment string, area_basis string, ordinal int")
    got = {(r.ticker, r.period, r.metric): (r.value, r.confidence, r.reason) for r in evidence.derive_retail(obs).collect()}
    assert got == {
        ("A", "1T24", "digital_revenue_share"): (0.25, "high", None), ("A", "1T24", "physical_revenue_per_sqm"): (10.0, "medium", None),
        ("A", "2T24", "digital_revenue_share"): (None, None, "missing_or_incompatible_comparable_revenue_base"), ("A", "2T24", "physical_revenue_per_sqm"): (None, None, "missing_or_incompatible_physical_revenue_or_area"),
    }


def test_scoped_ratios(spark):
    r = spark.createDataFrame([(1, 10.0, 40.0, 60.0, None), (2, 10.0, 40.0, 60.0, False), (3, 10.0, -40.0, 40.0, True), (4, None, 1.0, 1.0, True)], "i int, income double, equity_open double, equity_close double, scopes_match boolean")
    assert [(x.value, x.calculation_status) for x in evidence.roe_by_scope(r).orderBy("i").collect()] == [(0.2, "derived"), (None, "incompatible_basis"), (None, "invalid_denominator"), (None, "missing_components")]
    c = spark.createDataFrame([(1, -10.0, None, 90.0, None), (2, 10.0, 50.0, None, False), (3, 10.0, 0.0, 1.0, True), (4, 10.0, None, None, True), (5, None, 1.0, 1.0, True)], "i int, allowance double, gross double, net double, same_scope boolean")
    got = [(x.value, x.calculation_status, x.gross_rebuilt) for x in evidence.credit_loss_by_scope(c).orderBy("i").collect()]
    assert got == [(0.1, "derived", True), (None, "incompatible_basis", False), (None, "invalid_denominator", False), (None, "missing_components", False), (None, "missing_components", False)]


def test_benchmark_matrix(spark):
    """Against a plain comparison of all pairs, with values around every tolerance."""
    import random

    rng = random.Random(5)
    base = [0.0, 0.004, -0.9, 1.0, 1.02, 7.5, -320.0, 1e6, -4e9]
    expected = [(i, f"T{i % 3}", "Não divulgado" if i % 11 == 0 else None, ("Vendas", "LANÇ", "x")[i % 3], None if i % 13 == 0 else base[i % 9], (None, " 1q24", "2T24")[i % 3], (None, "", "r$")[rng.randrange(3)]) for i in range(90)]
    actual = [(f"T{rng.randrange(2)}", ("vendas_liquidas", "other")[rng.randrange(2)], ("Lançamentos", None)[rng.randrange(2)], None if k % 17 == 0 else base[k % 9] + rng.choice([0, 0.0099, -0.0101, 0.0099 * base[k % 9], 0.0101 * base[k % 9]]), ("1T24", "2T24", None)[rng.randrange(3)], ("R$ MM", None)[rng.randrange(2)]) for k in range(200)]

    def plain(row):
        _, ticker, state, name, value, period, unit = row
        mine = [a for a in actual if a[0] == ticker]
        if state:
            return "false_positive" if mine else "protected_state"
        hits = [a for a in mine if name.lower() in a[1].lower() or name.lower() in (a[2] or "").lower()]
        if not hits:
            return "not_found"
        if value is None:
            return "found_without_expected_value"
        p, u = (period or "").strip().upper().replace("Q", "T"), (unit or "").lower()
        near = [a for a in hits if a[3] is not None and abs(a[3] - value) <= max(0.01, abs(value) * 0.01)]
        return "match" if any((not p or (a[4] or "") == p) and (not u or u in (a[5] or "").lower()) for a in near) else "mismatch"

    e = spark.createDataFrame(expected, "id int, ticker string, state string, indicator string, value double, period string, unit string")
    a = spark.createDataFrame(actual, "ticker string, metric string, name string, value double, period string, unit string")
    got = {r.id: r.outcome for r in evidence.benchmark_matrix(e, a).collect()}
    want = {r[0]: plain(r) for r in expected}
    assert got == want and len(set(want.values())) == 6


def test_registered_scope(spark):
    d = day("2024-03-31")
    df = spark.createDataFrame([(1, d, "a", "DF Consolidado", 1.0), (1, d, "b", "DF Individual", 2.0), (2, d, "a", "DF Consolidado", 1.0), (2, d, "b", "DF Individual", 2.0), (3, d, "a", "DF Individual", 1.0), (4, d, "a", None, 1.0)], "company int, ref_date date, code string, scope string, value double")
    reg = spark.createDataFrame([(1, "individual"), (2, None), (3, "consolidado")], "company int, statement_scope string")
    got = sorted((r.company, r.code, r.value, r.scope_error) for r in filings.select_registered_scope(df, reg).collect())
    assert [g for g in got if g[0] < 4] == [(1, "b", 2.0, None), (2, "a", 1.0, None), (3, "a", None, "scope_not_found")]
    assert [g[0] for g in got if g[0] == 4] == [4]


def test_sector_quality(spark):
    c = spark.createDataFrame([("s", "A", None), ("s", "B", None), ("s", "C", "not_found"), ("s", "D", None), ("z", "E", None)], "sector string, ticker string, snapshot_status string")
    rows = [("A", "valid", "high", 0.0, "n", "R$"), ("A", None, "medium", 1.0, "n", ""), ("A", "valid", "low", 1.0, "n", ""), ("B", "quarantined_scope", "high", 1.0, None, None), ("C", "valid", "high", 1.0, None, None), ("X", "valid", "high", 1.0, None, None)]
    obs = spark.createDataFrame(rows, "ticker string, validation_status string, confidence string, value double, unit string, raw_unit string")
    got = {r.sector: r for r in governance.sector_quality_report(obs, c).collect()}
    s = got["s"]
    assert (s.companies_requested, s.companies_with_valid_observations, s.companies_not_found, s.companies_quarantined_only, s.valid_observations, s.quarantined_observations, s.zero_observations) == (4, 1, 1, 1, 3, 1, 1)
    assert s.scales_detected == {"R$": 1, "n": 1, "unknown": 1} and s.warning == "partial_coverage" and s.status == "success"
    assert got["z"].status == "failed_quality_gate" and got["z"].valid_observations == 0


def test_comparison_payload(spark):
    flag = "quality_flags array<struct<metric string, status string, message string>>".replace("metric string", "metric: string").replace("status string", "status: string").replace("message string", "message: string")
    rows = [("A", 2020, 4, True, 100.0, 10.0, 50.0, 1.0, 2.0, 3.0, None, None), ("A", 2022, 4, True, 400.0, -1.0, 51.0, 1.0, 2.0, 3.0, None, [("margem_bruta", "not_comparable", "")]), ("A", 2023, 1, False, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 7.0, None)]
    rec = spark.createDataFrame(rows, f"company string, year int, q int, is_ytd boolean, receita_liquida double, lucro_liquido double, margem_bruta double, margem_operacional double, margem_ebitda double, margem_liquida double, ev_ebitda_ltm double, {flag}")
    cyc = spark.createDataFrame([("A", day("2022-01-01"), day("2022-12-31"), 40.0), ("A", day("2023-01-01"), day("2023-03-31"), 99.0)], "company string, start date, end date, cycle double")
    var = spark.createDataFrame([("A", 30, 1.5)], "company string, horizon int, change_pct double")
    units = spark.createDataFrame([("A", 2023, 4, "4T23", 3.0, "high"), ("A", 2023, None, "2023", 4.0, "medium"), ("A", 2024, 1, "1T24", 5.0, "low")], "company string, year int, q int, period string, value double, confidence string")
    reg = spark.createDataFrame([("A",), ("B",)], "company string")
    got = {(r.company, r.metric): (r.value, r.period, r.quality, r.confidence) for r in governance.comparison_payload(reg, rec, cyc, var, units).collect()}
    assert len(got) == 24
    assert round(got["A", "cagr_receita"][0], 6) == 100.0 and got["A", "cagr_receita"][1] == "2020–2022" and got["A", "cagr_lucros"][0] is None
    assert got["A", "margem_bruta"] == (None, "FY2022", "not_comparable", None) and got["A", "margem_liquida"] == (3.0, "FY2022", None, None)
    assert got["A", "ev_ebitda"][:2] == (7.0, "LTM 1T23") and got["A", "ciclo_financeiro"][:2] == (40.0, "FY2022")
    assert got["A", "n_unidades"] == (4.0, "2023", None, "medium") and got["B", "n_unidades"] == (None, None, None, "not_found")
    assert got["A", "delta_preco_30d"][:2] == (1.5, "Atual") and got["A", "delta_preco_90d"][0] is None


def test_parsed_overrides(spark):
    reg = spark.createDataFrame([("ABCD3", "ABCD3", "saude"), ("ABCD3", "OLD3", "saude")], "ticker string, alias string, sector string")
    met = spark.createDataFrame([("saude", "Ticket Médio", "ticket medio"), ("saude", "Ticket Médio", "Ticket Médio")], "sector string, metric string, alias string")
    rows = [(" old3", None, "TICKET MÉDIO", "1q2026", "1.234,5"), ("abcd3", "SAUDE", "ticket medio", "fy26", "-2.5"), ("abcd3", "varejo", "ticket medio", "2026", "1"), ("x", None, "ticket medio", "2026", "1"), ("abcd3", None, "?", "2026", "1"), ("abcd3", "", "ticket medio", "26", "1"), ("abcd3", None, "ticket medio", "2026", "1,2,3"), (None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ticker string, sector string, metric string, period string, value string")
    got = governance.parse_overrides(df, reg, met).orderBy("i").collect()
    assert [r.error for r in got] == [None, None, "sector_mismatch", "unknown_ticker", "unknown_metric", "bad_period", "bad_value", "unknown_ticker"]
    assert (got[0].ticker, got[0].metric, got[0].period, got[0].value) == ("ABCD3", "Ticket Médio", "1T26", 1234.5) and (got[1].period, got[1].value) == ("FY2026", -2.5)


def test_share_counts_with_decimals_and_windows_text(spark, tmp_path):
    p = tmp_path / "capital_2026.csv"
    head = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;QT_ACAO_TOTAL_CAP_INTEGR;QT_ACAO_ORDIN_CAP_INTEGR;QT_ACAO_PREF_CAP_INTEGR\n"
    p.write_bytes((head + "73.178.600/0001-18;2026-03-31;1;SAÚDE AÇÃO;123.0;1000;7,0\n").encode("cp1252"))
    reg = spark.createDataFrame([("73178600000118",)], "cnpj string")
    assert [tuple(r)[2:] for r in files.read_share_capital(spark, str(p), reg).collect()] == [(1, 123, 1000, 7)]


def test_snapshot_outcome(spark):
    c = spark.createDataFrame([(t,) for t in "ABCDE"], "ticker string")
    new, old = spark.createDataFrame([("A", 1)], "ticker string, v int"), spark.createDataFrame([("A", 0), ("B", 0), ("Z", 0)], "ticker string, v int")
    docs = spark.createDataFrame([("C", "error"), ("C", None), ("D", None)], "ticker string, status string")
    rows, status = evidence.snapshot_outcome(c, new, old, docs)
    assert sorted(map(tuple, rows.collect())) == [("A", 1), ("B", 0)]
    assert {r.ticker: r.status for r in status.collect()} == {"A": "found_new_data", "B": "preserved_existing_data", "C": "extraction_failed", "D": "unsupported_document", "E": "source_unavailable"}
