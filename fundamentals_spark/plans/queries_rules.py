"""Registered queries of the operators that follow rules of companies, metrics or documents, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import cycle, evidence, filings, governance, indicators
from fundamentals_spark.plans import standins as S

QUERIES, SQL = {}, {}
_O = f"WITH {S.OBSERVATIONS}"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


_DAYS = "d AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) + 9000 AS a, CAST(o_orderdate AS DATE) + 9090 AS b, CAST(o_orderdate AS DATE) + 9365 AS c FROM orders)"


@query("b06_period_text", f"""WITH {_DAYS} SELECT o_orderkey, CASE WHEN k = 0 THEN a WHEN k IN (1, 4) THEN b WHEN k IN (2, 5) THEN a END AS reference, CASE WHEN k = 0 THEN b WHEN k IN (1, 4, 2, 5) THEN a END AS start, CASE WHEN k = 0 THEN c WHEN k IN (1, 4) THEN b WHEN k IN (2, 5) THEN a END AS "end" FROM d""")
def b06_text(spark, sf):
    day = lambda n: F.date_add(F.to_date("o_orderdate"), n)
    iso, local, k = (lambda n: day(n).cast("string")), (lambda n: F.date_format(day(n), "dd/MM/yyyy")), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.concat_ws(" ", F.lit("DT_REFER"), iso(9000), F.lit("de"), iso(9090), F.lit("a"), iso(9365))).when(k == 1, F.concat(iso(9000), F.lit("_"), iso(9090)))
        .when(k == 2, F.concat(F.lit("em "), iso(9000), F.lit(" ("), local(9090), F.lit(")"))).when(k == 4, F.concat_ws(" a ", local(9000), local(9365), local(9090))).when(k == 5, local(9000)).when(k == 6, "31/02/2024").when(k == 7, "1T24")
    )
    return read(spark, sf, "orders").select("o_orderkey", T.parse_period_text(text).alias("p")).select("o_orderkey", "p.reference", "p.start", "p.end")


_SCOPE = "CASE WHEN company % 4 = 0 OR ordinal % 3 = 0 THEN 'DF Individual' ELSE 'DF Consolidado' END"


@query("c02_registered_scope", f"""WITH {S.FILINGS}, t AS (SELECT *, {_SCOPE} AS scope, CASE company % 5 WHEN 0 THEN 'consolidado' WHEN 1 THEN 'individual' WHEN 2 THEN 'auto' END AS want FROM filings), u AS (SELECT *, scope LIKE '%Consolid%' AS con, max(scope LIKE '%Consolid%') OVER (PARTITION BY company, ref_date) AS any_con FROM t),
v AS (SELECT *, CASE WHEN want = 'consolidado' THEN con WHEN want = 'individual' THEN NOT con ELSE con OR NOT any_con END AS fits FROM u), w AS (SELECT *, max(fits) OVER (PARTITION BY company, ref_date) AS found, row_number() OVER (PARTITION BY company, ref_date ORDER BY code, ordinal) AS i FROM v)
SELECT company, ref_date, ordinal, CASE WHEN found THEN CAST(value AS DOUBLE) END AS value, CASE WHEN NOT found THEN 'scope_not_found' END AS scope_error FROM w WHERE fits OR (NOT found AND i = 1)""")
def c02_registered(spark, sf):
    f = S.filings(spark, sf).withColumn("scope", F.when((F.col("company") % 4 == 0) | (F.col("ordinal") % 3 == 0), "DF Individual").otherwise("DF Consolidado"))
    k = F.col("company") % 5
    wanted = S.registry(spark, sf).select("company", F.when(k == 0, "consolidado").when(k == 1, "Individual ").when(k == 2, "auto").alias("statement_scope"))
    return filings.select_registered_scope(f, wanted).select("company", "ref_date", "ordinal", F.col("value").cast("double").alias("value"), "scope_error")


# companies 0, 3, 6 … count the cash group (leaves where it has no row of its own), 1, 4, 7 … two codes as cash, 5, 10 … a long debt
_PARTS = """x AS (SELECT company, ref_date, code, description, value, company % 3 AS k, company % 5 AS m FROM balances WHERE NOT (company % 4 = 3 AND code = '1.01')),
cash AS (SELECT company, ref_date, code, description, value FROM x b WHERE (k = 2 AND code = '1.01.01') OR (k = 1 AND code IN ('1.01.01', '1.01.02')) OR (k = 0 AND (code = '1.01' OR (code LIKE '1.01.%' AND NOT EXISTS (SELECT 1 FROM x r WHERE r.company = b.company AND r.ref_date = b.ref_date AND r.code = '1.01'))))),
inv AS (SELECT company, ref_date, code, description, value FROM x WHERE code = '1.01.02'), short AS (SELECT company, ref_date, code, description, value FROM x b WHERE code = '2.01.04' OR (code LIKE '2.01.04.%' AND NOT EXISTS (SELECT 1 FROM x r WHERE r.company = b.company AND r.ref_date = b.ref_date AND r.code = '2.01.04'))),
long AS (SELECT company, ref_date, code, description, value FROM x WHERE m = 0 AND code = '2.02.09'), lease AS (SELECT company, ref_date, code, description, value FROM x WHERE company % 2 = 0 AND m <> 0 AND code = '2.02.09'),
audit AS (SELECT 'cash' AS part, * FROM cash UNION ALL SELECT 'investments', * FROM inv UNION ALL SELECT 'short', * FROM short UNION ALL SELECT 'long', * FROM long UNION ALL SELECT 'leases', * FROM lease)"""


def _company_debt(spark, sf):
    b = S.balances(spark, sf).filter("not (company % 4 = 3 and code = '1.01')")
    reg = S.registry(spark, sf).select("company")
    k = F.col("company") % 3
    cash = reg.select("company", F.lit("cash").alias("part"), F.explode(F.when(k == 0, F.array(F.lit("1.01"))).when(k == 1, F.array(F.lit("1.01.01"), F.lit(" 1.01.02")))).alias("code"))
    long = reg.filter("company % 5 = 0").select("company", F.lit("long").alias("part"), F.lit("2.02.09").alias("code"))
    options = reg.select("company", F.when(k == 0, False).alias("deduct_investments"), (F.col("company") % 2 == 0).alias("include_leases"))
    return indicators.net_debt_by_company(b, cash.unionByName(long), options)


@query("e01_company_rules", f"""WITH {S.BALANCES}, {_PARTS}, s AS (SELECT company, ref_date, sum(value) FILTER (part = 'cash') c, sum(value) FILTER (part = 'investments') i, sum(value) FILTER (part = 'short') s, sum(value) FILTER (part = 'long') l, sum(value) FILTER (part = 'leases') z FROM audit GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT company, ref_date FROM x) LEFT JOIN s USING (company, ref_date)), e AS (SELECT *, CASE WHEN s IS NULL AND l IS NULL THEN 'no_debt_account' WHEN c IS NULL THEN 'no_cash_account' END AS error, coalesce(s, 0) + coalesce(l, 0) + coalesce(z, 0) AS gross FROM g)
SELECT company, ref_date, CAST(gross AS DOUBLE) AS gross_debt, CASE WHEN error IS NULL THEN CAST(gross - c - CASE WHEN company % 3 = 0 THEN 0 ELSE coalesce(i, 0) END AS DOUBLE) END AS net_debt, error FROM e""")
def e01_rules(spark, sf):
    d, _ = _company_debt(spark, sf)
    return d.select("company", "ref_date", F.col("gross_debt").cast("double").alias("gross_debt"), F.col("net_debt").cast("double").alias("net_debt"), "error")


@query("e01_audit_rows", f"WITH {S.BALANCES}, {_PARTS} SELECT company, ref_date, part, code, description, CAST(value AS DOUBLE) AS value FROM audit")
def e01_audit(spark, sf):
    return _company_debt(spark, sf)[1].withColumn("value", F.col("value").cast("double"))


@query("e11_cagr_periods", f"""WITH {S.YTD}, t AS (SELECT company, year, q, is_ytd, revenue, CASE WHEN (company + year) % 6 <> 0 THEN revenue - 1000 * company END AS profit FROM ytd_facts WHERE NOT (company % 4 = 2 AND q = 4)), f AS (SELECT *, is_ytd AND q = 4 AS an, count(*) FILTER (is_ytd AND q = 4) OVER (PARTITION BY company) >= 2 AS many FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC, q DESC) k FROM f WHERE an OR NOT many), g AS (SELECT company, count(*) AS points, bool_or(many) AS annual, count(profit) np, CAST(arg_min_null(revenue, year * 4 + q) AS DOUBLE) a, CAST(arg_max_null(revenue, year * 4 + q) AS DOUBLE) b, CAST(arg_min_null(profit, year * 4 + q) AS DOUBLE) pa, CAST(arg_max_null(profit, year * 4 + q) AS DOUBLE) pb FROM r WHERE k <= 5 GROUP BY 1)
SELECT company, points, annual, CASE WHEN points >= 2 AND a > 0 AND b > 0 THEN round((pow(b / a, 1.0 / (points - 1)) - 1) * 100, 6) END AS cagr_revenue, CASE WHEN points >= 2 AND np = points AND pa > 0 AND pb > 0 THEN round((pow(pb / pa, 1.0 / (points - 1)) - 1) * 100, 6) END AS cagr_profit FROM g""")
def e11_periods(spark, sf):
    f = S.ytd_facts(spark, sf).filter("not (company % 4 = 2 and q = 4)").withColumn("profit", F.when((F.col("company") + F.col("year")) % 6 != 0, F.col("revenue") - 1000 * F.col("company")))
    c = indicators.cagr_periods(f, ["revenue", "profit"], ["company"])
    return c.select("company", "points", "annual", F.round("cagr_revenue", 6).alias("cagr_revenue"), F.round("cagr_profit", 6).alias("cagr_profit"))


@query("e17_metric_rows", f"""WITH {S.QUARTERS}, t AS (SELECT company, year, q, CAST(revenue AS DOUBLE) AS r, CAST(CASE WHEN q = 2 THEN 0 ELSE ebit END AS DOUBLE) AS e, CASE WHEN q <> 3 THEN CAST(ebit + da AS DOUBLE) END AS d FROM quarter_facts),
m AS (SELECT *, unnest(['receita_contabil_cvm', 'receita_operacional_divulgada', 'ebitda_contabil', 'ebitda_ajustado_divulgado', 'lucro_liquido', 'divida_liquida_padronizada', 'divida_liquida_divulgada', 'market_cap_historico', 'enterprise_value', 'ev_ebitda_ltm']) AS metric FROM t), v AS (SELECT *, CASE metric WHEN 'receita_contabil_cvm' THEN r WHEN 'ebitda_contabil' THEN e WHEN 'ebitda_ajustado_divulgado' THEN d END AS x FROM m)
SELECT company, year, q, metric, round(x, 4) AS value, NULL::DOUBLE AS difference, CASE WHEN x IS NULL THEN 'MISSING_DATA' ELSE 'validated' END AS classification FROM v
UNION ALL SELECT company, year, q, 'ebitda_contabil_vs_ajustado', round(d, 4), round(d - e, 4), CASE WHEN d IS NULL OR e IS NULL THEN 'MISSING_DATA' WHEN e = 0 THEN 'NOT_COMPARABLE' ELSE 'METHODOLOGY_DIFFERENCE' END FROM t""")
def e17_rows(spark, sf):
    zero = F.lit(0).cast("decimal(38,4)")
    f = S.quarter_facts(spark, sf).select("company", "year", "q", F.col("revenue").alias("receita_contabil_cvm"), F.when(F.col("q") == 2, zero).otherwise(F.col("ebit")).alias("ebitda_contabil"), F.when(F.col("q") != 3, F.col("ebit") + F.col("da")).alias("ebitda_ajustado_divulgado"))
    return indicators.reconciliation_rows(f, ["company", "year", "q"]).withColumns({"value": F.round("value", 4), "difference": F.round("difference", 4)})


_METRICS = ("Receita Bruta", "N. Pacientes", "Ticket Médio", "N. Leitos")
_TEXTS = ("Receita Líquida consolidada", "Pacientes-dia", "Pacientes-dia (mil) YoY", "Leitos operacionais", "Variação a/a", "Leitos planejados")
_RULES = [("Receita Bruta", None, None, None), ("N. Pacientes", ["Atendimentos", "pacientes-dia (mil)"], ["Beneficiários"], 82), ("Ticket Médio", [], ["planejados"], None), ("N. Leitos", ["Leitos operacionais"], ["leitos Operacionais", "PLANEJADOS", "variação"], None)]


@query("g06_judge", f"""{_O}, t AS (SELECT ordinal, CAST(value AS DOUBLE) AS v, CAST(ordinal % 4 AS INTEGER) AS m, CAST(floor(ordinal / 4) AS BIGINT) % 6 AS x, source, ordinal % 9 = 0 AS calc, ordinal % 10 = 7 AS no_money FROM observations),
p AS (SELECT *, CASE WHEN calc THEN 'formula' WHEN m = 1 AND x = 2 THEN 'pacientes-dia (mil)' WHEN m = 3 AND x = 3 THEN 'Leitos operacionais' END AS proxy_for,
CASE WHEN m = 2 AND x = 5 THEN 'planejados' WHEN m = 3 AND x = 5 THEN 'PLANEJADOS' WHEN m = 3 AND x = 4 THEN 'variação' WHEN m = 2 AND x IN (2, 4) THEN 'variation_context' WHEN m = 1 AND x = 1 THEN 'pacientes-dia_is_not_unique_patients' WHEN m = 0 AND x = 0 THEN 'net_revenue_is_not_gross_revenue' WHEN m = 0 AND v < 10 AND NOT no_money THEN 'gross_revenue_value_incompatible_with_unit' END AS rejection_reason FROM t),
s AS (SELECT *, CASE WHEN calc THEN 'calculated' WHEN proxy_for IS NOT NULL THEN 'proxy' ELSE 'reported' END AS nature FROM p), z AS (SELECT *, CASE WHEN rejection_reason IS NOT NULL THEN 35 WHEN nature = 'proxy' THEN CASE WHEN m = 1 THEN 82 ELSE 74 END WHEN calc THEN 82 WHEN source = 'spreadsheet' THEN 90 ELSE 76 END AS score FROM s)
SELECT ordinal, nature, proxy_for, rejection_reason, score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence, x NOT IN (1, 2) OR (v > 100 AND floor(v) NOT IN (2025, 2026)) AS plausible FROM z""")
def g06_judge(spark, sf):
    k = F.col("ordinal")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    text = pick(_TEXTS, F.floor(k / 4) % 6)
    o = S.observations(spark, sf).withColumns({"metric": pick(_METRICS, k % 4), "label": F.when((F.floor(k / 4) % 6).isin(1, 2), text), "context": F.when(~(F.floor(k / 4) % 6).isin(1, 2), text), "calculated": k % 9 == 0, "unit": F.when(k % 10 == 7, "mil").when(k % 2 == 0, "R$ MM")})
    rules = spark.createDataFrame(_RULES, "metric string, allowed_proxies array<string>, forbidden_contexts array<string>, proxy_score int")
    return evidence.judge_observations(o, rules).select("ordinal", "nature", "proxy_for", "rejection_reason", "score", "confidence", "plausible")


_FLAGS = "CASE ordinal % 8 WHEN 1 THEN ['breakdown_without_explicit_total', 'unexpected_sign'] WHEN 2 THEN ['ownership_basis_expected:company_share'] WHEN 3 THEN ['missing_period'] WHEN 4 THEN ['profile_publication:quarterly'] END"


@query("g07_evidence_status", f"""{_O}, t AS (SELECT ordinal, {_FLAGS} AS f, confidence, ordinal % 5 = 1 AS a, value = 0 AS b, ordinal % 7 = 2 AS c FROM observations)
SELECT ordinal, CASE WHEN list_contains(f, 'breakdown_without_explicit_total') THEN 'quarantined_scope' WHEN ordinal % 8 IN (2, 4) THEN 'quarantined' WHEN NOT a AND NOT b AND NOT c AND confidence <> 'low' THEN 'valid' ELSE 'low_confidence' END AS validation_status, concat_ws(',', CASE WHEN b THEN 'value' END, CASE WHEN a THEN 'unit' END, CASE WHEN c THEN 'source_document' END) AS missing FROM t""")
def g07_evidence(spark, sf):
    k = F.col("ordinal")
    flags = F.when(k % 8 == 1, F.array(F.lit("breakdown_without_explicit_total"), F.lit("unexpected_sign"))).when(k % 8 == 2, F.array(F.lit("ownership_basis_expected:company_share"))).when(k % 8 == 3, F.array(F.lit("missing_period"))).when(k % 8 == 4, F.array(F.lit("profile_publication:quarterly")))
    o = S.observations(spark, sf).withColumns({"period": F.concat_ws("T", "q", "year"), "unit": F.when(k % 5 != 1, "R$"), "source_document": F.when(k % 7 == 2, "").otherwise("d"), "validation_flags": flags})
    return evidence.evidence_status(o).select("ordinal", "validation_status", F.array_join("validation_missing_fields", ",").alias("missing"))


@query("g10_retail", f"""{_O}, t AS (SELECT ticker, q || 'T' || year AS period, ordinal, CASE metric WHEN 'view' THEN 'digital_revenue_brl' WHEN 'click' THEN 'comparable_total_revenue_brl' WHEN 'purchase' THEN 'physical_revenue_brl' WHEN 'signup' THEN 'sales_area_sqm' END AS metric, CASE WHEN ordinal % 6 = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS v, CASE WHEN ordinal % 3 = 0 THEN NULL WHEN ordinal % 3 = 1 THEN 'a' ELSE 'b' END AS scope, CASE ordinal % 4 WHEN 0 THEN 'average' WHEN 1 THEN 'closing' WHEN 2 THEN '' END AS basis FROM observations WHERE confidence <> 'low' AND scope = 'consolidated'),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, period, metric ORDER BY ordinal DESC) k FROM t), l AS (SELECT * FROM r WHERE k = 1), pr AS (SELECT DISTINCT ticker, period FROM t), n(metric, top, base) AS (VALUES ('digital_revenue_share', 'digital_revenue_brl', 'comparable_total_revenue_brl'), ('physical_revenue_per_sqm', 'physical_revenue_brl', 'sales_area_sqm')),
j AS (SELECT pr.ticker, pr.period, n.metric, a.v AS av, b.v AS bv, coalesce(a.v IS NOT NULL AND b.v <> 0 AND a.scope IS NOT DISTINCT FROM b.scope, false) AS ok, n.metric = 'physical_revenue_per_sqm' AND coalesce(nullif(b.basis, ''), 'closing') = 'closing' AS closing FROM pr CROSS JOIN n LEFT JOIN l a ON a.ticker = pr.ticker AND a.period = pr.period AND a.metric = n.top LEFT JOIN l b ON b.ticker = pr.ticker AND b.period = pr.period AND b.metric = n.base)
SELECT ticker, period, metric, CASE WHEN ok THEN round(av / bv, 6) END AS value, CASE WHEN ok THEN CASE WHEN closing THEN 'medium' ELSE 'high' END END AS confidence, CASE WHEN ok AND closing THEN 'closing_area_used_instead_of_average_area' END AS validation_flag, CASE WHEN NOT ok THEN CASE metric WHEN 'digital_revenue_share' THEN 'missing_or_incompatible_comparable_revenue_base' ELSE 'missing_or_incompatible_physical_revenue_or_area' END END AS reason FROM j""")
def g10_retail(spark, sf):
    k = F.col("ordinal")
    names = F.create_map(*[F.lit(x) for x in ("view", "digital_revenue_brl", "click", "comparable_total_revenue_brl", "purchase", "physical_revenue_brl", "signup", "sales_area_sqm")])
    o = S.observations(spark, sf).withColumns({
        "period": F.concat_ws("T", "q", "year"), "metric": F.try_element_at(names, F.col("metric")), "value": F.when(k % 6 == 0, 0.0).otherwise(F.col("value").cast("double")), "segment": F.when(F.col("scope") == "consolidated", "consolidated").otherwise("breakdown"),
        "status": F.when(F.col("confidence") == "low", "low_confidence").otherwise("valid"), "area_basis": F.when(k % 4 == 0, "average").when(k % 4 == 1, "closing").when(k % 4 == 2, ""),
    }).withColumn("scope", F.when(k % 3 == 1, "a").when(k % 3 == 2, "b"))
    return evidence.derive_retail(o).select("ticker", "period", "metric", F.round("value", 6).alias("value"), "confidence", "validation_flag", "reason")


@query("g13_roe_scopes", f"""WITH {S.QUARTERS}, t AS (SELECT company, year, q, CASE WHEN q <> 3 THEN CAST(ebit AS DOUBLE) END AS i, CAST(revenue AS DOUBLE) AS a, CAST(CASE WHEN company % 4 = 1 THEN -2 * revenue ELSE cost END AS DOUBLE) AS b, CASE WHEN q <> 4 THEN company % 3 <> 0 END AS m FROM quarter_facts), s AS (SELECT *, CASE WHEN i IS NULL THEN 'missing_components' WHEN NOT coalesce(m, true) THEN 'incompatible_basis' WHEN (a + b) / 2 <= 0 THEN 'invalid_denominator' ELSE 'derived' END AS calculation_status FROM t)
SELECT company, year, q, CASE WHEN calculation_status = 'derived' THEN round(i / ((a + b) / 2), 6) END AS value, calculation_status FROM s""")
def g13_scopes(spark, sf):
    close = F.when(F.col("company") % 4 == 1, (F.col("revenue").cast("double") * -2)).otherwise(F.col("cost").cast("double"))
    f = S.quarter_facts(spark, sf).select("company", "year", "q", F.when(F.col("q") != 3, F.col("ebit").cast("double")).alias("income"), F.col("revenue").cast("double").alias("equity_open"), close.alias("equity_close"), F.when(F.col("q") != 4, F.col("company") % 3 != 0).alias("scopes_match"))
    return evidence.roe_by_scope(f).select("company", "year", "q", F.round("value", 6).alias("value"), "calculation_status")


@query("g14_credit_scopes", f"""WITH {S.QUARTERS}, t AS (SELECT company, year, q, CASE WHEN q <> 1 THEN abs(CAST(cost AS DOUBLE)) END AS l, CASE WHEN q % 2 = 0 THEN CAST(revenue - 100000 * (company % 3) AS DOUBLE) END AS g, CASE WHEN company % 7 <> 2 THEN CAST(ebit AS DOUBLE) END AS n, CASE WHEN year % 3 <> 0 THEN year % 3 = 1 END AS m FROM quarter_facts), u AS (SELECT *, coalesce(g, n + l) AS w, g IS NULL AND n IS NOT NULL AND l IS NOT NULL AS gross_rebuilt FROM t),
s AS (SELECT *, CASE WHEN l IS NULL OR w IS NULL THEN 'missing_components' WHEN NOT coalesce(m, true) THEN 'incompatible_basis' WHEN w <= 0 THEN 'invalid_denominator' ELSE 'derived' END AS calculation_status FROM u) SELECT company, year, q, gross_rebuilt, CASE WHEN calculation_status = 'derived' THEN round(l / w, 6) END AS value, calculation_status FROM s""")
def g14_scopes(spark, sf):
    f = S.quarter_facts(spark, sf).select(
        "company", "year", "q", F.when(F.col("q") != 1, F.col("cost")).alias("allowance"), F.when(F.col("q") % 2 == 0, F.col("revenue") - 100000 * (F.col("company") % 3)).alias("gross"), F.when(F.col("company") % 7 != 2, F.col("ebit")).alias("net"),
        F.when(F.col("year") % 3 != 0, F.col("year") % 3 == 1).alias("same_scope"),
    )
    return evidence.credit_loss_by_scope(f).select("company", "year", "q", "gross_rebuilt", F.round("value", 6).alias("value"), "calculation_status")


# expected: one row for each ticker, metric, year and quarter; extracted: the spreadsheets of even tickers and those of ticker T1
@query("g26_matrix", f"""{_O}, x AS (SELECT * FROM observations WHERE CAST(substr(ticker, 2) AS INTEGER) % 2 = 0 OR ticker = 'T1'), e AS (SELECT ticker, metric, year, q, min(ordinal) AS id, CAST(max_by(value, ordinal) AS DOUBLE) AS v FROM observations GROUP BY 1, 2, 3, 4), c AS (SELECT *, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN v + 7 ELSE v END AS w, id % 6 = 0 AS guarded, CASE WHEN metric = 'error' THEN 'err' ELSE metric END AS ind FROM e),
h AS (SELECT c.id, bool_or(coalesce(abs(CAST(x.value AS DOUBLE) - w) <= greatest(0.01, abs(w) * 0.01) AND (id % 3 = 0 OR (c.q = x.q AND c.year = x.year)) AND (id % 5 <> 0 OR x.ordinal % 2 = 0), false)) AS fits FROM c JOIN x ON c.ticker = x.ticker AND contains(x.metric, c.ind) GROUP BY 1), t AS (SELECT DISTINCT ticker FROM x)
SELECT c.id, c.ticker, CASE WHEN guarded AND t.ticker IS NULL THEN 'protected_state' WHEN guarded THEN 'false_positive' WHEN fits IS NULL THEN 'not_found' WHEN w IS NULL THEN 'found_without_expected_value' WHEN fits THEN 'match' ELSE 'mismatch' END AS outcome FROM c LEFT JOIN h USING (id) LEFT JOIN t ON c.ticker = t.ticker""")
def g26_matrix(spark, sf):
    o = S.observations(spark, sf)
    e = o.groupBy("ticker", "metric", "year", "q").agg(F.min("ordinal").alias("id"), F.max_by("value", "ordinal").cast("double").alias("v"))
    k = F.col("id")
    expected = e.select(
        "id", "ticker", F.when(k % 6 == 0, "Não divulgado").alias("state"), F.upper(F.when(F.col("metric") == "error", "err").otherwise(F.col("metric"))).alias("indicator"), F.when(k % 7 == 0, None).when(k % 7 == 1, F.col("v") + 7).otherwise(F.col("v")).alias("value"),
        F.when(k % 3 != 0, F.concat(F.lit(" "), F.col("q").cast("string"), F.lit("q"), F.col("year").cast("string"))).alias("period"), F.when(k % 5 == 0, "BRL").alias("unit"),
    )
    actual = o.filter("cast(substr(ticker, 2) as int) % 2 = 0 or ticker = 'T1'").select("ticker", "metric", F.col("metric").alias("name"), "value", F.concat_ws("T", "q", "year").alias("period"), F.when(F.col("ordinal") % 2 == 0, "brl million").otherwise("n").alias("unit"))
    return evidence.benchmark_matrix(expected, actual)


_JUDGED = "s AS (SELECT ticker, metric, q || 'T' || year AS period, confidence, value, CASE ordinal % 4 WHEN 0 THEN 'R$' WHEN 1 THEN '' END AS raw_unit, CASE WHEN ordinal % 8 = 2 THEN 'n' END AS unit, CASE WHEN ticker = 'T7' OR ordinal % 9 = 0 THEN 'quarantined_scope' WHEN ordinal % 5 <> 1 THEN 'valid' END AS st FROM observations WHERE ticker NOT IN ('T3', 'T10'))"


def _judged(spark, sf):
    k = F.col("ordinal")
    o = S.observations(spark, sf).filter("ticker not in ('T3', 'T10')")
    status = F.when((F.col("ticker") == "T7") | (k % 9 == 0), "quarantined_scope").when(k % 5 != 1, "valid")
    return o.select("ticker", "metric", F.concat_ws("T", "q", "year").alias("period"), "confidence", "value", F.when(k % 4 == 0, "R$").when(k % 4 == 1, "").alias("raw_unit"), F.when(k % 8 == 2, "n").alias("unit"), status.alias("validation_status"))


@query("i03_sector_report", f"""{_O}, {_JUDGED}, c AS (SELECT DISTINCT ticker, CAST(substr(ticker, 2) AS INTEGER) % 5 AS sector, ticker = 'T11' AS lost FROM observations), r AS (SELECT s.*, sector, coalesce(st, 'valid') = 'valid' AND confidence <> 'low' AS ok, coalesce(nullif(raw_unit, ''), nullif(unit, ''), 'unknown') AS u FROM s JOIN c USING (ticker)),
p AS (SELECT c.sector, c.ticker, lost, count(*) FILTER (ok) v, count(*) FILTER (st LIKE 'quarantined%') h, count(*) FILTER (ok AND value = 0) z FROM c LEFT JOIN r USING (ticker) GROUP BY 1, 2, 3), m AS (SELECT sector, string_agg(u || '=' || n, ',' ORDER BY u) AS scales FROM (SELECT sector, u, count(*) n FROM r WHERE ok GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT sector, count(*) AS companies_requested, count(*) FILTER (NOT lost AND v > 0) AS companies_with_valid_observations, count(*) FILTER (lost) AS companies_not_found, count(*) FILTER (NOT lost AND v = 0 AND h > 0) AS companies_quarantined_only, CAST(sum(v) AS BIGINT) AS valid_observations, CAST(sum(h) AS BIGINT) AS quarantined_observations, CAST(sum(z) AS BIGINT) AS zero_observations FROM p GROUP BY 1)
SELECT g.*, scales, CASE WHEN companies_with_valid_observations < companies_requested THEN 'partial_coverage' END AS warning, CASE WHEN companies_with_valid_observations = 0 THEN 'failed_quality_gate' ELSE 'success' END AS status FROM g LEFT JOIN m USING (sector)""")
def i03_report(spark, sf):
    c = S.observations(spark, sf).select("ticker").distinct().select("ticker", (F.substring("ticker", 2, 9).cast("int") % 5).alias("sector"), F.when(F.col("ticker") == "T11", "not_found").alias("snapshot_status"))
    r = governance.sector_quality_report(_judged(spark, sf), c)
    return r.withColumn("scales", F.array_join(F.transform(F.map_entries("scales_detected"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")).drop("scales_detected")


@query("i03_coverage_lists", f"{_O}, {_JUDGED} SELECT ticker, string_agg(DISTINCT period, ',' ORDER BY period) AS periods, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM s WHERE coalesce(st, 'valid') = 'valid' AND confidence <> 'low' GROUP BY 1")
def i03_lists(spark, sf):
    return governance.observation_coverage(_judged(spark, sf)).select("ticker", F.array_join("periods", ",").alias("periods"), F.array_join("metrics", ",").alias("metrics"))


_RECORDS = f"""WITH {S.YTD}, {S.PRICES}, {S.REGISTRY}, rec AS (SELECT company, year, q, is_ytd, CAST(revenue AS DOUBLE) AS r, CASE WHEN (company + year) % 6 <> 0 THEN CAST(revenue AS DOUBLE) / 7 - 1000 * company END AS p, 10.0 + company + q AS mb, 5.0 + company % 4 AS mo, CASE WHEN company % 5 <> 3 THEN 1.0 * (year % 10) END AS me, CAST(company AS DOUBLE) AS ml, CASE WHEN (company + q) % 3 <> 0 THEN 2.5 + company + q END AS ev,
CASE WHEN company % 3 = 1 THEN 'not_comparable' WHEN company % 3 = 2 THEN 'estimated' END AS fb, CASE WHEN company % 4 = 2 THEN 'incomplete' END AS fm FROM ytd_facts WHERE company <> 7), an AS (SELECT * FROM rec WHERE is_ytd AND q = 4),
cyc AS (SELECT company, make_date(year, CASE WHEN q = 4 THEN 1 ELSE q * 3 - 2 END, 1) AS s, last_day(make_date(year, q * 3, 1)) AS e, 30.5 + company + year % 7 AS cycle FROM ytd_facts WHERE company % 6 <> 5), fy AS (SELECT * FROM cyc WHERE month(s) = 1 AND month(e) = 12)"""


def _records(spark, sf):
    y = S.ytd_facts(spark, sf)
    k, q = F.col("company"), F.col("q")
    flag = lambda m, s: F.struct(F.lit(m).alias("metric"), s.cast("string").alias("status"), F.lit("").alias("message"))
    flags = F.filter(F.array(flag("margem_bruta", F.when(k % 3 == 1, "not_comparable").when(k % 3 == 2, "estimated")), flag("margem_ebitda", F.when(k % 4 == 2, "incomplete"))), lambda f: f["status"].isNotNull())
    money = F.col("revenue").cast("double")
    rec = y.filter("company <> 7").select(
        "company", "year", "q", "is_ytd", money.alias("receita_liquida"), F.when((k + F.col("year")) % 6 != 0, money / 7 - 1000 * k).alias("lucro_liquido"), (10.0 + k + q).alias("margem_bruta"), (5.0 + k % 4).alias("margem_operacional"),
        F.when(k % 5 != 3, 1.0 * (F.col("year") % 10)).alias("margem_ebitda"), k.cast("double").alias("margem_liquida"), F.when((k + q) % 3 != 0, 2.5 + k + q).alias("ev_ebitda_ltm"), flags.alias("quality_flags"),
    )
    cyc = y.filter("company % 6 <> 5").select("company", F.make_date("year", F.when(q == 4, 1).otherwise(q * 3 - 2), F.lit(1)).alias("start"), F.last_day(F.make_date("year", q * 3, F.lit(1))).alias("end"), (30.5 + k + F.col("year") % 7).alias("cycle"))
    return rec, cyc


@query("i08_payload", f"""{_RECORDS}, l AS (SELECT company, max(year) AS y, min(year) AS f FROM an GROUP BY 1), g AS (SELECT l.company, y, f, a.r ra, b.r rb, a.p pa, b.p pb, b.mb, b.mo, b.me, b.ml, b.fb, b.fm FROM l JOIN an a ON a.company = l.company AND a.year = f JOIN an b ON b.company = l.company AND b.year = y),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC, q DESC) k FROM rec WHERE ev IS NOT NULL) WHERE k = 1), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY e DESC) k FROM fy) WHERE k = 1), un AS (SELECT company, CASE WHEN max(year) % 2 = 0 THEN 'FY' || max(year) ELSE '4T' || max(year) END AS period, CAST(max(year) + company AS DOUBLE) AS v FROM ytd_facts WHERE company % 2 = 0 AND q = 4 GROUP BY 1),
mp AS (SELECT company, max(date) d1, max_by(adj_close, date) p1 FROM prices GROUP BY 1), hz AS (SELECT *, d1 - h AS t FROM mp, (SELECT unnest([30, 90, 360]) AS h)), dv AS (SELECT hz.company, h, (p1 / adj_close - 1) * 100 AS x FROM hz ASOF LEFT JOIN prices pp ON hz.company = pp.company AND hz.t >= pp.date),
m AS (SELECT company, 'cagr_receita' AS metric, CASE WHEN ra > 0 AND rb > 0 AND y > f THEN (pow(rb / ra, 1.0 / (y - f)) - 1) * 100 END AS value, CASE WHEN y > f THEN f || '–' || y END AS period, NULL AS quality, NULL AS confidence FROM registry LEFT JOIN g USING (company)
UNION ALL SELECT company, 'cagr_lucros', CASE WHEN pa > 0 AND pb > 0 AND y > f THEN (pow(pb / pa, 1.0 / (y - f)) - 1) * 100 END, CASE WHEN y > f THEN f || '–' || y END, NULL, NULL FROM registry LEFT JOIN g USING (company)
UNION ALL SELECT company, 'ciclo_financeiro', cycle, 'FY' || year(e), NULL, NULL FROM registry LEFT JOIN c USING (company)
UNION ALL SELECT company, 'margem_bruta', CASE WHEN coalesce(fb, '') <> 'not_comparable' THEN mb END, 'FY' || y, fb, NULL FROM registry LEFT JOIN g USING (company) UNION ALL SELECT company, 'margem_operacional', mo, 'FY' || y, NULL, NULL FROM registry LEFT JOIN g USING (company)
UNION ALL SELECT company, 'margem_ebitda', CASE WHEN fm IS NULL THEN me END, 'FY' || y, fm, NULL FROM registry LEFT JOIN g USING (company) UNION ALL SELECT company, 'margem_liquida', ml, 'FY' || y, NULL, NULL FROM registry LEFT JOIN g USING (company)
UNION ALL SELECT company, 'ev_ebitda', ev, 'LTM ' || q || 'T' || lpad(CAST(year % 100 AS VARCHAR), 2, '0'), NULL, NULL FROM registry LEFT JOIN ev USING (company) UNION ALL SELECT company, 'delta_preco_' || hh.h || 'd', x, 'Atual', NULL, NULL FROM registry CROSS JOIN (SELECT unnest([30, 90, 360]) AS h) hh LEFT JOIN dv ON dv.company = registry.company AND dv.h = hh.h
UNION ALL SELECT company, 'n_unidades', v, period, NULL, CASE WHEN v IS NULL THEN 'not_found' ELSE 'high' END FROM registry LEFT JOIN un USING (company))
SELECT company, metric, round(value, 6) AS value, period, quality, confidence FROM m""".replace("SELECT company, 'delta_preco_'", "SELECT registry.company, 'delta_preco_'"))
def i08_payload(spark, sf):
    from fundamentals_spark.operators import market

    rec, cyc = _records(spark, sf)
    y = S.ytd_facts(spark, sf).filter("q = 4 and company % 2 = 0")
    even = F.col("year") % 2 == 0  # annual rows of even years beside a quarter of low confidence or the same year
    unit = y.select("company", "year", F.lit(4).alias("q"), F.concat(F.lit("4T"), F.col("year").cast("string")).alias("period"), F.when(even, F.lit(0.0)).otherwise((F.col("year") + F.col("company")).cast("double")).alias("value"), F.lit("high").alias("confidence"))
    annual = y.filter(even).select("company", "year", F.lit(None).cast("int").alias("q"), F.concat(F.lit("FY"), F.col("year").cast("string")).alias("period"), (F.col("year") + F.col("company")).cast("double").alias("value"), F.lit("high").alias("confidence"))
    low = y.select("company", (F.col("year") + 1).alias("year"), F.lit(1).alias("q"), F.lit("1T").alias("period"), F.lit(-1.0).alias("value"), F.lit("low").alias("confidence"))
    units = unit.unionByName(annual).unionByName(low)
    return governance.comparison_payload(S.registry(spark, sf), rec, cyc, market.price_variation(S.prices(spark, sf)), units).withColumn("value", F.round("value", 6))


@query("i08_charts", f"""{_RECORDS} SELECT company, 'ciclo_financeiro' AS chart, 'FY' || year(e) AS period, round(CAST(cycle AS DOUBLE), 6) AS value, NULL AS quality FROM fy UNION ALL SELECT company, 'margem_bruta', 'FY' || year, mb, fb FROM an UNION ALL SELECT company, 'margem_operacional', 'FY' || year, mo, NULL FROM an
UNION ALL SELECT company, 'margem_ebitda', 'FY' || year, me, fm FROM an UNION ALL SELECT company, 'margem_liquida', 'FY' || year, ml, NULL FROM an""")
def i08_charts(spark, sf):
    return governance.comparison_charts(*_records(spark, sf)).withColumn("value", F.round("value", 6))


_TICKERS = [("T1", "t1", "saude"), ("T1", "OLD1 ", "saude"), ("T2", "T2", "Varejo"), ("T3", "T3", "saude"), ("T4", "T4", "varejo")]
_NAMES = [(s, m, a) for s in ("saude", "varejo") for m, a in (("Views", "view"), ("Views", "Views"), ("Clicks", " click "))] + [("varejo", "Buys", "purchase")]


@query("h01_parse_overrides", f"""{_O}, t AS (SELECT ordinal, CASE WHEN ticker = 'T1' AND ordinal % 2 = 0 THEN 'old1' ELSE lower(ticker) END AS raw, CASE WHEN ordinal % 3 = 0 THEN 'varejo' END AS sec, metric, ordinal % 6 AS k, year, q, CAST(floor(value) AS BIGINT) AS v FROM observations),
n AS (SELECT *, CASE WHEN raw IN ('t1', 'old1') THEN 'T1' WHEN raw IN ('t2', 't3', 't4') THEN upper(raw) END AS tk, CASE WHEN raw IN ('t1', 'old1', 't3') THEN 'saude' WHEN raw IN ('t2', 't4') THEN 'varejo' END AS home FROM t), o AS (SELECT *, coalesce(sec, home) AS own FROM n),
m AS (SELECT *, CASE WHEN own IN ('saude', 'varejo') THEN CASE WHEN metric = 'view' THEN 'Views' WHEN metric = 'click' THEN 'Clicks' WHEN metric = 'purchase' AND own = 'varejo' THEN 'Buys' END END AS name, CASE k WHEN 0 THEN q || 'T' || year % 100 WHEN 1 THEN q || 'T' || year % 100 WHEN 2 THEN 'FY' || year WHEN 3 THEN CAST(year AS VARCHAR) WHEN 4 THEN q || 'T' || year % 100 END AS p, CASE k WHEN 0 THEN CAST(v AS DOUBLE) WHEN 1 THEN -v - 0.5 WHEN 2 THEN 1000 + v % 10 / 10.0 WHEN 3 THEN CAST(v AS DOUBLE) WHEN 5 THEN CAST(v AS DOUBLE) END AS x FROM o)
SELECT ordinal, CASE WHEN tk IS NOT NULL AND own = home AND name IS NOT NULL AND p IS NOT NULL AND x IS NOT NULL THEN tk || '/' || own || '/' || name || '/' || p END AS key, CASE WHEN tk IS NOT NULL AND own = home AND name IS NOT NULL AND p IS NOT NULL THEN round(x, 4) END AS value,
CASE WHEN tk IS NULL THEN 'unknown_ticker' WHEN own <> home THEN 'sector_mismatch' WHEN name IS NULL THEN 'unknown_metric' WHEN p IS NULL THEN 'bad_period' WHEN x IS NULL THEN 'bad_value' END AS error FROM m""")
def h01(spark, sf):
    k, q, y, v = F.col("ordinal") % 6, F.col("q").cast("string"), F.col("year").cast("string"), F.floor("value").cast("long")
    yy = F.substring(y, 3, 2)
    period = F.when(k == 0, F.concat(q, F.lit("t"), yy)).when(k == 1, F.concat(q, F.lit(" Q "), y)).when(k == 2, F.concat(F.lit("fy"), yy)).when(k == 3, y).when(k == 4, F.concat(q, F.lit("T"), yy)).otherwise("5T24")
    value = F.when(k == 1, F.concat(F.lit("-"), v.cast("string"), F.lit(",5"))).when(k == 2, F.concat(F.lit("1.00"), F.lit("0,"), (v % 10).cast("string"))).when(k == 4, F.concat(v.cast("string"), F.lit("%"))).otherwise(v.cast("string"))
    o = S.observations(spark, sf).select("ordinal", F.when((F.col("ticker") == "T1") & (F.col("ordinal") % 2 == 0), "old1").otherwise(F.lower("ticker")).alias("ticker"), F.when(F.col("ordinal") % 3 == 0, "Varejo").alias("sector"), "metric", period.alias("period"), value.alias("value"))
    r = governance.parse_overrides(o, spark.createDataFrame(_TICKERS, "ticker string, alias string, sector string"), spark.createDataFrame(_NAMES, "sector string, metric string, alias string"))
    good = F.col("error").isNull()
    usable = good | (F.col("error") == "bad_value")
    return r.select("ordinal", F.when(good, F.concat_ws("/", "ticker", "sector", "metric", "period")).alias("key"), F.when(usable, F.round("value", 4)).alias("value"), "error")


_NEW = "CAST(substr(ticker, 2) AS INTEGER) % 4 = 0 AND year = 2023"


@query("g22_snapshot_outcome", f"""{_O}, c AS (SELECT DISTINCT ticker, CAST(substr(ticker, 2) AS INTEGER) AS k FROM observations WHERE ticker <> 'T8'), n AS (SELECT * FROM observations WHERE {_NEW}), o AS (SELECT * FROM observations WHERE CAST(substr(ticker, 2) AS INTEGER) % 4 < 2 AND year = 2022),
r AS (SELECT ticker, ordinal FROM n UNION ALL SELECT ticker, ordinal FROM o WHERE ticker NOT IN (SELECT ticker FROM n)), g AS (SELECT ticker, count(*) AS n_rows, min(ordinal) AS first_row FROM r GROUP BY 1)
SELECT c.ticker, coalesce(n_rows, 0) AS n_rows, first_row, CASE WHEN c.ticker IN (SELECT ticker FROM n) THEN 'found_new_data' WHEN c.ticker IN (SELECT ticker FROM o) THEN 'preserved_existing_data' WHEN k % 5 = 0 THEN 'extraction_failed' WHEN k % 5 < 3 THEN 'unsupported_document' ELSE 'source_unavailable' END AS status, CASE WHEN n_rows IS NULL THEN 'not_found' ELSE 'found' END AS coverage_status FROM c LEFT JOIN g USING (ticker)""")
def g22_outcome(spark, sf):
    o = S.observations(spark, sf)
    c = o.filter("ticker <> 'T8'").select("ticker").distinct()
    k = F.substring("ticker", 2, 9).cast("int")
    docs = c.filter(k % 5 < 3).select("ticker", F.explode(F.array(F.lit(None).cast("string"), F.when(k % 5 == 0, "error"))).alias("status"))
    rows, status = evidence.snapshot_outcome(c, o.filter((k % 4 == 0) & (F.col("year") == 2023)), o.filter((k % 4 < 2) & (F.col("year") == 2022)), docs)
    g = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ordinal").alias("first_row"))
    return status.join(g, "ticker", "left").select("ticker", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_row", "status", "coverage_status")


# filed account and description -> account of the cycle: coded and described ones, parents and leaves, excluded descriptions
_CYCLE_ACCOUNTS = (
    ("1.01.01", "Conta 0", "1.01.03", "Contas a Receber"), ("1.01.01", "Conta 1", "1.01.05", "Clientes diversos"), ("1.01.01", "Conta 2", "1.01.04", "Estoques"), ("1.01.01", "Conta 3", "1.02.01.08", "Direitos"),
    ("1.01.01", "Conta 4", "1.02.03", "Estoques de longo prazo"), ("1.01.02", "Conta 0", "1.02.01.04", "Áreas"), ("1.01.02", "Conta 1", "1.02.04", "Imóveis a Comercializar"), ("1.01.02", "Conta 2", "1.02.05", "Clientes - Partes Relacionadas"),
    ("1.01.02", "Conta 3", "1.02.04.01", "IMÓVEIS EM CONSTRUÇÃO"), ("1.01.02", "Conta 4", "1.03", "Conta a receber"), ("2.01.01", "Conta 0", "2.01.02", "Fornecedores"), ("2.01.01", "Conta 1", "2.02.03", "Terrenos a pagar"),
    ("2.01.01", "Conta 2", "2.02.03.01", "Terreno a Pagar"), ("2.01.01", "Conta 3", "2.02.04", "Financiamentos de terrenos a pagar"), ("2.01.01", "Conta 4", "2.01.05", "Fornecedor externo"), ("2.01.02", "Conta 0", "2.02.01.01", "Obrigações"),
    ("2.01.02", "Conta 1", "2.09", "Outros"),
)

# even companies have a long cycle; some companies lack a coded account, so that descriptions decide
_CYCLE_SQL = f"""{S.FILINGS}, names(f, d, code, description) AS (VALUES {", ".join(map(str, _CYCLE_ACCOUNTS))}),
a AS (SELECT company, ref_date, n.code, n.description, CAST(sum(value) AS DECIMAL(38,4)) AS value, min(ordinal) AS ordinal FROM filings t JOIN names n ON t.code = n.f AND t.description = n.d WHERE NOT (company % 4 = 1 AND n.code = '1.01.03') AND NOT (company % 4 = 3 AND n.code = '2.01.02') GROUP BY 1, 2, 3, 4),
t AS (SELECT *, lower(strip_accents(description)) AS x FROM a),
short AS (SELECT *, 'receivables' AS kind, code = '1.01.03' AS exact FROM t WHERE code = '1.01.03' OR regexp_matches(x, 'contas? a receber|clientes') UNION ALL SELECT *, 'inventories', code = '1.01.04' FROM t WHERE code = '1.01.04' OR x LIKE '%estoque%' UNION ALL SELECT *, 'payables', code = '2.01.02' FROM t WHERE code = '2.01.02' OR x LIKE '%fornecedore%'),
long AS (SELECT *, 'receivables' AS kind FROM t WHERE code IN ('1.01.03', '1.02.01.08', '1.02.01.09') OR (code LIKE '1.02%' AND regexp_matches(x, 'clientes|contas? a receber|recebiveis imobiliarios') AND NOT regexp_matches(x, 'partes relacionadas|tribut|aplicac|valor justo'))
  UNION ALL SELECT *, 'inventories' FROM t WHERE code IN ('1.01.04', '1.02.01.04', '1.02.01.05', '1.02.01.06') OR (code LIKE '1.02%' AND regexp_matches(x, 'estoque|imoveis a comercializar|(imoveis|unidades) em construcao|terrenos') AND NOT regexp_matches(x, 'investimento|imobilizado|intangivel|tribut'))
  UNION ALL SELECT *, 'payables' FROM t WHERE code IN ('2.01.02', '2.02.01.01', '2.02.01.02') OR (code LIKE '2.02%' AND regexp_matches(x, 'fornecedore|terrenos? a pagar|aquisicao de (terreno|imoveis)') AND NOT regexp_matches(x, 'emprestimo|financiamento|debentures|provis|tribut|partes relacionadas'))),
counted AS (SELECT company, ref_date, kind, code, description, value FROM (SELECT *, row_number() OVER (PARTITION BY company, ref_date, kind ORDER BY exact DESC, ordinal, code, description) AS i FROM short WHERE company % 2 = 1) WHERE i = 1
  UNION ALL SELECT company, ref_date, kind, code, description, value FROM long l WHERE company % 2 = 0 AND NOT EXISTS (SELECT 1 FROM long o WHERE o.company = l.company AND o.ref_date = l.ref_date AND o.kind = l.kind AND starts_with(o.code, l.code || '.')))"""


def _cycle_rows(spark, sf):
    names = spark.createDataFrame(list(_CYCLE_ACCOUNTS), "f string, d string, to_code string, to_description string")
    # tested on the lines as well, so that only named ones are shuffled to their orders
    f = S.filings(spark, sf).filter(F.concat_ws("|", "code", "description").isin([f"{a[0]}|{a[1]}" for a in _CYCLE_ACCOUNTS]))
    f = f.join(F.broadcast(names), (f.code == names.f) & (f.description == names.d)).filter("not (company % 4 = 1 and to_code = '1.01.03') and not (company % 4 = 3 and to_code = '2.01.02')")
    rows = f.groupBy("company", "ref_date", F.col("to_code").alias("code"), F.col("to_description").alias("description")).agg(F.sum("value").cast("decimal(38,4)").alias("value"), F.min("ordinal").alias("ordinal"))
    return rows.withColumn("extended", F.col("company") % 2 == 0)


@query("e14_cycle_accounts", f"""WITH {_CYCLE_SQL} SELECT company, ref_date, kind, code, description, CAST(value AS DOUBLE) AS value, code LIKE '1.01%' OR code LIKE '2.01%' AS current FROM counted""")
def e14_cycle(spark, sf):
    return cycle.cycle_accounts(_cycle_rows(spark, sf)).select("company", "ref_date", "kind", "code", "description", F.col("value").cast("double").alias("value"), "current")


@query("e12_sector_cycle", f"""WITH {_CYCLE_SQL}, {S.QUARTERS.replace(S._SALES + ', ', '')},
b AS MATERIALIZED (SELECT company, ref_date, sum(value) FILTER (kind = 'receivables') r, sum(value) FILTER (kind = 'inventories') i, sum(value) FILTER (kind = 'payables') p FROM (SELECT DISTINCT company, ref_date FROM a) LEFT JOIN counted USING (company, ref_date) GROUP BY 1, 2),
f AS (SELECT company, make_date(year, q * 3 - 2, 1) AS s, last_day(make_date(year, q * 3, 1)) AS e, revenue, abs(cost) c FROM quarter_facts),
j AS (SELECT f.*, o.r orr, o.i oi, o.p op, z.r zr, z.i zi, z.p zp, date_diff('day', s, e) + 1 AS days FROM (SELECT *, s - INTERVAL 1 DAY AS before FROM f) f ASOF LEFT JOIN b o ON f.company = o.company AND f.before >= o.ref_date ASOF LEFT JOIN b z ON f.company = z.company AND f.e >= z.ref_date),
k AS (SELECT *, CAST(orr + zr AS DOUBLE) / 2 ar, CAST(oi + zi AS DOUBLE) / 2 ai, CAST(op + zp AS DOUBLE) / 2 ap, CAST(c + zi - oi AS DOUBLE) AS buy FROM j),
m AS (SELECT *, CASE WHEN ar IS NULL OR ai IS NULL OR ap IS NULL THEN 'missing_balance' WHEN revenue <= 0 OR c <= 0 OR buy <= 0 THEN 'invalid_denominator' END AS error FROM k)
SELECT company, CAST(s AS DATE) AS start, e AS "end", CASE WHEN error IS NULL THEN round(ar / CAST(revenue AS DOUBLE) * days, 4) END AS pmr, CASE WHEN error IS NULL THEN round(ai / CAST(c AS DOUBLE) * days, 4) END AS pme, CASE WHEN error IS NULL THEN round(ap / buy * days, 4) END AS pmp, error FROM m""")
def e12_sector(spark, sf):
    f = S.quarter_facts(spark, sf).select("company", F.make_date("year", F.col("q") * 3 - 2, F.lit(1)).alias("start"), F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("end"), "revenue", F.col("cost").alias("cogs"))
    return indicators.cash_cycle(cycle.cycle_balances(_cycle_rows(spark, sf)), f).select("company", "start", "end", "pmr", "pme", "pmp", "error")
