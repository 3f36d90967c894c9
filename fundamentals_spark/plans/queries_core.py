"""Registered queries of the filing, account, indicator and market operators, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import accounts, filings, indicators, market
from fundamentals_spark.plans import standins as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("b01_norm_text", r"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[ \t\n\r\f]+', ' ', 'g'))) AS fold, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS token FROM documents""")
def b01(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.md5(T.norm_text(t)).alias("fold"), F.md5(T.norm_text(t, "token")).alias("token"))


# the minus of a range or a date is no sign, so these are no numbers
@query("b03_parse_number", """WITH s AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) s FROM orders)
SELECT o_orderkey, CAST(CASE o_orderkey % 9 WHEN 0 THEN CAST(s AS DECIMAL(38,6)) WHEN 1 THEN CAST(s AS DECIMAL(38,6)) WHEN 2 THEN -CAST(s AS DECIMAL(38,6)) WHEN 4 THEN CAST(split_part(s, '.', 1) || '000' AS DECIMAL(38,6)) WHEN 5 THEN -CAST(s AS DECIMAL(38,6)) END AS DOUBLE) AS value FROM s""")
def b03(spark, sf):
    s = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 9
    comma = F.replace(s, F.lit("."), F.lit(","))
    shown = (
        F.when(k == 0, s).when(k == 1, comma).when(k == 2, F.concat(F.lit("("), comma, F.lit(")"))).when(k == 3, F.concat(s, F.lit("%"))).when(k == 4, F.concat(F.substring_index(s, ".", 1), F.lit("000,00")))
        .when(k == 5, F.concat(F.lit("R$ -"), comma)).when(k == 6, F.concat(F.substring_index(s, ".", 1), F.lit("-05"))).when(k == 7, F.concat(s, F.lit("-"))).otherwise(F.concat(F.lit("-("), s, F.lit(")")))
    )
    return read(spark, sf, "orders").select("o_orderkey", T.parse_number(shown).cast("double").alias("value"))


_BASIS_TERMS = ("VGV participação da Companhia", "Participação de mercado", "100% dos projetos", "VGV (cem por cento)", "Total projects", "Vendas ex permuta 100%", "Vendas % Even", "% companhia 100%", "Vendas totais")


@query("b09_ownership_basis", """WITH t AS (SELECT p_partkey, lower(strip_accents(p_type || ' ' || ([""" + ", ".join(f"'{t}'" for t in _BASIS_TERMS) + """])[p_partkey % 9 + 1])) AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, 'participacao da companhia|company share|% companhia|%avll|% cal|%ez|% even|%cbr|ex permuta') THEN 'company_share' WHEN regexp_matches(t, '100%|cem por cento|total projects') THEN 'one_hundred_percent' ELSE 'unknown' END AS basis FROM t""")
def b09(spark, sf):
    term = F.element_at(F.array(*map(F.lit, _BASIS_TERMS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", T.ownership_basis(F.concat_ws(" ", "p_type", term)).alias("basis"))


@query("b04_norm_codes", """SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS cvm, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 14, '0') AS cnpj FROM customer""")
def b04(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", T.norm_cvm_code(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0"))).alias("cvm"), T.norm_cnpj(F.col("c_name")).alias("cnpj"))


@query("b06_periods", """WITH p AS (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders)
SELECT o_orderkey, q || 'T' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS label, CASE o_orderkey % 4 WHEN 0 THEN 'quarter' WHEN 1 THEN 'ltm' WHEN 2 THEN 'ytd' ELSE 'annual' END AS kind,
CAST(2000 + y % 100 AS INTEGER) AS parsed_year, CAST(CASE WHEN o_orderkey % 4 < 3 THEN q END AS INTEGER) AS parsed_quarter FROM p WHERE 2000 + y % 100 <= 2050
UNION ALL SELECT o_orderkey, q || 'T' || lpad(CAST(y % 100 AS VARCHAR), 2, '0'), NULL, NULL, NULL FROM p WHERE 2000 + y % 100 > 2050""")
def b06(spark, sf):
    d = F.to_date("o_orderdate")
    lab = T.quarter_label(d)
    yy = F.lpad((F.year(d) % 100).cast("string"), 2, "0")
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.replace(lab, F.lit("T"), F.lit("q20"))).when(k == 1, F.concat(F.lit("LTM "), lab)).when(k == 2, F.concat((F.quarter(d) * 3).cast("string"), F.lit("M"), yy)).otherwise(F.concat(F.lit("FY"), yy))
    return read(spark, sf, "orders").select("o_orderkey", lab.alias("label"), T.parse_period(shown, 2050).alias("p")).select("o_orderkey", "label", F.col("p.kind").alias("kind"), F.col("p.year").alias("parsed_year"), F.col("p.quarter").alias("parsed_quarter"))


@query("b07_norm_unit", """SELECT p_partkey, round(p_retailprice * CASE p_partkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1 WHEN 2 THEN 0.001 ELSE 0.000001 END, 9) AS value, p_partkey % 4 <> 1 AS converted FROM part""")
def b07(spark, sf):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, "R$ bilhões").when(k == 1, "R$ MM").when(k == 2, "R$ mil").otherwise("R$")
    return read(spark, sf, "part").select("p_partkey", T.norm_unit(F.col("p_retailprice"), unit).alias("u")).select("p_partkey", F.round("u.value", 9).alias("value"), F.col("u.converted").alias("converted"))


@query("b08_account_codes", f"""WITH {S.BALANCES} SELECT DISTINCT code, len(string_split(code, '.')) - 1 AS depth, CASE WHEN code LIKE '1%' THEN 'assets' ELSE 'liabilities' END AS side, list_aggregate(list_transform(string_split(code, '.'), lambda x: lpad(x, 6, '0')), 'string_agg', '.') AS sort_key,
list_aggregate(string_split(code, '.')[1:len(string_split(code, '.')) - 1], 'string_agg', '.') AS parent FROM balances""")
def b08(spark, sf):
    c = F.col("code")
    return S.balances(spark, sf).select("code").distinct().select("code", T.account_depth(c).cast("long").alias("depth"), T.balance_side(c).alias("side"), T.account_sort_key(c).alias("sort_key"), T.account_parent(c).alias("parent"))


@query("b12_line_tokens", r"""SELECT o_orderkey, quarter(o_orderdate) || 'T' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS period, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS first_value, 2 AS n_values FROM orders""")
def b12(spark, sf):
    line = F.concat(F.lit("| Vendas <b>"), T.quarter_label(F.to_date("o_orderdate")), F.lit("</b> | R$ "), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" | 12,5% | 7 |"))
    return read(spark, sf, "orders").select("o_orderkey", F.try_element_at(T.line_periods(line), F.lit(1)).alias("period"), F.try_element_at(T.line_values(line), F.lit(1)).cast("double").alias("first_value"), F.size(T.line_values(line)).alias("n_values"))


@query("c03_exercise_order", f"""WITH {S.FILINGS}, t AS (SELECT *, trim(upper(strip_accents(order_word))) w FROM filings)
SELECT company, count(*) FILTER (w = 'ULTIMO') AS exact, count(*) FILTER (contains(w, 'ULTIMO') AND NOT contains(w, 'PENULTIMO')) AS not_previous, count(*) FILTER (contains(w, 'ULTIMO')) AS contains_word FROM t GROUP BY 1""")
def c03(spark, sf):
    keep = {m: filings.keeps_order(F.col("order_word"), m) for m in ("exact", "not_previous", "contains")}
    n = {m: F.count_if(k).alias("contains_word" if m == "contains" else m) for m, k in keep.items()}
    return S.filings(spark, sf).groupBy("company").agg(*n.values())


@query("c04_latest_version", f"""WITH {S.FILINGS}, t AS (SELECT *, max(version) OVER (PARTITION BY company, ref_date) m FROM filings), r AS (SELECT *, row_number() OVER (PARTITION BY company, ref_date, statement, code ORDER BY ordinal DESC, value DESC) k FROM t WHERE version = m)
SELECT company, ref_date, statement, code, version, CAST(value AS DOUBLE) AS value, ordinal FROM r WHERE k = 1""")
def c04(spark, sf):
    return filings.latest_version(S.filings(spark, sf), ["company", "ref_date"], ["statement", "code"], tiebreak=("ordinal", "value")).select("company", "ref_date", "statement", "code", "version", F.col("value").cast("double").alias("value"), "ordinal")


@query("c05_latest_restatement", f"""WITH {S.FILINGS} SELECT company, code, max_by(CAST(value AS DOUBLE), ordinal + 1000000000000 * version) AS value, max(version) AS version FROM filings WHERE statement = 'DRE' GROUP BY 1, 2""")
def c05(spark, sf):
    f = S.filings(spark, sf, place=True).filter("statement = 'DRE'").select("company", "code", "version", "ordinal", "place", F.col("value").cast("double").alias("value"))
    return filings.latest_restatement(f, ["company", "code"], ["version", "ordinal"], ("place",)).select("company", "code", "value", "version")


@query("c06_cash_flow_guard", f"""WITH {S.FILINGS}, f AS (SELECT company, ref_date, version, CASE WHEN ordinal % 211 = 0 THEN 'MD' ELSE 'MI' END AS m, max(version) OVER (PARTITION BY company, ref_date) v FROM filings),
g AS (SELECT company, ref_date, count(*) n_rows, count(DISTINCT m) n FROM f WHERE version = v GROUP BY 1, 2) SELECT company, ref_date, CASE WHEN n = 1 THEN n_rows END AS n_rows, CASE WHEN n > 1 THEN 'mixed_cash_flow_methods' END AS error FROM g""")
def c06(spark, sf):
    f = S.filings(spark, sf).withColumn("method", F.when(F.col("ordinal") % 211 == 0, "MD").otherwise("MI"))
    rows, errors = filings.latest_cash_flow(f)
    return rows.groupBy("company", "ref_date").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("error", F.lit(None).cast("string")).unionByName(errors.select("company", "ref_date", F.lit(None).cast("long").alias("n_rows"), "error"))


@query("c07_share_capital", f"""WITH {S.FILINGS}, sp AS (SELECT DISTINCT company, unnest(generate_series(DATE '1995-03-31', DATE '2001-06-30', INTERVAL 3 MONTH)) d FROM filings), spine AS (SELECT company, last_day(CAST(d AS DATE)) ref_date FROM sp),
f AS (SELECT company, ref_date, max_by(l, version * 1000000000000 + ordinal) AS shares FROM (SELECT *, ordinal * 10 AS l FROM filings WHERE company % 2 = 0) GROUP BY 1, 2)
SELECT spine.company, spine.ref_date, shares, CASE WHEN shares IS NULL THEN 'missing' ELSE 'reported' END AS status FROM spine LEFT JOIN f USING (company, ref_date)""")
def c07(spark, sf):
    f = S.filings(spark, sf)
    spine = filings.quarter_spine(f.select("company").distinct(), F.lit("1995-01-01").cast("date"), F.lit("2001-06-30").cast("date"))
    capital = f.filter("company % 2 = 0").select("company", "ref_date", "version", F.col("ordinal").alias("is_dfp"), (F.col("ordinal") * 10).alias("shares"))
    return filings.latest_share_capital(capital, spine)


@query("c12_filing_audit", f"""WITH {S.FILINGS}, {S.REGISTRY}, a AS (SELECT company, count(*) lines, count(DISTINCT ref_date) dates, string_agg(DISTINCT CAST(version AS VARCHAR), ',' ORDER BY CAST(version AS VARCHAR)) AS versions FROM filings WHERE company % 6 <> 1 GROUP BY 1)
SELECT r.company, coalesce(lines, 0) AS lines, coalesce(dates, 0) AS dates, versions, CASE WHEN lines IS NULL THEN 'missing' ELSE 'OK' END AS status FROM registry r LEFT JOIN a USING (company)""")
def c12(spark, sf):
    return filings.filing_audit(S.filings(spark, sf).filter("company % 6 <> 1"), S.registry(spark, sf))


@query("d01_master_accounts", f"""WITH {S.FILINGS} SELECT statement, code, max_by(description, (epoch(ref_date) / 86400) * 1000000000000 + version * 10000000000 + ordinal) AS description FROM filings GROUP BY 1, 2""")
def d01(spark, sf):
    return accounts.master_accounts(S.filings(spark, sf, place=True), ["statement", "code"], ["ref_date", "version", "ordinal"], ("place",)).select("statement", "code", "description")


@query("d02_master_accounts_mode", f"""WITH {S.FILINGS}, c AS (SELECT code, description, count(*) n, max(ref_date) l FROM filings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, l DESC, description) k FROM c) SELECT code, description, n FROM r WHERE k = 1""")
def d02(spark, sf):
    return accounts.master_accounts_mode(S.filings(spark, sf))


@query("d03_dense_matrix", f"""WITH {S.BALANCES}, s AS (SELECT DISTINCT company, ref_date FROM balances), c AS (SELECT DISTINCT code FROM balances) SELECT company, ref_date, code, CAST(v.value AS DOUBLE) AS value FROM s CROSS JOIN c LEFT JOIN balances v USING (company, ref_date, code)""")
def d03(spark, sf):
    return accounts.dense_matrix(S.balances(spark, sf), ["company"]).select("company", "ref_date", "code", F.col("value").cast("double").alias("value"))


@query("d04_synthetic_accounts", f"""WITH {S.BALANCES}, p AS (SELECT *, CASE WHEN code IN ('1.01.01', '1.01.02') THEN '1.01.AG' END AS parent FROM balances)
SELECT company, ref_date, code, CAST(value AS DOUBLE) AS value, parent FROM p UNION ALL SELECT company, ref_date, parent, CAST(sum(value) AS DOUBLE), NULL FROM p WHERE parent IS NOT NULL GROUP BY 1, 2, 3""")
def d04(spark, sf):
    defs = spark.createDataFrame([("1.01.AG", "1.01.01"), ("1.01.AG", "1.01.02")], "synthetic string, code string")
    return accounts.synthetic_accounts(S.balances(spark, sf), defs, ["company", "ref_date"]).withColumn("value", F.col("value").cast("double"))


@query("d05_root_or_leaf_sum", f"""WITH {S.BALANCES}, a AS (SELECT company, ref_date, '2.01.04' AS root, max(value) FILTER (code = '2.01.04') own, sum(value) FILTER (code LIKE '2.01.04.%') leaves FROM balances WHERE code LIKE '2.01.04%' GROUP BY 1, 2)
SELECT company, ref_date, root, CAST(coalesce(own, leaves) AS DOUBLE) AS value, CASE WHEN own IS NULL THEN 'leaves' ELSE 'root' END AS method FROM a""")
def d05(spark, sf):
    return accounts.root_or_leaf_sum(S.balances(spark, sf), ["2.01.04"], ["company", "ref_date"]).select("company", "ref_date", "root", F.col("value").cast("double").alias("value"), "method")


@query("d06_leaves_only", f"""WITH {S.BALANCES} SELECT company, ref_date, code, CAST(value AS DOUBLE) AS value FROM balances b WHERE NOT EXISTS (SELECT 1 FROM balances c WHERE c.company = b.company AND c.ref_date = b.ref_date AND c.code LIKE b.code || '.%')""")
def d06(spark, sf):
    return accounts.leaves_only(S.balances(spark, sf), ["company", "ref_date"]).select("company", "ref_date", "code", F.col("value").cast("double").alias("value"))


@query("d07_fourth_quarter", f"""WITH {S.QUARTERS}, p AS (SELECT company, year, max(revenue) FILTER (q = 1) q1, max(revenue) FILTER (q = 2) q2, max(revenue) FILTER (q = 3) q3, max(revenue) FILTER (q = 4 AND company % 2 = 0) q4, sum(revenue) fy FROM quarter_facts GROUP BY 1, 2)
SELECT company, year, 'Q4' AS part, CAST(fy - q1 - q2 - q3 AS DOUBLE) AS value, true AS derived FROM p WHERE q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL AND q4 IS NULL""")
def d07(spark, sf):
    f = S.quarter_facts(spark, sf)
    rows = f.filter("q < 4 or company % 2 = 0").select("company", "year", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("part"), F.col("revenue").alias("value"))
    fy = f.groupBy("company", "year").agg(F.sum("revenue").cast("decimal(38,4)").alias("value")).select("company", "year", F.lit("FY").alias("part"), "value")
    return accounts.derive_q4(rows.unionByName(fy), ["company"]).withColumn("value", F.col("value").cast("double"))


@query("d08_isolate_quarters", f"""WITH {S.MIXED}, y AS (SELECT company, year, q, revenue FROM mixed_facts WHERE is_ytd OR q = 1)
SELECT a.company, a.year, a.q, CAST(CASE WHEN a.is_ytd AND a.q > 1 THEN a.revenue - y.revenue ELSE a.revenue END AS DOUBLE) AS revenue, CASE WHEN a.is_ytd AND a.q > 1 THEN 'ytd_menos_ytd_anterior' ELSE 'periodo_isolado' END AS source FROM mixed_facts a LEFT JOIN y ON a.company = y.company AND a.year = y.year AND a.q = y.q + 1""")
def d08(spark, sf):
    return accounts.isolate_quarters(S.mixed_facts(spark, sf), ["company"], "revenue").withColumn("revenue", F.col("revenue").cast("double"))


@query("d10_balance_check", f"""WITH {S.BALANCES}, a AS (SELECT company, ref_date, value FROM balances WHERE code = '1'), l AS (SELECT company, ref_date, value FROM balances WHERE code = '2')
SELECT company, ref_date, CAST(a.value AS DOUBLE) AS assets, CAST(l.value AS DOUBLE) AS liabilities, CASE WHEN abs(a.value - l.value) <= 1 THEN 'OK' ELSE 'VERIFY' END AS status FROM a FULL JOIN l USING (company, ref_date)""")
def d10(spark, sf):
    return accounts.balance_check(S.balances(spark, sf)).select("company", "ref_date", F.col("assets").cast("double").alias("assets"), F.col("liabilities").cast("double").alias("liabilities"), "status")


@query("d11_verify_coverage", f"""WITH {S.BALANCES}, {S.REGISTRY}, g AS (SELECT company, count(*) n, count(DISTINCT ref_date) d FROM balances GROUP BY 1), j AS (SELECT r.company, coalesce(n, 0) AS n_rows, coalesce(d, 0) AS n_dates FROM registry r LEFT JOIN g USING (company))
SELECT *, CASE WHEN n_rows = 0 THEN 'missing' WHEN n_rows = max(n_rows) OVER () THEN 'OK' ELSE 'incomplete' END AS status FROM j""")
def d11(spark, sf):
    return accounts.verify_coverage(S.balances(spark, sf), S.registry(spark, sf))


_DEBT = """debt AS (SELECT company, ref_date, coalesce(max(value) FILTER (code = '2.01.04'), sum(value) FILTER (code LIKE '2.01.04.%')) AS short, max(value) FILTER (code = '1.01.01') AS cash, max(value) FILTER (code = '1.01.02') AS inv, sum(value) FILTER (code = '2.02.09') AS leases FROM balances GROUP BY 1, 2),
net AS (SELECT company, ref_date, CAST(short + coalesce(leases, 0) - cash - coalesce(inv, 0) AS DOUBLE) AS net_debt, CASE WHEN short IS NULL THEN 'no_debt_account' WHEN cash IS NULL THEN 'no_cash_account' END AS error FROM debt)"""


@query("e01_net_debt", f"WITH {S.BALANCES}, {_DEBT} SELECT * FROM net")
def e01(spark, sf):
    return indicators.net_debt(S.balances(spark, sf), include_leases=True).select("company", "ref_date", F.col("net_debt").cast("double").alias("net_debt"), "error")


@query("e02_leases", f"WITH {S.BALANCES} SELECT company, ref_date, code, CAST(value AS DOUBLE) AS value FROM balances WHERE code = '2.02.09'")
def e02(spark, sf):
    return indicators.lease_accounts(S.balances(spark, sf), ["company", "ref_date"]).select("company", "ref_date", "code", F.col("value").cast("double").alias("value"))


@query("e06_margins", f"""WITH {S.QUARTERS}, t AS (SELECT *, ebit - da AS net, company % 9 = 4 AS ifrs FROM quarter_facts)
SELECT company, year, q, CAST(ebit + da AS DOUBLE) AS ebitda, CASE WHEN NOT ifrs THEN round(CAST(revenue + cost AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 6) END AS gross_margin, CASE WHEN NOT ifrs THEN round(CAST(ebit AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 6) END AS operating_margin,
CASE WHEN NOT ifrs THEN round(CAST(ebit + da AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 6) END AS ebitda_margin, CASE WHEN NOT ifrs THEN round(CAST(net AS DOUBLE) * 100 / CAST(revenue AS DOUBLE), 6) END AS net_margin, CASE WHEN ifrs THEN 'not_comparable' END AS margin_flag FROM t""")
def e06(spark, sf):
    rules = S.registry(spark, sf).select("company", (F.col("company") % 9 == 4).alias("ifrs17"))
    m = indicators.margins(S.quarter_facts(spark, sf).withColumn("net_income", F.col("ebit") - F.col("da")), rules)
    return m.select("company", "year", "q", F.col("ebitda").cast("double").alias("ebitda"), *[F.round(c, 6).alias(c) for c in ("gross_margin", "operating_margin", "ebitda_margin", "net_margin")], "margin_flag")


_LTM = """w AS (SELECT company, year, q, sum(ebit + da) OVER f AS s, count(ebit + da) OVER f AS n FROM quarter_facts WINDOW f AS (PARTITION BY company ORDER BY year * 4 + q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
ltm AS (SELECT company, year, q, CASE WHEN n = 4 THEN CAST(s AS DOUBLE) END AS ebitda_ltm, n = 4 AS complete FROM w)"""


@query("e07_ltm", f"WITH {S.QUARTERS}, {_LTM} SELECT * FROM ltm")
def e07(spark, sf):
    m = indicators.margins(S.quarter_facts(spark, sf))
    return indicators.ltm(m, "ebitda", ["company"]).select("company", "year", "q", F.col("ebitda_ltm").cast("double").alias("ebitda_ltm"), "complete")


@query("e08_working_capital", f"""WITH {S.BALANCES}, {S.QUARTERS.replace(S._SALES + ', ', '')}, r AS (SELECT company, last_day(make_date(year, q * 3, 1)) ref_date, revenue FROM quarter_facts), a AS (SELECT company, ref_date, value FROM balances WHERE code = '1.01'), l AS (SELECT company, ref_date, value FROM balances WHERE code = '2.01')
SELECT company, ref_date, CAST(a.value - l.value AS DOUBLE) AS working_capital, round(CAST(a.value - l.value AS DOUBLE) * 100 / nullif(CAST(revenue AS DOUBLE), 0), 6) AS pct_of_revenue FROM a JOIN l USING (company, ref_date) LEFT JOIN r USING (company, ref_date)""")
def e08(spark, sf):
    revenue = S.quarter_facts(spark, sf).select("company", F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("ref_date"), "revenue")
    return indicators.working_capital(S.balances(spark, sf), revenue).select("company", "ref_date", F.col("working_capital").cast("double").alias("working_capital"), F.round("pct_of_revenue", 6).alias("pct_of_revenue"))


_EV = f"""WITH {S.BALANCES}, {_DEBT}, {S.MARKET_CAPS.replace(S._SALES + ', ', '')}, ev AS (SELECT company, ref_date, market_cap + net_debt AS ev FROM market_caps JOIN net USING (company, ref_date) WHERE market_cap IS NOT NULL AND status = 'validated' AND net_debt IS NOT NULL AND error IS NULL)"""


def _ev(spark, sf):
    return indicators.enterprise_value(S.market_caps(spark, sf), indicators.net_debt(S.balances(spark, sf), include_leases=True))


def _ebitda(spark, sf):
    m = indicators.ltm(indicators.margins(S.quarter_facts(spark, sf)), "ebitda", ["company"])
    return m.select("company", F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("ref_date"), "ebitda_ltm")


@query("e09_enterprise_value", f"{_EV} SELECT company, ref_date, round(ev, 4) AS ev FROM ev")
def e09(spark, sf):
    return _ev(spark, sf).select("company", "ref_date", F.round("ev", 4).alias("ev"))


@query("e10_ev_ebitda", f"""{_EV}, {_LTM}, l AS (SELECT company, last_day(make_date(year, q * 3, 1)) ref_date, ebitda_ltm FROM ltm) SELECT company, ref_date, round(ev / nullif(ebitda_ltm, 0), 6) AS ev_ebitda, CASE WHEN nullif(ebitda_ltm, 0) IS NULL THEN 'incomplete' END AS flag FROM ev LEFT JOIN l USING (company, ref_date)""")
def e10(spark, sf):
    return indicators.ev_ebitda(_ev(spark, sf), _ebitda(spark, sf)).select("company", "ref_date", F.round("ev_ebitda", 6).alias("ev_ebitda"), "flag")


@query("e11_cagr", f"""WITH {S.QUARTERS}, y AS (SELECT company, year, sum(revenue) r FROM quarter_facts GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC) k FROM y), g AS (SELECT company, CAST(min_by(r, year) AS DOUBLE) a, CAST(max_by(r, year) AS DOUBLE) b, count(*) AS points FROM t WHERE k <= 5 GROUP BY 1)
SELECT company, points, CASE WHEN points >= 2 AND a > 0 AND b > 0 THEN round((pow(b / a, 1.0 / (points - 1)) - 1) * 100, 6) END AS cagr FROM g""")
def e11(spark, sf):
    y = S.quarter_facts(spark, sf).groupBy("company", "year").agg(F.sum("revenue").alias("r"))
    return indicators.cagr(y, "r", ["company"]).select("company", "points", F.round("cagr", 6).alias("cagr"))


def _cycle_inputs(spark, sf):
    b = S.balances(spark, sf).groupBy("company", "ref_date").agg(*[F.sum(F.when(F.col("code") == c, F.col("value"))).alias(n) for c, n in (("1.01.01", "receivables"), ("1.01.02", "inventories"), ("2.01.04.01", "payables"))])
    f = S.quarter_facts(spark, sf).select("company", F.make_date("year", F.col("q") * 3 - 2, F.lit(1)).alias("start"), F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("end"), "revenue", F.col("cost").alias("cogs"))
    return b, f


@query("e12_cash_cycle", f"""WITH {S.BALANCES}, {S.QUARTERS.replace(S._SALES + ', ', '')},
b AS (SELECT company, ref_date, sum(value) FILTER (code = '1.01.01') r, sum(value) FILTER (code = '1.01.02') i, sum(value) FILTER (code = '2.01.04.01') p FROM balances GROUP BY 1, 2),
f AS (SELECT company, make_date(year, q * 3 - 2, 1) AS s, last_day(make_date(year, q * 3, 1)) AS e, revenue, abs(cost) c FROM quarter_facts),
j AS (SELECT f.*, o.r orr, o.i oi, o.p op, z.r zr, z.i zi, z.p zp, date_diff('day', s, e) + 1 AS days FROM (SELECT *, s - INTERVAL 1 DAY AS before FROM f) f ASOF LEFT JOIN b o ON f.company = o.company AND f.before >= o.ref_date ASOF LEFT JOIN b z ON f.company = z.company AND f.e >= z.ref_date),
k AS (SELECT *, CAST(orr + zr AS DOUBLE) / 2 ar, CAST(oi + zi AS DOUBLE) / 2 ai, CAST(op + zp AS DOUBLE) / 2 ap, CAST(c + zi - oi AS DOUBLE) AS buy FROM j),
m AS (SELECT *, CASE WHEN ar IS NULL OR ai IS NULL OR ap IS NULL THEN 'missing_balance' WHEN revenue <= 0 OR c <= 0 OR buy <= 0 THEN 'invalid_denominator' END AS error FROM k)
SELECT company, CAST(s AS DATE) AS start, e AS "end", CASE WHEN error IS NULL THEN round(ar / CAST(revenue AS DOUBLE) * days, 4) END AS pmr, CASE WHEN error IS NULL THEN round(ai / CAST(c AS DOUBLE) * days, 4) END AS pme, CASE WHEN error IS NULL THEN round(ap / buy * days, 4) END AS pmp, error FROM m""")
def e12(spark, sf):
    return indicators.cash_cycle(*_cycle_inputs(spark, sf)).select("company", "start", "end", "pmr", "pme", "pmp", "error")


# every third account changes its sign, so bases are negative too; fourth quarters of some companies lack their first account
@query("e15_horizontal", f"""WITH {S.BALANCES}, t AS (SELECT company, ref_date, code, CASE WHEN code LIKE '%.02' THEN -value ELSE value END AS value FROM balances WHERE NOT (company % 4 = 1 AND code = '1.01.01' AND month(ref_date) = 12)),
d AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY ref_date) n FROM (SELECT DISTINCT company, ref_date FROM t)), r AS (SELECT t.*, n FROM t JOIN d USING (company, ref_date)), s AS (SELECT *, lag(value) OVER (PARTITION BY company, code ORDER BY ref_date) seen FROM r)
SELECT a.company, a.ref_date, a.code, round((CAST(a.value AS DOUBLE) / nullif(CAST(b.value AS DOUBLE), 0) - 1) * 100, 4) AS horizontal, round((CAST(a.value AS DOUBLE) / nullif(CAST(seen AS DOUBLE), 0) - 1) * 100, 4) AS last_seen FROM s a LEFT JOIN r b ON a.company = b.company AND a.code = b.code AND a.n = b.n + 1""")
def e15(spark, sf):
    b = S.balances(spark, sf).filter("not (company % 4 = 1 and code = '1.01.01' and month(ref_date) = 12)").withColumn("value", F.when(F.col("code").endswith(".02"), -F.col("value")).otherwise(F.col("value")))
    h = indicators.horizontal(b, ["company", "code"], "ref_date", "value").withColumnRenamed("horizontal", "adjacent")
    h = indicators.horizontal(h, ["company", "code"], "ref_date", "value", mode="last_seen")
    return h.select("company", "ref_date", "code", F.round("adjacent", 4).alias("horizontal"), F.round("horizontal", 4).alias("last_seen"))


@query("e16_vertical", f"""WITH {S.BALANCES}, i AS (SELECT company, ref_date, code, CAST(sum(value) AS DECIMAL(38,4)) AS value FROM filings WHERE statement = 'DRE' GROUP BY 1, 2, 3), a AS (SELECT company, ref_date, code, value FROM balances UNION ALL SELECT company, ref_date, CASE code WHEN '3.01.01' THEN '3.01' ELSE code END, value FROM i)
SELECT a.company, a.ref_date, a.code, round(CAST(a.value AS DOUBLE) * 100 / nullif(CAST(t.value AS DOUBLE), 0), 4) AS vertical FROM a LEFT JOIN a t ON a.company = t.company AND a.ref_date = t.ref_date AND t.code = CASE substr(a.code, 1, 1) WHEN '1' THEN '1' WHEN '2' THEN '2' ELSE '3.01' END""")
def e16(spark, sf):
    income = S.filings(spark, sf).filter("statement = 'DRE'").groupBy("company", "ref_date", "code").agg(F.sum("value").cast("decimal(38,4)").alias("value"))
    income = income.withColumn("code", F.when(F.col("code") == "3.01.01", "3.01").otherwise(F.col("code")))
    rows = S.balances(spark, sf).select("company", "ref_date", "code", "value").unionByName(income)
    return indicators.vertical(rows, ["company", "ref_date"], "value").select("company", "ref_date", "code", F.round("vertical", 4).alias("vertical"))


@query("e17_reconcile", f"""WITH {S.QUARTERS}, t AS (SELECT company, year, q, revenue AS o, CASE WHEN (company + q) % 5 = 0 THEN NULL ELSE CAST(revenue * (1000 + (company * 7 + q * 3 + year) % 80) / 1000 AS DECIMAL(38,4)) END AS d, (company + year) % 13 = 0 AS m FROM quarter_facts), x AS (SELECT *, abs(CAST(d - o AS DOUBLE)) / abs(CAST(o AS DOUBLE)) AS diff FROM t)
SELECT company, year, q, CASE WHEN d IS NULL THEN 'MISSING' WHEN m THEN 'METHODOLOGY' WHEN diff <= 0.01 THEN 'MATCH' WHEN diff <= 0.05 THEN 'IMMATERIAL' ELSE 'MATERIAL' END AS status FROM x""")
def e17(spark, sf):
    f = S.quarter_facts(spark, sf)
    d = F.when((F.col("company") + F.col("q")) % 5 == 0, None).otherwise((F.col("revenue").cast("decimal(24,4)") * (1000 + (F.col("company") * 7 + F.col("q") * 3 + F.col("year")) % 80) / 1000).cast("decimal(24,4)"))
    r = indicators.reconcile(f.select("company", "year", "q", F.col("revenue").cast("decimal(24,4)").alias("official"), d.alias("disclosed"), ((F.col("company") + F.col("year")) % 13 == 0).alias("methodology")))
    return r.select("company", "year", "q", "status")


def _ref_dates(spark, sf):
    return S.quarter_facts(spark, sf).select("company", F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("at"))


_AT = "ats AS (SELECT company, last_day(make_date(year, q * 3, 1)) AS at_date FROM quarter_facts)"


@query("f01_price_as_of", f"""WITH {S.QUARTERS}, {S.PRICES}, {_AT}, p AS (SELECT *, coalesce(product(CASE WHEN split_factor > 0 THEN split_factor ELSE 1 END) OVER (PARTITION BY company ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) fut FROM prices)
SELECT a.company, a.at_date, CASE WHEN date_diff('day', date, at_date) <= 7 THEN date END AS date, CASE WHEN date_diff('day', date, at_date) <= 7 THEN round(close * fut, 6) END AS price FROM ats a ASOF LEFT JOIN p ON a.company = p.company AND a.at_date >= p.date""")
def f01(spark, sf):
    return market.price_as_of(S.prices(spark, sf), _ref_dates(spark, sf)).withColumnRenamed("at", "at_date")


@query("f02_adjusted_price", f"""WITH {S.QUARTERS}, {S.PRICES}, {_AT} SELECT a.company, a.at_date, CASE WHEN date_diff('day', date, at_date) <= 7 THEN date END AS date, CASE WHEN date_diff('day', date, at_date) <= 7 THEN adj_close END AS adj_close FROM ats a ASOF LEFT JOIN prices p ON a.company = p.company AND a.at_date >= p.date""")
def f02(spark, sf):
    return market.adjusted_price_as_of(S.prices(spark, sf), _ref_dates(spark, sf)).withColumnRenamed("at", "at_date")


@query("f03_shares_as_of", f"""WITH {S.QUARTERS}, {S.PRICES}, {_AT}, s AS (SELECT company, date, CAST(floor(close) AS BIGINT) AS shares FROM prices WHERE split_factor > 0) SELECT a.company, a.at_date, date, shares FROM ats a ASOF LEFT JOIN s ON a.company = s.company AND a.at_date >= s.date""")
def f03(spark, sf):
    s = S.prices(spark, sf).filter("split_factor > 0").select("company", "date", F.floor("close").cast("long").alias("shares"))
    return market.shares_as_of(s, _ref_dates(spark, sf)).withColumnRenamed("at", "at_date")


def _two_sources(spark, sf):
    """Counts of two sources; company % 3 = 1 has pairs just inside and outside the tolerance."""
    p = S.prices(spark, sf)
    k = F.datediff("date", F.lit("1995-01-01").cast("date"))
    m = F.floor(F.col("close") * 100).cast("long")
    o = (
        F.when(k % 17 == 0, None).when(F.col("company") % 3 == 0, F.floor(m / 1000).cast("long")).when(k % 5 == 0, F.floor(m * 1.2).cast("long"))
        .when((F.col("company") % 3 == 1) & (k % 4 == 0), F.floor(m * 0.952).cast("long")).when((F.col("company") % 3 == 1) & (k % 4 == 1), F.floor(m * 1.0515).cast("long")).otherwise(m)
    )
    return p.select("company", "date", F.when(k % 11 == 0, None).otherwise(m).alias("market"), o.alias("official"))


_TWO = f"""WITH {S.PRICES}, b AS (SELECT company, date, date_diff('day', DATE '1995-01-01', date) k, CAST(floor(close * 100) AS BIGINT) m FROM prices), t AS (SELECT company, date, CASE WHEN k % 11 = 0 THEN NULL ELSE m END AS market,
CASE WHEN k % 17 = 0 THEN NULL WHEN company % 3 = 0 THEN CAST(floor(m / 1000) AS BIGINT) WHEN k % 5 = 0 THEN CAST(floor(m * CAST(1.2 AS DOUBLE)) AS BIGINT) WHEN company % 3 = 1 AND k % 4 = 0 THEN CAST(floor(m * CAST(0.952 AS DOUBLE)) AS BIGINT) WHEN company % 3 = 1 AND k % 4 = 1 THEN CAST(floor(m * CAST(1.0515 AS DOUBLE)) AS BIGINT) ELSE m END AS official FROM b),
g AS (SELECT *, CASE WHEN market > 0 AND official > 0 THEN abs(market - CAST(official AS DOUBLE)) / official END g1, CASE WHEN market > 0 AND official > 0 THEN abs(market - CAST(official * 1000 AS DOUBLE)) / (official * 1000) END g2 FROM t), s AS (SELECT *, least(g1, g2) AS gap, CASE WHEN least(g1, g2) <= 0.05 THEN CASE WHEN g1 <= g2 THEN 1 ELSE 1000 END END AS scale FROM g),
v AS (SELECT *, CASE WHEN min(scale) OVER (PARTITION BY company) = max(scale) OVER (PARTITION BY company) THEN min(scale) OVER (PARTITION BY company) END AS proven FROM s)"""
_VALIDATED = """st AS (SELECT *, CASE WHEN market > 0 AND official > 0 THEN CASE WHEN gap <= 0.05 THEN 'validated' ELSE 'shares_discrepancy' END WHEN market > 0 THEN 'yahoo_only' WHEN official > 0 AND proven IS NOT NULL THEN 'cvm_fallback_validated_scale' WHEN official > 0 THEN 'cvm_scale_ambiguous' ELSE 'missing' END AS status FROM v),
sq AS (SELECT *, CASE WHEN status IN ('validated', 'yahoo_only') THEN market WHEN status = 'cvm_fallback_validated_scale' THEN official * proven END AS quantity FROM st)"""


@query("f04_share_scale", f"{_TWO} SELECT company, date, scale, proven FROM v")
def f04(spark, sf):
    return market.infer_share_scale(_two_sources(spark, sf)).select("company", "date", "scale", "proven")


@query("f05_validate_shares", f"""{_TWO}, {_VALIDATED} SELECT company, date, status, quantity, CASE WHEN status IN ('validated', 'yahoo_only') THEN 'market' WHEN status = 'cvm_fallback_validated_scale' THEN 'filed' END AS quantity_source, round(gap * 100, 6) AS difference_pct FROM sq""")
def f05(spark, sf):
    return market.validate_shares(market.infer_share_scale(_two_sources(spark, sf))).select("company", "date", "status", "quantity", "quantity_source", "difference_pct")


@query("f06_class_market_cap", """WITH c AS (SELECT CAST(c_nationkey AS INTEGER) company, c_mktsegment seg, CASE WHEN c_custkey % 301 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS price, c_custkey AS quantity, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS weight FROM customer)
SELECT company, seg, CAST(CASE WHEN count(*) FILTER (price IS NULL) = 0 THEN sum(price * quantity * weight) END AS DOUBLE) AS market_cap, count(*) FILTER (price IS NULL) AS invalid FROM c GROUP BY 1, 2""")
def f06(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").cast("int").alias("company"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_custkey") % 301 == 0, None).otherwise(F.col("c_acctbal").cast("decimal(18,2)")).alias("price"), F.col("c_custkey").alias("quantity"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(2).alias("weight"))
    return market.class_market_cap(c, ["company", "seg"]).withColumn("market_cap", F.col("market_cap").cast("double"))


@query("f08_alias_series", f"""WITH {S.PRICES}, a AS (SELECT company, date, 'NEW' AS symbol, 0 AS priority, CASE WHEN day(date) % 3 = 0 THEN 0 ELSE adj_close END AS adj_close FROM prices UNION ALL SELECT company, date, 'OLD', 1, adj_close * 2 FROM prices WHERE day(date) % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY company, date ORDER BY priority) k FROM a WHERE adj_close > 0) SELECT company, date, symbol, adj_close FROM r WHERE k = 1""")
def f08(spark, sf):
    p = S.prices(spark, sf)
    new = p.select("company", "date", F.lit("NEW").alias("symbol"), F.lit(0).alias("priority"), F.when(F.dayofmonth("date") % 3 == 0, 0.0).otherwise(F.col("adj_close")).alias("adj_close"))
    old = p.filter(F.dayofmonth("date") % 2 == 0).select("company", "date", F.lit("OLD").alias("symbol"), F.lit(1).alias("priority"), (F.col("adj_close") * 2).alias("adj_close"))
    return market.merge_alias_series(new.unionByName(old)).select("company", "date", "symbol", "adj_close")


@query("f09_price_variation", f"""WITH {S.PRICES}, l AS (SELECT company, max(date) last_date, max_by(adj_close, date) lp FROM prices GROUP BY 1), s AS (SELECT *, last_date - horizon AS at_date FROM l, (SELECT unnest([30, 90, 360]) AS horizon)) SELECT s.company, CAST(horizon AS INTEGER) AS horizon, last_date, date AS base_date, round((lp / adj_close - 1) * 100, 6) AS change_pct FROM s ASOF LEFT JOIN prices p ON s.company = p.company AND s.at_date >= p.date""")
def f09(spark, sf):
    return market.price_variation(S.prices(spark, sf)).withColumn("change_pct", F.round("change_pct", 6))


_SECTOR_CAPS = f"WITH {S.MARKET_CAPS}, {S.REGISTRY}, c AS (SELECT *, {S.VALID_CAP} AS ok FROM market_caps JOIN registry USING (company))"


def _sector_caps(spark, sf):
    return S.market_caps(spark, sf).join(S.registry(spark, sf), "company")


@query("f11_market_cap_share", f"""{_SECTOR_CAPS}, d AS (SELECT DISTINCT sector, ref_date FROM c), sp AS (SELECT d.sector, d.ref_date, company FROM d JOIN registry USING (sector)), j AS (SELECT sp.*, market_cap, status, status_market_cap, coalesce(ok, false) AS ok FROM sp LEFT JOIN c USING (sector, ref_date, company))
SELECT sector, ref_date, company, CASE WHEN ok THEN round(market_cap / sum(CASE WHEN ok THEN market_cap END) OVER w * 100, 6) END AS share_pct, CASE WHEN NOT ok THEN CASE WHEN market_cap IS NULL THEN 'missing' WHEN market_cap <= 0 THEN 'not_positive' WHEN lower(trim(status)) IN ({S._STOP}) THEN lower(trim(status)) ELSE lower(trim(status_market_cap)) END END AS reason,
round((count(*) FILTER (ok) OVER w) / count(*) OVER w, 6) AS coverage FROM j WINDOW w AS (PARTITION BY sector, ref_date)""")
def f11(spark, sf):
    caps = _sector_caps(spark, sf).drop("name")
    return market.market_cap_share(caps, S.registry(spark, sf)).select("sector", "ref_date", "company", F.round("share_pct", 6).alias("share_pct"), "reason", F.round("coverage", 6).alias("coverage"))


@query("f12_sector_ev_ebitda", f"""{_EV}, {_LTM}, {S.REGISTRY}, l AS (SELECT company, last_day(make_date(year, q * 3, 1)) ref_date, ebitda_ltm FROM ltm), j AS (SELECT sector, company, ref_date, ev, ebitda_ltm FROM ev FULL JOIN l USING (company, ref_date) JOIN registry USING (company)),
g AS (SELECT sector, ref_date, sum(ev) FILTER (ebitda_ltm IS NOT NULL) e, sum(ebitda_ltm) FILTER (ev IS NOT NULL) b, count(*) FILTER (ev IS NOT NULL AND ebitda_ltm IS NOT NULL) AS included, count(*) FILTER (ev IS NULL OR ebitda_ltm IS NULL) AS excluded,
  string_agg(company || ':' || CASE WHEN ev IS NULL THEN 'missing_enterprise_value' ELSE 'missing_ebitda_ltm' END, ',' ORDER BY company) FILTER (ev IS NULL OR ebitda_ltm IS NULL) AS reasons FROM j GROUP BY 1, 2)
SELECT sector, ref_date, included, excluded, coalesce(reasons, '') AS reasons, CASE WHEN b > 0 THEN round(e / b, 6) END AS ev_ebitda, CASE WHEN included = 0 THEN 'no_valid_company' WHEN b <= 0 THEN 'non_positive_ebitda' END AS diagnostics FROM g""")
def f12(spark, sf):
    j = _ev(spark, sf).join(_ebitda(spark, sf), ["company", "ref_date"], "full").join(S.registry(spark, sf), "company")
    reasons = F.array_join(F.transform("excluded_reasons", lambda r: F.concat_ws(":", r["company"].cast("string"), r["reason"])), ",")
    return market.sector_ev_ebitda(j).select("sector", "ref_date", "included", "excluded", reasons.alias("reasons"), F.round("ev_ebitda", 6).alias("ev_ebitda"), "diagnostics")


_RETURNS = f"""WITH {S.MARKET_CAPS}, {S.PRICES}, {S.REGISTRY}, d AS (SELECT DISTINCT last_day(make_date(year, q * 3, 1)) ref_date FROM quarter_facts),
sp AS (SELECT sector, company, ref_date, horizon, ref_date - horizon AS start FROM d CROSS JOIN registry CROSS JOIN (SELECT unnest([30, 90, 360]) AS horizon)),
caps AS (SELECT company, ref_date cap_date, market_cap FROM market_caps WHERE {S.VALID_CAP}),
a AS (SELECT sp.*, cap_date, CASE WHEN date_diff('day', cap_date, start) <= 120 THEN market_cap END AS cap FROM sp ASOF LEFT JOIN caps ON sp.company = caps.company AND sp.start >= caps.cap_date),
b AS (SELECT a.*, p.date AS d0, CASE WHEN date_diff('day', p.date, start) <= 7 THEN adj_close END AS p0 FROM a ASOF LEFT JOIN prices p ON a.company = p.company AND a.start >= p.date),
c AS (SELECT b.*, p.date AS d1, CASE WHEN date_diff('day', p.date, ref_date) <= 7 THEN adj_close END AS p1 FROM b ASOF LEFT JOIN prices p ON b.company = p.company AND b.ref_date >= p.date),
r AS (SELECT *, CASE WHEN cap IS NOT NULL THEN p1 / p0 - 1 END AS r FROM c),
g AS (SELECT sector, ref_date, horizon, count(*) registered, count(r) included, sum(CASE WHEN r IS NOT NULL THEN cap END) used, sum(cap) alls, count(*) - count(cap) unknown, sum(cap * r) wr, max(cap) FILTER (r IS NOT NULL) top, max_by(company, cap) FILTER (r IS NOT NULL) top_company,
  coalesce(string_agg(company || ':' || CASE WHEN cap IS NULL THEN 'no_valid_market_cap' ELSE 'no_recent_price' END, ',' ORDER BY company) FILTER (r IS NULL), '') AS excluded, max(date_diff('day', d0, start)) FILTER (r IS NOT NULL) AS start_gap, max(date_diff('day', d1, ref_date)) FILTER (r IS NOT NULL) AS end_gap, max(date_diff('day', cap_date, start)) FILTER (r IS NOT NULL) AS cap_gap FROM r GROUP BY 1, 2, 3),
h AS (SELECT *, included / registered AS cc, CASE WHEN unknown = 0 THEN used / alls END AS vc FROM g)"""


def _returns(spark, sf):
    dates = S.quarter_facts(spark, sf).select(F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))).alias("ref_date")).distinct()
    reg = S.registry(spark, sf)
    return market.sector_returns(S.market_caps(spark, sf), S.prices(spark, sf), reg, reg.select("sector").distinct().join(dates, how="cross"))


@query("f13_sector_returns", f"{_RETURNS} SELECT sector, ref_date, CAST(horizon AS INTEGER) AS horizon, registered, included, round(vc, 6) AS value_coverage, CASE WHEN cc >= 0.7 AND (vc IS NULL OR vc >= 0.7) THEN round(wr / used, 6) END AS weighted_return, excluded FROM h")
def f13(spark, sf):
    excluded = F.array_join(F.transform("excluded", lambda r: F.concat_ws(":", r["company"].cast("string"), r["reason"])), ",")
    return _returns(spark, sf).select("sector", "ref_date", "horizon", "registered", "included", F.round("value_coverage", 6).alias("value_coverage"), F.round("weighted_return", 6).alias("weighted_return"), excluded.alias("excluded"))


@query("f14_return_diagnostics", f"""{_RETURNS}, k AS (SELECT *, lag(nullif(used, 0) IGNORE NULLS) OVER (PARTITION BY sector, horizon ORDER BY ref_date) AS prev FROM h), z AS (SELECT *, CASE WHEN used IS NOT NULL AND prev IS NOT NULL THEN greatest(used, prev) / nullif(least(used, prev), 0) END AS ratio FROM k)
SELECT sector, ref_date, CAST(horizon AS INTEGER) AS horizon, round(top / used, 6) AS top_weight, top_company, round(ratio, 6) AS cap_change, CAST(start_gap AS INTEGER) AS start_gap_days, CAST(end_gap AS INTEGER) AS end_gap_days, CAST(cap_gap AS INTEGER) AS cap_gap_days,
concat_ws(',', CASE WHEN cc < 0.7 THEN 'low_count_coverage' END, CASE WHEN unknown > 0 THEN 'unknown_value_coverage' END, CASE WHEN vc < 0.7 THEN 'low_value_coverage' END, CASE WHEN top / used > 0.8 THEN 'concentrated' END, CASE WHEN ratio >= 10 THEN 'cap_change_10x' END) AS messages FROM z""")
def f14(spark, sf):
    d = market.return_diagnostics(_returns(spark, sf))
    return d.select("sector", "ref_date", "horizon", F.round("top_weight", 6).alias("top_weight"), "top_company", F.round("cap_change", 6).alias("cap_change"), "start_gap_days", "end_gap_days", "cap_gap_days", F.array_join("messages", ",").alias("messages"))


@query("f16_top_k", f"{_SECTOR_CAPS}, r AS (SELECT sector, ref_date, company, round(market_cap, 4) AS market_cap, CAST(row_number() OVER (PARTITION BY sector, ref_date ORDER BY market_cap DESC, company) AS INTEGER) AS rank FROM c WHERE ok) SELECT * FROM r WHERE rank <= 5")
def f16(spark, sf):
    return market.top_k(_sector_caps(spark, sf)).select("sector", "ref_date", "company", F.round("market_cap", 4).alias("market_cap"), "rank")
