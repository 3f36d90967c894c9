"""Further registered queries, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundamentals_spark.functions import text as T
from fundamentals_spark.operators import accounts, evidence, filings, governance, indicators, market
from fundamentals_spark.plans import standins as S
from fundamentals_spark.plans.queries_core import _DEBT, _TWO, _VALIDATED, _two_sources
from fundamentals_spark.sources import files, records

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


@query("a04_prices", f"WITH {S.PRICES} SELECT company, date, close, CASE WHEN day(date) % 4 = 0 THEN close ELSE adj_close END AS adj_close, split_factor FROM prices WHERE day(date) % 9 <> 0")
def a04(spark, sf):
    d = F.dayofmonth("date")
    raw = S.prices(spark, sf).select(F.col("company").alias("symbol"), "date", F.when(d % 9 != 0, F.col("close")).alias("close"), F.when(d % 4 != 0, F.col("adj_close")).alias("adj_close"), F.when(F.col("split_factor") > 0, F.col("split_factor")).alias("split_factor"))
    return files.read_prices(raw).withColumnRenamed("symbol", "company")


# one document of JSON for each text: a flat list, groups by period around the text, a company with rows, or no JSON
@query("a05_records", """WITH d AS (SELECT doc_id, doc_id % 4 AS shape, coalesce(lang, '-') AS l, coalesce(source, '-') AS s, coalesce(n_chars, 0) AS n FROM documents)
SELECT doc_id, CAST(NULL AS VARCHAR) AS ticker, '1.' || l AS code, s AS description, '2024' AS period, CAST(n AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS error FROM d WHERE shape = 0
UNION ALL SELECT doc_id, NULL, '2', NULL, NULL, -1234.5, 'no_period' FROM d WHERE shape = 0
UNION ALL SELECT doc_id, NULL, '1', NULL, '2023', CAST(n AS DOUBLE), NULL FROM d WHERE shape = 1
UNION ALL SELECT doc_id, NULL, NULL, s, '2024', n + 0.5, NULL FROM d WHERE shape = 1
UNION ALL SELECT doc_id, 'T' || CAST(doc_id % 7 AS VARCHAR), '1.' || l, s, p, CAST(n AS DOUBLE) * f, NULL FROM d, (VALUES ('2024', 1), ('2026', 2)) AS v(p, f) WHERE shape = 2
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, 'not_json' FROM d WHERE shape = 3""")
def a05_records(spark, sf):
    lang, source, n = "coalesce(lang, '-')", "coalesce(source, '-')", "coalesce(n_chars, 0)"
    flat = f"""concat('[{{"codigo":"1.', {lang}, '","descricao":"', {source}, '","periodo":"2024","valor":', {n}, '}},{{"conta":"2","valor":"(1.234,5)"}}]')"""
    grouped = f"""concat('{{"meta":', to_json(struct(text)), ',"periodos":[{{"data":"2023","contas":[{{"CD_CONTA":"1","VL_CONTA":', {n}, '}}]}},{{"data":"2024","x":{{"y":{{"ds_conta":"', {source}, '","vl_conta":"', {n}, ',5"}}}}}}]}}')"""
    nested = f"""concat('{{"companies":{{"T', doc_id % 7, '":{{"scope":"con","rows":[{{"code":"1.', {lang}, '","description":"', {source}, '","values":{{"2024":', {n}, ',"2025":null,"2026":', 2 * {n}, '}}}}]}}}}}}')"""
    docs = read(spark, sf, "documents").selectExpr("doc_id", f"""case doc_id % 4 when 0 then {flat} when 1 then {grouped} when 2 then {nested} else '{{"codigo":' end as json""")
    return records.flatten_json_records(docs, "json", ["doc_id"]).select("doc_id", "ticker", "code", "description", "period", "value", "error")


@query("a08_content_type", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN regexp_matches(lower(html), '^\\s*(<!doctype html|<html)') THEN 'html' ELSE 'unknown' END AS kind FROM pages""")
def a08(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", files.sniff_content_type(F.encode(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).otherwise(F.col("html")), "UTF-8")).alias("kind"))


@query("a09_markdown_cells", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), t AS (SELECT doc_id, n, '| ' || n || ' | ' || md5(line) || ' |' AS line FROM l WHERE n % 4 <> 0), g AS (SELECT doc_id, n, line, CAST(floor(n / 4) AS INTEGER) + 1 AS table_no FROM t)
SELECT doc_id, table_no, CAST(row_number() OVER (PARTITION BY doc_id, table_no ORDER BY n) AS INTEGER) AS row, CAST(n AS VARCHAR) AS first_cell FROM g""")
def a09(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 4 == 0, F.lit("text")).otherwise(F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), F.md5(x), F.lit(" |"))))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.array_join(lines, "\n").alias("text"))
    return files.markdown_cells(docs).filter("col = 0").select(F.col("doc").alias("doc_id"), "table_no", "row", F.col("text").alias("first_cell"))


@query("b05_scale", f"""WITH {S.FILINGS}, t AS (SELECT ordinal, company, value, ref_date, CASE ordinal % 4 WHEN 0 THEN 'MIL' WHEN 1 THEN 'UNIDADE' WHEN 2 THEN 'MILHÃO' ELSE 'DUZIA' END AS scale FROM filings)
SELECT ordinal, CAST(value AS DOUBLE) AS value, CASE WHEN scale = 'DUZIA' THEN 'unknown_scale' WHEN company = 3 AND scale = 'MIL' AND ref_date > DATE '1998-12-31' THEN 'scale_override_expired' END AS error,
CASE WHEN scale = 'DUZIA' OR (company = 3 AND scale = 'MIL' AND ref_date > DATE '1998-12-31') THEN NULL ELSE CAST(value AS DOUBLE) * CASE scale WHEN 'MIL' THEN 1000 WHEN 'UNIDADE' THEN 1 ELSE 1000000 END * CASE WHEN company = 3 AND scale = 'MIL' AND ref_date >= DATE '1997-01-01' THEN 10 ELSE 1 END END AS scaled FROM t""")
def b05(spark, sf):
    k = F.col("ordinal") % 4
    f = S.filings(spark, sf).select("ordinal", "company", F.col("value").cast("double").alias("value"), "ref_date", F.when(k == 0, "MIL").when(k == 1, "UNIDADE").when(k == 2, "MILHÃO").otherwise("DUZIA").alias("scale"))
    o = spark.sql("select 3 as company, 'MIL' as scale, date'1997-01-01' as start, date'1998-12-31' as end, 10 as factor")
    return filings.apply_scale(f, o).select("ordinal", "value", "error", "scaled")


@query("b10_doc_names", """SELECT o_orderkey, upper(substr(o_orderpriority, 1, 1)) || 'BCD' || (o_orderkey % 10) AS ticker, quarter(o_orderdate) || 'T' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS period, CASE WHEN o_orderkey % 2 = 0 THEN 'RELEASE_RESULTADOS' ELSE 'ITR' END AS type FROM orders WHERE regexp_matches(upper(substr(o_orderpriority, 1, 1)), '[A-Z]')
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE NOT regexp_matches(upper(substr(o_orderpriority, 1, 1)), '[A-Z]')""")
def b10(spark, sf):
    name = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("bcd"), (F.col("o_orderkey") % 10).cast("string"), F.lit("_"), T.quarter_label(F.to_date("o_orderdate")), F.lit("_"), F.when(F.col("o_orderkey") % 2 == 0, "release_resultados").otherwise("itr"), F.lit(".pdf"))
    return read(spark, sf, "orders").select("o_orderkey", T.parse_doc_name(name).alias("n")).select("o_orderkey", "n.ticker", "n.period", "n.type")


_TITLES = (
    "Vídeo do release de resultados", "Release de resultados e apresentação de resultados", "Apresentação de resultados", "DFP anual", "Transcrição da teleconferência", "Planilha de fundamentos", "Prévia operacional (Excel)",
    "Webcast ao vivo", "Webcast", "Informações trimestrais", "Relatório de resultados", "Calendário de eventos", "Operational preview", "Earnings presentation", "Outros",
)
_KINDS = (None, "RELEASE_RESULTADOS", "APRESENTACAO_RESULTADOS", "DEMONSTRACOES_FINANCEIRAS", "TRANSCRICAO_WEBCAST", "PLANILHA_RESULTADOS", "PLANILHA_RESULTADOS", None, None, "DEMONSTRACOES_FINANCEIRAS", "RELEASE_RESULTADOS", None, "PREVIA_OPERACIONAL", "APRESENTACAO_RESULTADOS", None)


# the path of the page's address stands before the title, so that the terms are found inside a longer text
@query("b11_document_type", """SELECT page_id, CASE WHEN regexp_matches(lower(url), 'audio|video|calendar') THEN NULL WHEN regexp_matches(lower(url), 'xlsx|excel|spreadsheet|itr|dfp|transcript') THEN '?' ELSE ([""" + ", ".join("NULL" if k is None else f"'{k}'" for k in _KINDS) + """])[CAST(length(html) % 15 AS INTEGER) + 1] END AS type FROM pages""")
def b11(spark, sf):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.length("html") % 15 + 1).cast("int"))
    return read(spark, sf, "pages").select("page_id", T.classify_document(F.concat_ws(" ", "url", title)).alias("type"))


@query("c01_identity", """WITH r AS (SELECT c_custkey AS company, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, 'N' || c_custkey AS cnpj FROM customer WHERE c_custkey % 10 <> 9), f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS code, 'N' || CASE WHEN o_orderkey % 25 = 1 THEN o_custkey + 1 ELSE o_custkey END AS cnpj FROM orders),
j AS (SELECT f.*, a.company ca, b.company cb FROM f LEFT JOIN r a USING (code) LEFT JOIN r b ON f.cnpj = b.cnpj), k AS (SELECT *, (ca IS NOT NULL AND cb IS NOT NULL AND ca <> cb) OR (code IS NOT NULL AND ca IS NULL AND cb IS NOT NULL) AS bad FROM j)
SELECT o_orderkey, CASE WHEN NOT bad THEN coalesce(ca, cb) END AS company, CASE WHEN NOT bad AND ca IS NOT NULL THEN 'cd_cvm' WHEN NOT bad AND cb IS NOT NULL THEN 'cnpj_fallback' END AS match, CASE WHEN bad THEN 'identity_conflict' WHEN ca IS NULL AND cb IS NULL THEN 'not_registered' END AS error FROM k""")
def c01(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    reg = read(spark, sf, "customer").filter("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("company"), code("c_custkey").alias("cvm_code"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("cnpj"))
    o = read(spark, sf, "orders")
    f = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, code("o_custkey")).alias("cvm_code"), F.concat(F.lit("N"), F.when(F.col("o_orderkey") % 25 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")).alias("cnpj"))
    return filings.resolve_issuer(f, reg).select("o_orderkey", "company", "match", "error")


# companies with a clean identity, without codes, with foreign identities, with mixed ones, and without filings
@query("c01_companies", """WITH r AS (SELECT c_custkey AS company, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, 'N' || c_custkey AS cnpj FROM customer), f AS (SELECT CASE WHEN o_custkey % 4 = 1 OR o_orderkey % 90 = 0 THEN NULL ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS code, 'N' || CASE WHEN o_custkey % 7 = 3 AND o_orderkey % 3 = 1 THEN o_custkey + 1 ELSE o_custkey END AS cnpj FROM orders WHERE o_custkey % 10 <> 9),
j AS (SELECT r.company, f.code, f.cnpj, coalesce(f.code = r.code, false) AS a, f.cnpj = r.cnpj AS b FROM r JOIN f ON f.code = r.code OR f.cnpj = r.cnpj),
s AS (SELECT company, count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER ((a AND NOT b) OR (b AND NOT a AND code IS NOT NULL)) AS x, count(DISTINCT coalesce(code, '') || '|' || cnpj) AS p FROM j GROUP BY 1),
e AS (SELECT r.company, coalesce(n, 0) AS rows, na, CASE WHEN n IS NULL THEN 'company_not_found' WHEN na > 0 AND nb > 0 AND x > 0 THEN 'identity_conflict' WHEN p > 1 THEN 'mixed_identities' END AS error FROM r LEFT JOIN s USING (company))
SELECT company, rows, CASE WHEN error IS NULL THEN CASE WHEN na > 0 THEN 'cd_cvm' ELSE 'cnpj_fallback' END END AS match, error, CASE WHEN error IS NULL THEN rows ELSE 0 END AS kept FROM e""")
def c01_companies(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    reg = read(spark, sf, "customer").select(F.col("c_custkey").alias("company"), code("c_custkey").alias("cvm_code"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("cnpj"))
    o = read(spark, sf, "orders").filter("o_custkey % 10 <> 9")  # the others have no filings
    foreign = (F.col("o_custkey") % 7 == 3) & (F.col("o_orderkey") % 3 == 1)
    f = o.select(F.when(~((F.col("o_custkey") % 4 == 1) | (F.col("o_orderkey") % 90 == 0)), code("o_custkey")).alias("cvm_code"), F.concat(F.lit("N"), F.when(foreign, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string")).alias("cnpj"))
    rows, report = filings.resolve_companies(f, reg)
    return report.join(rows.groupBy("company").agg(F.count(F.lit(1)).alias("kept")), "company", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


@query("c02_scope", f"""WITH {S.FILINGS}, t AS (SELECT ordinal, company, ref_date, value, ordinal % 5 = 0 AND company % 2 = 0 AS c FROM filings), w AS (SELECT *, bool_or(c) OVER (PARTITION BY company, ref_date) a FROM t) SELECT ordinal, CAST(value AS DOUBLE) AS value FROM w WHERE c OR NOT a""")
def c02(spark, sf):
    f = S.filings(spark, sf).withColumn("scope", F.when((F.col("ordinal") % 5 == 0) & (F.col("company") % 2 == 0), "DF Consolidado").otherwise("DF Individual"))
    return filings.select_scope(f).select("ordinal", F.col("value").cast("double").alias("value"))


@query("c08_quarter_spine", f"WITH {S.REGISTRY}, s AS (SELECT company, unnest(generate_series(DATE '2015-03-01', DATE '2019-12-01', INTERVAL 3 MONTH)) d FROM registry) SELECT company, last_day(CAST(d AS DATE)) AS ref_date FROM s")
def c08(spark, sf):
    return filings.quarter_spine(S.registry(spark, sf).select("company"), F.lit("2015-01-01").cast("date"), F.lit("2020-01-31").cast("date")).select("company", "ref_date")


@query("c09_account_keys", f"WITH {S.FILINGS} SELECT DISTINCT code || '|' || CASE WHEN version % 2 = 0 THEN 'FIXED' ELSE lower(description) END AS account_key FROM filings")
def c09(spark, sf):
    f = S.filings(spark, sf)
    return f.select(filings.account_key(F.col("code"), F.col("description"), F.when(F.col("version") % 2 == 0, "S").otherwise("N")).alias("account_key")).distinct()


@query("c10_legacy_tickers", f"WITH {S.OBSERVATIONS} SELECT ordinal, CASE ticker WHEN 'T39' THEN 'NEW39' ELSE ticker END AS ticker FROM observations")
def c10(spark, sf):
    a = spark.createDataFrame([("T39", "NEW39"), ("T38", "T37")], "legacy string, ticker string")
    return filings.canonicalize_ticker(S.observations(spark, sf), a).select("ordinal", "ticker")


# three rows a key: the filed one, one of a later reference year that must lose, and a later restatement that must win
@query("d09_pick_periods", f"""WITH {S.MIXED}, f AS (SELECT *, last_day(make_date(year, q * 3, 1)) AS e FROM mixed_facts), p AS (SELECT company, year, q, is_ytd, revenue, e AS ref_date, true AS same FROM f UNION ALL SELECT company, year, q, is_ytd, revenue + 1, e + 365, false FROM f WHERE company % 3 = 0 UNION ALL SELECT company, year, q, is_ytd, revenue + 2, e + 10, true FROM f WHERE company % 4 = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY same DESC, ref_date DESC) k FROM p WHERE q = 4 AND is_ytd), b AS (SELECT *, row_number() OVER (PARTITION BY company, year, q ORDER BY same DESC, is_ytd AND q = 4 DESC, ref_date DESC) k FROM p WHERE NOT is_ytd OR q = 1)
SELECT 'annual' AS view, company, year, q, CAST(revenue AS DOUBLE) AS revenue FROM a WHERE k = 1 UNION ALL SELECT 'quarterly', company, year, q, CAST(revenue AS DOUBLE) FROM b WHERE k = 1""")
def d09(spark, sf):
    f = S.mixed_facts(spark, sf).withColumns({"end_date": F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))), "ordinal": F.col("q")})
    money = lambda n: (F.col("revenue") + n).cast("decimal(38,4)")
    filed = f.withColumns({"ref_date": F.col("end_date"), "same_reference_year": F.lit(True), "revenue": money(0)})
    other = f.filter("company % 3 = 0").withColumns({"ref_date": F.date_add("end_date", 365), "same_reference_year": F.lit(False), "revenue": money(1)})
    later = f.filter("company % 4 = 1").withColumns({"ref_date": F.date_add("end_date", 10), "same_reference_year": F.lit(True), "revenue": money(2)})
    rows = filed.unionByName(other).unionByName(later)
    views = [accounts.pick_periods(rows, v, ["company"]).select(F.lit(v).alias("view"), "company", "year", "q", F.col("revenue").cast("double").alias("revenue")) for v in ("annual", "quarterly")]
    return views[0].unionByName(views[1])


@query("e03_depreciation", f"""WITH {S.YTD}, d AS (SELECT company, year, q, is_ytd, revenue v FROM ytd_facts WHERE company % 2 = 0 OR q <> 2), i AS (SELECT company, year, q, v FROM d WHERE NOT is_ytd), y AS (SELECT company, year, q, v FROM d WHERE is_ytd)
SELECT p.company, p.year, p.q, CAST(coalesce(i.v, abs(y.v - coalesce(b.v, 0))) AS DOUBLE) AS da, CASE WHEN i.v IS NOT NULL THEN 'isolated' WHEN y.v IS NOT NULL THEN 'ytd_difference' ELSE 'missing' END AS source
FROM quarter_facts p LEFT JOIN i ON p.company = i.company AND p.year = i.year AND p.q = i.q LEFT JOIN y ON p.company = y.company AND p.year = y.year AND p.q = y.q LEFT JOIN d b ON p.company = b.company AND p.year = b.year AND p.q = b.q + 1""")
def e03(spark, sf):
    y = S.ytd_facts(spark, sf).filter("company % 2 = 0 or q <> 2").select("company", "year", "q", "is_ytd", F.lit(False).alias("synthetic"), (-F.col("revenue")).cast("decimal(38,4)").alias("value"))
    return indicators.depreciation(y, S.quarter_facts(spark, sf).select("company", "year", "q")).withColumn("da", F.col("da").cast("double"))


@query("e05_account_value", f"WITH {S.FILINGS}, g AS (SELECT company, ref_date, version, count(*) FILTER (code = '1.01.01') n, max(value) FILTER (code = '1.01.01') v FROM filings GROUP BY 1, 2, 3) SELECT company, ref_date, version, CASE WHEN n = 1 THEN CAST(v AS DOUBLE) END AS value, CASE WHEN n > 1 THEN 'duplicate_account' WHEN n = 0 THEN 'missing_account' END AS error FROM g")
def e05(spark, sf):
    return indicators.account_value(S.filings(spark, sf), "1.01.01", ["company", "ref_date", "version"], True).withColumn("value", F.col("value").cast("double"))


@query("e14_match_accounts", f"""WITH {S.BALANCES}, m AS (SELECT company, ref_date, code, value, code = '2.01.04' AS exact FROM balances WHERE code = '2.01.04' OR description LIKE '%Arrendamento%'), w AS (SELECT *, bool_or(exact) OVER (PARTITION BY company, ref_date) h FROM m) SELECT company, ref_date, code, CAST(value AS DOUBLE) AS value FROM w WHERE exact OR NOT h""")
def e14(spark, sf):
    rules = spark.createDataFrame([("debt", ["2.01.04"], "arrendamento", "ativo")], "kind string, codes array<string>, pattern string, excluded string")
    return indicators.match_accounts(S.balances(spark, sf), rules, ["company", "ref_date"]).select("company", "ref_date", "code", F.col("value").cast("double").alias("value"))


@query("e19_deduction_ratio", f"WITH {S.OBSERVATIONS}, g AS (SELECT ticker, year, q, max(value) FILTER (metric = 'error') a, max(value) FILTER (metric = 'view') b FROM observations GROUP BY 1, 2, 3) SELECT ticker, year, q, round(CAST(a AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) * 100, 6) AS ratio FROM g")
def e19(spark, sf):
    m = F.when(F.col("metric") == "error", "disallowance").when(F.col("metric") == "view", "gross_revenue")
    return indicators.deduction_ratio(S.observations(spark, sf).withColumn("metric", m)).withColumn("ratio", F.round("ratio", 6))


@query("e20_company_summary", f"""WITH {S.BALANCES}, {_DEBT}, {S.MARKET_CAPS.replace(S._SALES + ', ', '')}, {S.REGISTRY}, n AS (SELECT company, max_by(net_debt, ref_date) net_debt FROM net WHERE error IS NULL AND net_debt IS NOT NULL GROUP BY 1), y AS (SELECT company, max_by(e, year) e FROM (SELECT company, year, CAST(sum(ebit + da) AS DOUBLE) e FROM quarter_facts GROUP BY 1, 2) GROUP BY 1), c AS (SELECT company, max_by(market_cap, ref_date) m FROM market_caps WHERE market_cap IS NOT NULL GROUP BY 1)
SELECT r.company, net_debt, round((m + net_debt) / nullif(e, 0), 6) AS ev_ebitda_last_annual FROM registry r LEFT JOIN n USING (company) LEFT JOIN y USING (company) LEFT JOIN c USING (company)""")
def e20(spark, sf):
    b = S.balances(spark, sf)
    annual = indicators.margins(S.quarter_facts(spark, sf)).groupBy("company", "year").agg(F.sum("ebitda").alias("ebitda"))
    out = indicators.company_summary(S.registry(spark, sf), indicators.net_debt(b, include_leases=True), indicators.working_capital(b), annual, S.market_caps(spark, sf))
    return out.select("company", "net_debt", F.round("ev_ebitda_last_annual", 6).alias("ev_ebitda_last_annual"))


@query("f07_historic_market_cap", f"""{_TWO}, {_VALIDATED}, p AS (SELECT *, coalesce(product(CASE WHEN split_factor > 0 THEN split_factor ELSE 1 END) OVER (PARTITION BY company ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) fut FROM prices)
SELECT sq.company, sq.date, round(round(close * fut, 6) * quantity / 1e6, 3) AS market_cap_millions FROM sq JOIN p ON sq.company = p.company AND sq.date = p.date""")
def f07(spark, sf):
    s = _two_sources(spark, sf).withColumnRenamed("date", "at")
    return market.historic_market_cap(S.prices(spark, sf), s).select("company", F.col("at").alias("date"), F.round(F.col("market_cap") / 1e6, 3).alias("market_cap_millions"))


# two classes for even companies; the second one's quantity is what the last shares leave, times a company's factor, and lacks for company 6
@query("f10_current_market_cap", f"""WITH {S.PRICES}, p AS (SELECT company, max_by(close, date) price, max_by(CAST(floor(close) AS BIGINT) * 3, date) sh FROM prices GROUP BY 1),
c AS (SELECT company, sh AS quantity, 1.0 AS weight, price AS cp FROM p WHERE company % 2 = 0 UNION ALL SELECT company, CASE WHEN company <> 6 THEN CAST(floor(sh * (company % 5) / 100) AS BIGINT) END, 2.0, price / 2 FROM p WHERE company % 2 = 0),
g AS (SELECT company, CAST(sum(quantity * weight) AS DOUBLE) eq, CAST(sum(quantity * weight * cp) AS DOUBLE) v, count(*) FILTER (quantity IS NULL) bad FROM c GROUP BY 1)
SELECT p.company, CASE WHEN eq IS NULL THEN round(price * sh, 2) WHEN bad = 0 AND abs(sh - eq) / eq <= 0.05 THEN round(v, 2) END AS market_cap, CASE WHEN eq IS NULL THEN 'single_class' WHEN bad > 0 THEN 'missing_share_class_data' WHEN abs(sh - eq) / eq <= 0.05 THEN 'validated_class_sum' ELSE 'shares_discrepancy' END AS status FROM p LEFT JOIN g USING (company)""")
def f10(spark, sf):
    p = S.prices(spark, sf)
    shares = p.select("company", "date", (F.floor("close").cast("long") * 3).alias("shares"))
    last = p.groupBy("company").agg(F.max_by("close", "date").alias("price"), F.max_by(F.floor("close").cast("long") * 3, "date").alias("sh")).filter("company % 2 = 0")
    ordinary = last.select("company", F.col("sh").alias("quantity"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("price"))
    preferred = last.select("company", F.when(F.col("company") != 6, F.floor(F.col("sh") * (F.col("company") % 5) / 100).cast("long")).alias("quantity"), F.lit(2.0).alias("weight"), (F.col("price") / 2).alias("price"))
    return market.current_market_cap(p, shares, ordinary.unionByName(preferred)).select("company", F.round("market_cap", 2).alias("market_cap"), "status")


@query("f15_valid_caps", f"WITH {S.MARKET_CAPS} SELECT company, ref_date, {S.VALID_CAP} AS valid FROM market_caps")
def f15(spark, sf):
    caps = S.market_caps(spark, sf)
    return caps.select("company", "ref_date", market.valid_cap(caps).alias("valid"))


@query("g13_roe", f"WITH {S.QUARTERS}, w AS (SELECT company, year, q, CAST(ebit AS DOUBLE) AS i, CAST(revenue AS DOUBLE) AS c, lag(CAST(revenue AS DOUBLE)) OVER (PARTITION BY company ORDER BY year, q) AS o FROM quarter_facts) SELECT company, year, q, CASE WHEN (o + c) / 2 > 0 THEN round(i / ((o + c) / 2), 6) END AS roe, CASE WHEN o IS NULL THEN 'missing' WHEN (o + c) / 2 <= 0 THEN 'non_positive_equity' ELSE 'ok' END AS status FROM w")
def g13(spark, sf):
    from pyspark.sql import Window as W

    f = S.quarter_facts(spark, sf)
    w = W.partitionBy("company").orderBy("year", "q")
    d = f.select("company", "year", "q", F.col("ebit").cast("double").alias("income"), F.lag(F.col("revenue").cast("double")).over(w).alias("equity_open"), F.col("revenue").cast("double").alias("equity_close"))
    return evidence.roe(d).select("company", "year", "q", F.round("roe", 6).alias("roe"), "status")


@query("g14_credit_loss", f"WITH {S.QUARTERS}, t AS (SELECT company, year, q, abs(cost) l, CASE WHEN q % 2 = 0 THEN revenue END g, ebit n FROM quarter_facts), u AS (SELECT *, coalesce(g, n + l) gr FROM t) SELECT company, year, q, CASE WHEN gr > 0 THEN round(CAST(l AS DOUBLE) / CAST(gr AS DOUBLE), 6) END AS proxy FROM u")
def g14(spark, sf):
    f = S.quarter_facts(spark, sf).select("company", "year", "q", F.col("cost").alias("allowance"), F.when(F.col("q") % 2 == 0, F.col("revenue")).alias("gross"), F.col("ebit").alias("net"))
    return evidence.credit_loss_proxy(f).select("company", "year", "q", F.round("proxy", 6).alias("proxy"))


@query("i08_comparison", f"WITH {S.QUARTERS}, t AS (SELECT company, year, q, unnest(['revenue', 'ebit']) AS metric, unnest([CAST(revenue AS DOUBLE), CASE WHEN q <> 3 THEN CAST(ebit AS DOUBLE) END]) AS value FROM quarter_facts), r AS (SELECT *, row_number() OVER (PARTITION BY company, metric ORDER BY year DESC, q DESC) k FROM t WHERE value IS NOT NULL) SELECT company, metric, year, q, value FROM r WHERE k = 1")
def i08(spark, sf):
    f = S.quarter_facts(spark, sf).withColumn("ebit", F.when(F.col("q") != 3, F.col("ebit")))
    return governance.comparison_table(f, ["revenue", "ebit"])


@query("i09_chart_series", f"WITH {S.QUARTERS}, y AS (SELECT company, year, sum(revenue) r FROM quarter_facts GROUP BY 1, 2) SELECT company, year, CAST(r AS DOUBLE) / 1e6 AS value, CAST(row_number() OVER (PARTITION BY company ORDER BY year) AS INTEGER) AS place FROM y")
def i09(spark, sf):
    return governance.chart_series(S.quarter_facts(spark, sf).groupBy("company", "year").agg(F.sum("revenue").alias("r")), "r")


@query("i10_audit_rows", f"""WITH {S.BALANCES}, {S.QUARTERS.replace(S._SALES + ', ', '')}, {S.REGISTRY}, a AS (SELECT company, count(*) n FROM balances WHERE company % 8 <> 3 GROUP BY 1), b AS (SELECT company, count(*) n FROM quarter_facts GROUP BY 1)
SELECT r.company, 'accounts' AS block, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'OK' END AS status FROM registry r LEFT JOIN a USING (company) UNION ALL SELECT r.company, 'calculations', coalesce(n, 0), CASE WHEN n IS NULL THEN 'missing' ELSE 'OK' END FROM registry r LEFT JOIN b USING (company)""")
def i10(spark, sf):
    return governance.audit_rows(S.registry(spark, sf), accounts=S.balances(spark, sf).filter("company % 8 <> 3"), calculations=S.quarter_facts(spark, sf))


@query("d12_method_audit", f"""WITH {S.FILINGS}, {S.REGISTRY}, m AS (SELECT company, year(ref_date) y, ref_date, version, CASE WHEN company % 5 = 1 THEN NULL WHEN company % 4 = 0 AND month(ref_date) > 6 THEN 'MD' WHEN company % 4 = 1 AND version > 5 THEN 'MD' ELSE 'MI' END AS method FROM filings WHERE company % 6 <> 2),
f AS (SELECT company, y, method, min(ref_date) since FROM m WHERE method IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT company, y, string_agg(method, ' -> ' ORDER BY since, method) methods, count(*) k FROM f GROUP BY 1, 2),
a AS (SELECT company, y, count(*) lines, string_agg(DISTINCT CAST(ref_date AS VARCHAR), ', ' ORDER BY CAST(ref_date AS VARCHAR)) ref_dates, string_agg(DISTINCT CAST(version AS VARCHAR), ', ' ORDER BY CAST(version AS VARCHAR)) versions FROM m GROUP BY 1, 2)
SELECT r.company, CAST(v.y AS INTEGER) AS file_year, CASE WHEN lines IS NOT NULL THEN coalesce(methods, '') END AS methods, coalesce(lines, 0) AS lines, ref_dates, versions, CASE WHEN lines IS NULL THEN 'missing' WHEN k > 1 THEN 'OK_method_transition' ELSE 'OK' END AS status
FROM registry r CROSS JOIN generate_series(1992, 2026) AS v(y) LEFT JOIN a ON r.company = a.company AND v.y = a.y LEFT JOIN n ON r.company = n.company AND v.y = n.y""")
def d12_methods(spark, sf):
    f = S.filings(spark, sf).filter("company % 6 <> 2").withColumns({"file_year": F.year("ref_date"), "method": F.expr("case when company % 5 = 1 then null when company % 4 = 0 and month(ref_date) > 6 then 'MD' when company % 4 = 1 and version > 5 then 'MD' else 'MI' end")})
    spine = S.registry(spark, sf).select("company", F.explode(F.sequence(F.lit(1992), F.lit(2026))).alias("file_year"))
    return filings.method_audit(f, spine)


# a sheet of every 40th order: a line is a cell, small quantities stand for periods, even documents have a period of their own
@query("g01_header_rows", f"""WITH c AS (SELECT l_orderkey % 40 AS doc, l_orderkey AS row, l_linenumber AS col, max(CASE WHEN l_quantity < 12 THEN 'P' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END) AS hp FROM lineitem GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN count(hp) OVER (PARTITION BY doc, row) >= 2 THEN hp END AS header FROM c)
SELECT doc, row, col, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc, col ORDER BY row RANGE BETWEEN {evidence.HEALTH_REACH} PRECEDING AND 1 PRECEDING), CASE WHEN doc % 2 = 0 THEN 'D' || CAST(doc AS VARCHAR) END) AS period FROM h""")
def g01_headers(spark, sf):
    period = F.when(F.col("l_quantity") < 12, F.concat(F.lit("P"), F.col("l_quantity").cast("int").cast("string")))
    c = read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("doc"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max(period).alias("header_period"))
    c = c.withColumns({"sheet": F.lit("s"), "own": F.when(F.col("doc") % 2 == 0, F.concat(F.lit("D"), F.col("doc").cast("string")))})
    return evidence.attach_period(c, evidence.HEALTH_REACH, least_periods=2, default="own").select("doc", "row", "col", "period")


# an item's value is its quarter, now and then one more, so that items with the same periods have equal series
@query("g08_identical_series", f"""WITH {S.OBSERVATIONS}, o AS (SELECT ticker, metric, source, scope, year * 10 + q AS period, CAST(q + CASE WHEN ordinal % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS value, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 9 END AS rank, ordinal FROM observations),
s AS (SELECT ticker, metric, source, scope, string_agg(DISTINCT CAST(period AS VARCHAR) || '=' || CAST(value AS VARCHAR), ',' ORDER BY CAST(period AS VARCHAR) || '=' || CAST(value AS VARCHAR)) AS series, min(rank * 1000000000000 + ordinal) AS f FROM o GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, series ORDER BY f) AS n FROM s) SELECT o.ticker, o.metric, o.source, o.scope, o.period, o.value, o.ordinal FROM o JOIN k USING (ticker, metric, source, scope) WHERE n = 1""")
def g08_series(spark, sf):
    o = S.observations(spark, sf).selectExpr("ticker", "metric", "source", "scope", "year * 10 + q as period", "int(q + if(ordinal % 97 = 0, 1, 0)) as value", "case confidence when 'high' then 0 when 'medium' then 1 else 9 end as rank", "ordinal")
    return evidence.drop_identical_series(o, ["ticker"], ["metric", "source", "scope"], ["rank", "ordinal"]).drop("rank")


@query("i07_sanitize_nested", """SELECT doc_id, md5(replace(replace(text, 'the ', 'THE '), 'THE a', '')) AS inner_text, md5(replace(replace(text, 'the ', 'THE '), 'THE a', '')) AS mapped, replace(lang, 'the ', 'THE ') AS listed, 'the a' AS map_key, n_chars FROM documents""")
def i07_nested(spark, sf):
    d = read(spark, sf, "documents").selectExpr("doc_id", "named_struct('t', text, 'deep', array(named_struct('l', lang, 'm', map('the a', text), 'n', n_chars))) as nest")
    return governance.sanitize(d, {"the ": "THE ", "THE a": ""}).selectExpr("doc_id", "md5(nest.t) as inner_text", "md5(nest.deep[0].m['the a']) as mapped", "nest.deep[0].l as listed", "map_keys(nest.deep[0].m)[0] as map_key", "nest.deep[0].n as n_chars")
