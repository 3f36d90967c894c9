"""Registered queries of the evidence, override, tracking and publication operators, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundamentals_spark.operators import evidence, governance
from fundamentals_spark.plans import standins as S
from fundamentals_spark.sources import links as L

QUERIES, SQL = {}, {}
_O = f"WITH {S.OBSERVATIONS}"
_KEY = ["ticker", "metric", "year", "q"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dbl(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query("a07_catalogue", """SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 20) AS short_id, CAST(strlen(text) AS INTEGER) AS size, sha256(source || chr(0) || sha256(text)) AS stable_id FROM documents""")
def a07(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.col("source").alias("origin"))
    return governance.catalog(d).select("doc_id", "sha256", "short_id", "size", "stable_id")


@query("a10_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS url FROM pages) SELECT page_id, url, count(*) AS n, regexp_matches(lower(url), '\.pdf|release|resultado') AS looks_like_document FROM l GROUP BY 1, 2""")
def a10(spark, sf):
    links = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url"))
    return links.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n")).withColumn("looks_like_document", F.lower("url").rlike(r"\.pdf|release|resultado"))


# links of investor documents stand after each page's markup, far enough that its words do not tell their period or type
@query("a10_discover", """WITH p AS (SELECT page_id, page_id % 7 AS company, url, page_id % 4 + 1 AS q, 20 + page_id % 6 AS y, page_id % 5 AS k FROM pages),
l AS (SELECT *, 1 AS n, 'https://docs.example.net/' || CASE WHEN k = 4 THEN 'audio' ELSE 'r' END || page_id || '.pdf?a=1&b=2' AS u, CASE WHEN k = 4 THEN NULL ELSE 'RELEASE_RESULTADOS' END AS type FROM p
UNION ALL SELECT *, 2, 'http://cdn.docs.example.net/download?id=' || page_id, 'DEMONSTRACOES_FINANCEIRAS' FROM p WHERE k <> 1 UNION ALL SELECT *, 3, 'https://docs.example.net/x' || page_id || '.xlsx', 'PLANILHA_RESULTADOS' FROM p WHERE k < 2),
r AS (SELECT *, row_number() OVER (PARTITION BY company, q, y, type ORDER BY page_id, n) AS i FROM l WHERE type IS NOT NULL AND y >= 22)
SELECT company, url AS page_url, u AS document_url, q || 'T' || y AS period, CAST(2000 + y AS INTEGER) AS year, type FROM r WHERE i = 1""")
def a10_discover(spark, sf):
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    label = F.concat((F.col("page_id") % 4 + 1).cast("string"), F.lit("T"), (F.col("page_id") % 6 + 20).cast("string"))
    far = lambda text: F.concat(F.lit(" " * (L.REACH + 200)), text)
    release = F.concat(F.lit('<a href="https://docs.example.net/'), F.when(k == 4, "audio").otherwise("r"), n, F.lit('.pdf?a=1&amp;b=2">Release de resultados '), label, F.lit("</a>"))
    script = F.concat(F.lit('<script>{"title": "Demonstrações financeiras '), label, F.lit('", "url": "http:\\/\\/'), F.when(k == 1, "mydocs.example.net").otherwise("cdn.docs.example.net"), F.lit("\\/download?id="), n, F.lit('"}</script>'))
    sheet = F.concat(F.lit("<button data-url='https://docs.example.net/x"), n, F.when(k < 2, ".xlsx").otherwise(".html"), F.lit("'>Planilha de fundamentos "), label, F.lit("</button>"))
    pages = read(spark, sf, "pages").select("page_id", (F.col("page_id") % 7).alias("company"), "url", F.concat("html", far(release), far(script), far(sheet)).alias("html"))
    domains = spark.createDataFrame([("docs.example.net",)], "domain string")
    return L.discover_links(pages, domains, first_year=2022, company="company").drop("title")


@query("a12_manifest_merge", f"""{_O}, o AS (SELECT ticker, metric, year, q, CASE WHEN ordinal % 6 = 1 THEN value * 2 ELSE value END AS value, ordinal, CASE WHEN ordinal % 6 = 1 THEN 1 ELSE 0 END AS g FROM observations), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric, year, q ORDER BY g DESC, ordinal DESC) k FROM o)
SELECT ticker, metric, year, q, CAST(value AS DOUBLE) AS value, ordinal FROM r WHERE k = 1""")
def a12(spark, sf):
    o = S.observations(spark, sf).select(*_KEY, "value", "ordinal").withColumn("renewed", F.col("ordinal") % 6 == 1)  # every row is on one side
    new = o.filter("renewed").drop("renewed").withColumn("value", (F.col("value") * 2).cast("decimal(18,4)"))
    return _dbl(governance.merge_manifest(o.filter("not renewed").drop("renewed"), new, _KEY), "value")


@query("g01_attach_period", """WITH c AS (SELECT o_custkey % 50 AS doc, o_custkey % 7 AS col, o_orderkey AS row, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS hp FROM orders)
SELECT doc, row, last_value(hp IGNORE NULLS) OVER (PARTITION BY doc, col ORDER BY row RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS period FROM c""")
def g01(spark, sf):
    o = read(spark, sf, "orders")
    cells = o.select((F.col("o_custkey") % 50).alias("doc"), F.lit("s").alias("sheet"), (F.col("o_custkey") % 7).alias("col"), F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("header_period"))
    return evidence.attach_period(cells, 500).select("doc", "row", "period")


_RULES = [("steel", "steel", None), ("plated_steel", "plated steel", None), ("brass", "brass", "small"), ("copper", "copper", None), ("tin", "tin", "promo")]


@query("g02_classify_labels", """WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) t FROM part), p AS (SELECT p_partkey, ' ' || t || ' ' AS t FROM n)
SELECT p_partkey, CASE WHEN contains(t, ' plated steel ') THEN 'plated_steel' WHEN contains(t, ' copper ') THEN 'copper' WHEN contains(t, ' steel ') THEN 'steel' WHEN contains(t, ' brass ') AND NOT contains(t, 'small') THEN 'brass' WHEN contains(t, ' tin ') AND NOT contains(t, 'promo') THEN 'tin' END AS metric FROM p""")
def g02(spark, sf):
    rules = spark.createDataFrame(_RULES, "metric string, alias string, forbidden string")
    return evidence.classify_labels(read(spark, sf, "part").select("p_partkey", "p_type"), rules, "p_type").select("p_partkey", "metric")


@query("g03_context_above", """SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS context FROM conversations""")
def g03(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.lit(0).alias("sheet"), F.col("turn").alias("row"), "text")
    return evidence.context_above(c, 3).select(F.col("doc").alias("conv_id"), F.col("row").alias("turn"), F.md5("context").alias("context"))


@query("g06_score", f"""{_O} SELECT ordinal, CASE WHEN value < 1 THEN 35 WHEN metric = 'view' THEN 82 WHEN metric = 'error' THEN 74 WHEN source = 'spreadsheet' THEN 90 ELSE 76 END AS score FROM observations""")
def g06(spark, sf):
    o = S.observations(spark, sf).withColumns({"rejected": F.col("value") < 1, "mapping": F.when(F.col("metric") == "view", "calculated").when(F.col("metric") == "error", "proxy").otherwise("reported")})
    return evidence.score_observations(o).select("ordinal", "score")


_STATUS = "CASE WHEN scope = 'segment' THEN 'quarantined_scope' WHEN value IS NULL THEN 'quarantined' WHEN confidence = 'low' THEN 'low_confidence' ELSE 'valid' END"


@query("g07_validation_status", f"{_O} SELECT ordinal, {_STATUS} AS status FROM observations")
def g07(spark, sf):
    return evidence.validation_status(S.observations(spark, sf), ("value", "year", "source")).select("ordinal", "status")


_BEST = "r AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric, year, q ORDER BY scope, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, source DESC, ordinal) k FROM observations)"


def _best(spark, sf):
    c = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return evidence.dedupe_observations(S.observations(spark, sf), _KEY, [F.col("scope"), c, F.col("source").desc(), F.col("ordinal")])


@query("g08_dedupe", f"{_O}, {_BEST} SELECT ticker, metric, year, q, CAST(value AS DOUBLE) AS value, ordinal FROM r WHERE k = 1")
def g08(spark, sf):
    return _dbl(_best(spark, sf).select(*_KEY, "value", "ordinal"), "value")


@query("g09_source_precedence", f"{_O}, a AS (SELECT * FROM observations WHERE source = 'spreadsheet') SELECT ordinal, source FROM a UNION ALL SELECT ordinal, source FROM observations o WHERE source = 'pdf' AND NOT EXISTS (SELECT 1 FROM a WHERE a.ticker = o.ticker AND a.metric = o.metric AND a.year = o.year AND a.q = o.q)")
def g09(spark, sf):
    o = S.observations(spark, sf)
    return evidence.fill_missing(o.filter("source = 'spreadsheet'"), o.filter("source = 'pdf'"), _KEY).select("ordinal", "source")


@query("g10_ratio", f"""{_O}, g AS (SELECT ticker, year, q, scope, max(value) FILTER (metric = 'purchase') a, max(value) FILTER (metric = 'view') b FROM observations GROUP BY 1, 2, 3, 4)
SELECT ticker, year, q, scope, CASE WHEN b <> 0 THEN round(CAST(a AS DOUBLE) / CAST(b AS DOUBLE), 6) END AS value, CASE WHEN a IS NULL THEN 'missing_numerator' WHEN b IS NULL THEN 'missing_denominator' WHEN b = 0 THEN 'zero_denominator' END AS reason FROM g""")
def g10(spark, sf):
    return evidence.derive_ratio(S.observations(spark, sf), "purchase", "view", "ratio").select("ticker", "year", "q", "scope", F.round("value", 6).alias("value"), "reason")


_UNITS = [("view", "n"), ("click", "n"), ("purchase", "BRL")]


@query("g11_contract", f"""{_O}, t AS (SELECT ordinal, ticker, metric, scope, CASE WHEN ordinal % 13 = 0 THEN '1T2x' WHEN ordinal % 7 = 0 THEN CAST(year AS VARCHAR) ELSE q || 'T' || CAST(year % 100 AS VARCHAR) END AS period, CASE WHEN ordinal % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN ordinal % 19 = 0 THEN NULL ELSE CAST(value AS DOUBLE) END AS v,
  CASE WHEN ordinal % 6 = 0 THEN 'BRL' ELSE 'n' END AS unit, CASE ordinal % 3 WHEN 0 THEN 'reported' WHEN 1 THEN 'derived' END AS nature, CASE WHEN ordinal % 5 = 0 THEN '' ELSE 'd' END AS doc, CASE WHEN ordinal % 4 <> 0 THEN 'a / b' END AS formula FROM observations)
SELECT ordinal, CASE WHEN metric NOT IN ('view', 'click', 'purchase') THEN 'unknown_metric' ELSE concat_ws(',', CASE WHEN ticker <> 'T1' THEN 'ticker_mismatch' END, CASE WHEN v IS NULL OR isnan(v) THEN 'missing_value' END, CASE WHEN period = '1T2x' THEN 'bad_period' END,
CASE WHEN row_number() OVER (PARTITION BY ticker, metric, period, scope ORDER BY ordinal) > 1 THEN 'duplicate_key' END, CASE WHEN unit <> CASE metric WHEN 'purchase' THEN 'BRL' ELSE 'n' END THEN 'unit_mismatch' END, CASE WHEN nature = 'reported' AND doc = '' THEN 'missing_source_document' END, CASE WHEN nature = 'derived' AND formula IS NULL THEN 'missing_formula' END, CASE WHEN nature IS NULL THEN 'missing_nature' END) END AS errors FROM t""")
def g11(spark, sf):
    k = F.col("ordinal")
    label = F.concat(F.col("q").cast("string"), F.lit("T"), (F.col("year") % 100).cast("string"))
    o = S.observations(spark, sf).select(
        "ordinal", "ticker", "metric", "scope", F.when(k % 13 == 0, "1T2x").when(k % 7 == 0, F.col("year").cast("string")).otherwise(label).alias("period"), F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, None).otherwise(F.col("value").cast("double")).alias("value"),
        F.when(k % 6 == 0, "BRL").otherwise("n").alias("unit"), F.when(k % 3 == 0, "reported").when(k % 3 == 1, "derived").alias("nature"), F.when(k % 5 == 0, "").otherwise("d").alias("source_document"), F.when(k % 4 != 0, "a / b").alias("formula"),
    )
    rules = spark.createDataFrame(_UNITS, "metric string, unit string")
    return evidence.check_observations(o, rules, ["ticker", "metric", "period", "scope"], "t1").select("ordinal", F.array_join("errors", ",").alias("errors"))


@query("g12_vso", f"""{_O}, g AS (SELECT ticker, CASE WHEN ordinal % 11 = 0 THEN 'unknown' ELSE source END AS basis, year, q, year * 4 + q AS i, max(value) FILTER (metric = 'purchase') s, max(value) FILTER (metric = 'click') l, max(value) FILTER (metric = 'view') inv FROM observations WHERE (CAST(substr(ticker, 2) AS INTEGER) + year + q) % 5 <> 0 GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT a.ticker, a.i, max(b.i) AS before FROM (SELECT DISTINCT ticker, i FROM g) a LEFT JOIN (SELECT DISTINCT ticker, i FROM g) b ON a.ticker = b.ticker AND b.i < a.i GROUP BY 1, 2),
w AS (SELECT g.*, o.inv AS o FROM g JOIN e USING (ticker, i) LEFT JOIN g o ON o.ticker = g.ticker AND o.basis = g.basis AND o.i = e.before), t AS (SELECT *, CASE WHEN s IS NULL OR l IS NULL OR o IS NULL THEN 'missing_components' WHEN basis = 'unknown' THEN 'incompatible_basis' WHEN o + l <= 0 THEN 'invalid_denominator' ELSE 'derived' END AS calculation_status FROM w),
r AS (SELECT *, abs(CAST(inv - (o + l - s) AS DOUBLE)) AS gap FROM t)
SELECT ticker, basis, year, q, CASE WHEN calculation_status = 'derived' THEN round(CAST(s AS DOUBLE) / CAST(o + l AS DOUBLE), 6) END AS vso, calculation_status, CASE WHEN calculation_status <> 'derived' OR gap IS NULL THEN 'not_calculable' WHEN gap <= 1e-9 THEN 'reconciled' WHEN gap / greatest(abs(CAST(o + l AS DOUBLE)), 1) <= 0.05 THEN 'immaterial_difference' ELSE 'material_difference' END AS reconciliation FROM r""")
def g12(spark, sf):
    m = F.when(F.col("metric") == "purchase", "net_sales").when(F.col("metric") == "click", "launches").when(F.col("metric") == "view", "inventory").otherwise("none")
    o = S.observations(spark, sf).filter("(cast(substr(ticker, 2) as int) + year + q) % 5 <> 0")
    o = o.withColumns({"metric": m, "basis": F.when(F.col("ordinal") % 11 == 0, "unknown").otherwise(F.col("source"))})
    return evidence.vso(o).select("ticker", "basis", "year", "q", F.round("vso", 6).alias("vso"), "calculation_status", "reconciliation")


@query("g15_annualize", f"""{_O}, b AS (SELECT ticker, metric, CASE WHEN metric IN ('view', 'error') THEN 'stock' WHEN metric = 'signup' THEN 'ratio' ELSE 'flow' END nature, year, q, max(value) v FROM observations WHERE ticker <> 'T1' GROUP BY 1, 2, 3, 4, 5), g AS (SELECT ticker, metric, nature, year, count(*) n, sum(v) s, max(v) FILTER (q = 4) l FROM b GROUP BY 1, 2, 3, 4),
m AS (SELECT ticker, metric, year, CASE WHEN nature = 'stock' THEN l WHEN nature = 'flow' AND n = 4 THEN s END AS value FROM g), rep AS (SELECT DISTINCT ticker, metric, 2021 AS year, CAST(7 AS DECIMAL(18,4)) AS value FROM observations WHERE ticker IN ('T1', 'T2'))
SELECT ticker, metric, CAST(year AS INTEGER) AS year, CAST(value AS DOUBLE) AS value, 'reported' AS origin FROM rep UNION ALL SELECT ticker, metric, year, CAST(value AS DOUBLE), 'derived' FROM m WHERE value IS NOT NULL AND NOT (ticker = 'T2' AND year = 2021)""")
def g15(spark, sf):
    o = S.observations(spark, sf)
    nature = F.when(F.col("metric").isin("view", "error"), "stock").when(F.col("metric") == "signup", "ratio").otherwise("flow")
    quarters = o.filter("ticker <> 'T1'").groupBy(*_KEY).agg(F.max("value").alias("value")).withColumn("nature", nature)
    annual = o.filter("ticker in ('T1', 'T2')").select("ticker", "metric").distinct().select("ticker", "metric", F.lit(2021).alias("year"), F.lit(None).cast("long").alias("q"), F.lit(7).cast("decimal(18,4)").alias("value")).withColumn("nature", nature)
    return _dbl(evidence.annualize(quarters.unionByName(annual), ["ticker", "metric"]).select("ticker", "metric", "year", "value", "origin"), "value")


_LABELS = ("Por Região - Sul", "Total by product", "By Region", "Vendas por produto", "Região Sul", "Total")


@query("g16_quarantine", f"""{_O}, t AS (SELECT ordinal, CAST(value AS DOUBLE) AS v, CAST(floor(value) AS BIGINT) + 1 AS n, (ordinal % 6) IN (0, 2, 3) AS brk, ordinal % 5 AS k FROM observations),
e AS (SELECT *, CASE k WHEN 0 THEN [n * 1000.0, n * 500.0] WHEN 1 THEN [n * 1000.0, n] WHEN 2 THEN [n * 1000.0, n * 1000.0, n * 1000.0, n * 1000.0] WHEN 3 THEN [n] END AS x FROM t)
SELECT ordinal, CASE WHEN brk THEN 'breakdown_as_total' WHEN v <> 0 AND list_min(x) / abs(v) > 100 THEN 'scale_incompatible_with_evidence' END AS rejection_reason FROM e""")
def g16(spark, sf):
    o = S.observations(spark, sf)
    n = F.floor("value").cast("long") + 1
    bold = lambda *xs: F.concat(*[F.concat(F.lit("| **"), x.cast("string"), F.lit("** ")) for x in xs])
    k = F.col("ordinal") % 5
    # the fifth bold number does not count; numbers that are not bold do not either; thousands of the unit are scaled
    text = F.when(k == 0, bold(n * 1000, n * 500)).when(k == 1, bold(n * 1000, n)).when(k == 2, bold(n * 1000, n * 1000, n * 1000, n * 1000, n)).when(k == 3, bold(n * 1000)).otherwise(F.concat((n * 1000).cast("string"), F.lit(" mil")))
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("ordinal") % 6 + 1).cast("int"))
    rows = o.withColumns({"label": label, "evidence": text, "unit": F.when(k == 3, "R$ mil")})
    return evidence.quarantine(rows).select("ordinal", "rejection_reason")


# two tickers have zeros only; low confidence neither counts nor goes
@query("g17_prune_zeros", f"{_O}, z AS (SELECT ticker, year, q, ordinal, confidence, CASE WHEN (year = 2023 AND q > 2) OR ticker IN ('T5', 'T6') THEN 0 ELSE value END AS value FROM observations), w AS (SELECT *, max(CASE WHEN value <> 0 AND coalesce(confidence, '') <> 'low' THEN year * 4 + q END) OVER (PARTITION BY ticker) l FROM z) SELECT ordinal FROM w WHERE confidence = 'low' OR l IS NULL OR year * 4 + q <= l")
def g17(spark, sf):
    zero = ((F.col("year") == 2023) & (F.col("q") > 2)) | F.col("ticker").isin("T5", "T6")
    o = S.observations(spark, sf).withColumn("value", F.when(zero, F.lit(0).cast("decimal(18,4)")).otherwise(F.col("value")))
    return evidence.prune_trailing_zeros(o, ["ticker"]).select("ordinal")


@query("g18_common_ratio", f"{_O}, r AS (SELECT ticker, metric, year, q, max(value) v FROM observations GROUP BY 1, 2, 3, 4) SELECT a.ticker, a.year, a.q, round(CAST(a.v AS DOUBLE) / CAST(b.v AS DOUBLE), 6) AS value FROM r a JOIN r b USING (ticker, year, q) WHERE a.metric = 'purchase' AND b.metric = 'signup' AND b.v <> 0")
def g18(spark, sf):
    r = S.observations(spark, sf).groupBy(*_KEY).agg(F.max("value").alias("value"))
    return evidence.ratio_on_common_periods(r.filter("metric = 'purchase'"), r.filter("metric = 'signup'"), ["ticker", "year", "q"]).withColumn("value", F.round("value", 6))


@query("g19_coverage_warnings", f"""{_O}, o AS (SELECT * FROM observations WHERE NOT (ticker IN ('T3', 'T4') AND metric = 'view')), t AS (SELECT DISTINCT ticker FROM observations), m AS (SELECT DISTINCT metric FROM observations), g AS (SELECT ticker, metric, count(*) FILTER (confidence = 'high') h, count(*) FILTER (confidence = 'medium') md FROM o GROUP BY 1, 2)
SELECT ticker, metric, CASE WHEN h IS NULL THEN 'not_found' WHEN h > 0 THEN 'ok' WHEN md > 0 THEN 'medium_confidence' ELSE 'rejected_candidates' END AS warning FROM t CROSS JOIN m LEFT JOIN g USING (ticker, metric)""")
def g19(spark, sf):
    o = S.observations(spark, sf)
    return evidence.coverage_warnings(o.filter("not (ticker in ('T3', 'T4') and metric = 'view')"), o.select("ticker").distinct(), o.select("metric").distinct())


@query("g20_resolve_documents", r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), h AS (SELECT doc_id, contains(t, ' mit license ') a, contains(t, ' apache license ') b, contains(t, ' license ') c FROM d)
SELECT doc_id, CASE WHEN b THEN 2 WHEN a THEN 1 WHEN c THEN 3 END AS company, CASE WHEN b OR a THEN 'name' WHEN c THEN 'alias' ELSE 'none' END AS method FROM h""")
def g20(spark, sf):
    names = spark.createDataFrame([(1, "MIT License", "name"), (2, "Apache License", "name"), (3, "License", "alias")], "company int, name string, method string")
    return evidence.resolve_documents(read(spark, sf, "documents"), names)


_COMPANIES = [
    (1, "MITX3", "12.345.678/0001-95", ["MIT License", "MITX11"], ["ri.mitx.example"]), (2, "APCH4", "98765432000110", ["Apache License"], ["ri.apch.example", "apch.example"]), (3, "LICN5", "11222333000144", ["Licensed under"], []),
]


# documents with a path, some with a CNPJ behind the text, some with an address
@query("g20_company_of_document", f"""WITH c(company, ticker, cnpj, names, domains) AS (VALUES {", ".join(f"({a}, '{b}', '{c}', {d}, {e})" for a, b, c, d, e in _COMPANIES)}),
d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'dir/mitx3-' ELSE 'dir/' END || doc_id || '.pdf' AS path, coalesce(text, '') || CASE WHEN doc_id % 7 = 3 THEN ' CNPJ 12.345.678/0001-95' ELSE '' END AS text, CASE WHEN doc_id % 5 = 1 THEN 'https://RI.apch.example/x' WHEN doc_id % 5 = 2 THEN 'http://other.example/y' END AS url FROM documents),
h AS (SELECT doc_id, company, ticker, cnpj, path, lower(split_part(url, '/', 3)) AS host, list_filter(list_concat([ticker], names), lambda n: contains(upper(path || ' ' || text), upper(n))) AS hits, contains(regexp_replace(text, '[^0-9]', '', 'g'), regexp_replace(cnpj, '[^0-9]', '', 'g')) AS k, coalesce(list_contains(domains, lower(split_part(url, '/', 3))), false) AS m FROM d, c),
e AS (SELECT *, list_concat(hits, CASE WHEN k THEN ['CNPJ:' || cnpj] WHEN m THEN ['DOMAIN:' || host] ELSE [] END) AS ev FROM h), x AS (SELECT *, list_max(list_transform(ev, lambda v: length(v))) AS n FROM e WHERE len(ev) > 0),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS same, max(n) OVER (PARTITION BY doc_id) AS top FROM x)
SELECT d.doc_id, company, CASE WHEN company IS NULL THEN NULL WHEN contains(upper(d.path), ticker) THEN 'filename_ticker' WHEN k THEN 'content_cnpj' WHEN m THEN 'official_domain' ELSE 'content_alias' END AS method FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND n = top AND same = 1""")
def g20_company(spark, sf):
    k = F.col("doc_id")
    companies = spark.createDataFrame(_COMPANIES, "company int, ticker string, cnpj string, names array<string>, domains array<string>")
    docs = read(spark, sf, "documents").select(
        "doc_id", F.concat(F.when(k % 9 == 0, "dir/mitx3-").otherwise("dir/"), k.cast("string"), F.lit(".pdf")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.when(k % 7 == 3, " CNPJ 12.345.678/0001-95").otherwise("")).alias("text"),
        F.when(k % 5 == 1, "https://RI.apch.example/x").when(k % 5 == 2, "http://other.example/y").alias("url"),
    )
    return evidence.company_of_document(docs, companies).select("doc_id", "company", "method")


@query("g21_metric_series", f"""{_O}, {_BEST} SELECT ticker, metric, count(*) AS n_periods, CAST(sum(value) AS DOUBLE) AS total, min_by(confidence, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst, count(DISTINCT source) AS sources FROM r WHERE k = 1 GROUP BY 1, 2""")
def g21(spark, sf):
    s = evidence.metric_series(_best(spark, sf))
    return s.select("ticker", "metric", F.size("periods").cast("long").alias("n_periods"), F.aggregate(F.map_values("periods"), F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + x).cast("decimal(38,4)")).cast("double").alias("total"), "worst", "sources")


@query("g22_preserve_snapshot", f"{_O} SELECT ordinal, CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 3 <> 0 THEN 'updated' ELSE 'preserved_existing_data' END AS status FROM observations WHERE (year = 2023 AND CAST(substr(ticker, 2) AS INTEGER) % 3 <> 0) OR (year = 2022 AND CAST(substr(ticker, 2) AS INTEGER) % 3 = 0) ")
def g22(spark, sf):
    o = S.observations(spark, sf)
    third = F.substring("ticker", 2, 9).cast("int") % 3 == 0
    return evidence.preserve_snapshot(o.filter("year = 2023").filter(~third), o.filter("year = 2022")).select("ordinal", "status")


# first quarters stand in for annual rows, which rank after the fourth quarter
@query("g24_latest_metric", f"{_O}, t AS (SELECT *, CASE WHEN q > 1 THEN q END AS p FROM observations WHERE confidence <> 'low'), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY year DESC, coalesce(p, 5) DESC, ordinal DESC) k FROM t) SELECT ticker, metric, year, p AS q, CAST(value AS DOUBLE) AS value FROM r WHERE k = 1")
def g24(spark, sf):
    o = S.observations(spark, sf).withColumn("q", F.when(F.col("q") > 1, F.col("q")))
    return _dbl(evidence.latest_metric(o).select(*_KEY, "value"), "value")


@query("g25_priority", f"{_O}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, year, q ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 3 END, ordinal) k FROM observations) SELECT ticker, year, q, ordinal, confidence FROM r WHERE k = 1")
def g25(spark, sf):
    return evidence.resolve_by_priority(S.observations(spark, sf), ["ticker", "year", "q"]).select("ticker", "year", "q", "ordinal", "confidence")


@query("g26_benchmark", f"""{_O}, e AS (SELECT ordinal AS id, ticker, metric, year, q, CASE WHEN ordinal % 10 = 0 THEN NULL WHEN ordinal % 3 = 0 THEN CAST(value AS DOUBLE) + 5 ELSE CAST(value AS DOUBLE) END AS v, ordinal % 8 = 0 AS protected FROM observations WHERE source = 'pdf'), a AS (SELECT ticker, metric, year, q, CAST(value AS DOUBLE) AS x FROM observations WHERE source = 'spreadsheet'),
j AS (SELECT id, any_value(v) v, bool_or(protected) p, count(x) n, bool_or(abs(x - v) <= greatest(0.01, abs(v) * 0.01)) near FROM e LEFT JOIN a USING (ticker, metric, year, q) GROUP BY id)
SELECT id, CASE WHEN p AND n = 0 THEN 'protected_state' WHEN p THEN 'false_positive' WHEN n = 0 THEN 'not_found' WHEN v IS NULL THEN 'found_without_expected_value' WHEN near THEN 'match' ELSE 'mismatch' END AS outcome FROM j""")
def g26(spark, sf):
    o = S.observations(spark, sf)
    v = F.col("value").cast("double")
    e = o.filter("source = 'pdf'").select(F.col("ordinal").alias("id"), "ticker", "metric", "year", "q", F.when(F.col("ordinal") % 10 == 0, None).when(F.col("ordinal") % 3 == 0, v + 5).otherwise(v).alias("value"), (F.col("ordinal") % 8 == 0).alias("protected"))
    return evidence.benchmark(e, o.filter("source = 'spreadsheet'"))


_OVR = "ovr AS (SELECT *, CASE WHEN ordinal % 4 = 3 THEN 'deleted' ELSE 'active' END AS status FROM observations)"


def _overrides(spark, sf):
    return S.observations(spark, sf).withColumn("status", F.when(F.col("ordinal") % 4 == 3, "deleted").otherwise("active"))


@query("h02_one_active", f"{_O}, {_OVR} SELECT ordinal, CASE WHEN status = 'active' AND row_number() OVER (PARTITION BY ticker, metric, year, q, status ORDER BY ordinal DESC) > 1 THEN 'superseded' ELSE status END AS status FROM ovr")
def h02(spark, sf):
    return governance.normalize_overrides(_overrides(spark, sf)).select("ordinal", "status")


# every row is a base row (active, or history) or a change
@query("h03_upsert", f"""{_O}, b AS (SELECT ticker, metric, year, q, CASE WHEN ordinal % 3 = 0 THEN 'active' WHEN year % 2 = 0 THEN 'superseded' ELSE 'deleted' END AS status, max(value) AS v FROM observations WHERE ordinal % 3 <> 1 GROUP BY ALL), c AS (SELECT ticker, metric, year, q, max(value) AS n, CASE WHEN q % 2 = 0 THEN 'upsert' ELSE 'delete' END AS op FROM observations WHERE ordinal % 3 = 1 GROUP BY ALL)
SELECT ticker, metric, year, q, CAST(v AS DOUBLE) AS value, status, NULL AS error FROM b WHERE status <> 'active'
UNION ALL SELECT ticker, metric, year, q, CAST(CASE WHEN op = 'upsert' THEN n ELSE v END AS DOUBLE), CASE WHEN op = 'delete' AND status IS NULL THEN NULL WHEN op = 'delete' THEN 'deleted' ELSE 'active' END, CASE WHEN op = 'delete' AND status IS NULL THEN 'no_active_row' END FROM (SELECT * FROM b WHERE status = 'active') FULL JOIN c USING (ticker, metric, year, q)""")
def h03(spark, sf):
    o = S.observations(spark, sf).withColumn("side", F.col("ordinal") % 3)
    status = F.when(F.col("side") == 0, "active").when(F.col("year") % 2 == 0, "superseded").otherwise("deleted")
    b = o.filter("side <> 1").groupBy(*_KEY, status.alias("status")).agg(F.max("value").alias("value"))
    c = o.filter("side = 1").groupBy(*_KEY).agg(F.max("value").alias("value")).withColumn("op", F.when(F.col("q") % 2 == 0, "upsert").otherwise("delete"))
    return _dbl(governance.upsert_overrides(b, c), "value")


_MANUAL = "m AS (SELECT ordinal, ticker, metric, year, q, value * 3 AS value, CASE WHEN ordinal % 33 = 0 THEN 'deleted' WHEN ordinal % 55 = 0 THEN 'superseded' ELSE 'active' END AS status FROM observations WHERE ordinal % 11 = 0)"
_AUTO = "a AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric, year, q ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, ordinal DESC) k FROM observations WHERE confidence IN ('high', 'medium') AND value IS NOT NULL AND ordinal % 11 <> 0)"
_MEET = "m LEFT JOIN a ON k = 1 AND m.ticker = a.ticker AND m.metric = a.metric AND m.year = a.year AND m.q = a.q"


def _manual(spark, sf):
    """Automatic observations, and overrides of three states."""
    o = S.observations(spark, sf).withColumn("manual", F.col("ordinal") % 11 == 0)
    status = F.when(F.col("ordinal") % 33 == 0, "deleted").when(F.col("ordinal") % 55 == 0, "superseded").otherwise("active")
    return o.filter("not manual").drop("manual"), o.filter("manual").select("ordinal", *_KEY, (F.col("value") * 3).cast("decimal(18,4)").alias("value"), status.alias("status"))


# every row is an automatic observation or an override
@query("h04_supersession", f"""{_O}, {_AUTO}, {_MANUAL} SELECT m.ordinal, CASE WHEN m.status = 'active' AND a.confidence IS NOT NULL THEN 'superseded' ELSE m.status END AS status, CAST(CASE WHEN m.status = 'active' THEN coalesce(a.value, m.value) END AS DOUBLE) AS used_value, CASE WHEN m.status = 'active' AND a.confidence IS NULL THEN 'manual_value_in_use' END AS warning FROM {_MEET}""")
def h04(spark, sf):
    return _dbl(governance.resolve_overrides(*_manual(spark, sf)).select("ordinal", "status", "used_value", "warning"), "used_value")


@query("h04_merged_series", f"""{_O}, {_AUTO}, {_MANUAL} SELECT ticker, metric, year, q, CAST(value AS DOUBLE) AS value, confidence, 'automatic' AS nature FROM observations WHERE ordinal % 11 <> 0
UNION ALL SELECT m.ticker, m.metric, m.year, m.q, CAST(m.value AS DOUBLE), 'MANUAL', 'manual' FROM {_MEET} WHERE m.status = 'active' AND a.confidence IS NULL""")
def h04_merged(spark, sf):
    return _dbl(governance.merge_manual(*_manual(spark, sf)), "value")


_L = f"WITH {S.LIFECYCLE}"


_NEXT = ", ".join(f"('{a}', '{b}')" for a, bs in governance.TRANSITIONS.items() for b in bs)
_END = "'published', 'preserved_existing', 'rejected', 'unresolved', 'extraction_error'"


@query("i01_transitions", f"""{_L}, nx(a, b) AS (VALUES {_NEXT}), w AS (SELECT *, lag(state) OVER v AS p, coalesce(max(CASE WHEN state IN ({_END}) THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY at_ts, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM lifecycle WINDOW v AS (PARTITION BY document ORDER BY at_ts, ordinal))
SELECT ordinal, CASE WHEN state = 'archived' THEN 'unknown_state' WHEN ended = 1 THEN 'after_terminal_state' WHEN state <> 'discovered' AND NOT EXISTS (SELECT 1 FROM nx WHERE a = p AND b = state) THEN 'illegal_transition' END AS error FROM w""")
def i01(spark, sf):
    return governance.check_transitions(S.lifecycle(spark, sf)).select("ordinal", "error")


@query("i02_run_summary", f"""{_L}, r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY at_ts DESC, ordinal DESC) k FROM lifecycle), d AS (SELECT document % 10 AS run, document, max(state) FILTER (k = 1) l, bool_or(state = 'accepted') x, max_by(observations_count, ordinal) FILTER (observations_count IS NOT NULL) o, count(*) n FROM r GROUP BY 1, 2)
SELECT run, count(*) AS found, count(*) FILTER (x) AS accepted, count(*) FILTER (l IN ('read', 'company_resolved', 'parsed', 'validated', 'published')) AS processed, count(*) FILTER (o > 0) AS with_observations, count(*) FILTER (l = 'unresolved') AS unresolved, count(*) FILTER (l = 'extraction_error') AS errors, count(*) FILTER (l = 'rejected') AS rejected, count(*) FILTER (l = 'published') AS published,
CAST(sum(n) AS BIGINT) AS events, CASE WHEN count(*) FILTER (l IN ('read', 'company_resolved', 'parsed', 'validated', 'published')) = 0 THEN 'none' WHEN count(*) FILTER (l IN ('read', 'company_resolved', 'parsed', 'validated', 'published')) = count(*) THEN 'complete' ELSE 'partial' END AS coverage FROM d GROUP BY 1""")
def i02(spark, sf):
    return governance.run_summary(S.lifecycle(spark, sf).withColumn("run", F.col("document") % 10), ["run"])


@query("i03_quality_report", f"""{_O}, t AS (SELECT DISTINCT ticker FROM observations), s AS (SELECT ticker, value, {_STATUS} AS status FROM observations WHERE ticker NOT IN ('T5', 'T6')), g AS (SELECT ticker, count(*) FILTER (status = 'valid') v, count(*) FILTER (status LIKE 'quarantined%') qu, count(*) FILTER (status = 'valid' AND value = 0) z FROM s GROUP BY 1)
SELECT ticker, coalesce(v, 0) AS valid, coalesce(qu, 0) AS quarantined, coalesce(z, 0) AS zero, CASE WHEN v > 0 THEN 'valid' WHEN qu > 0 THEN 'quarantined_only' ELSE 'not_found' END AS class FROM t LEFT JOIN g USING (ticker)""")
def i03(spark, sf):
    o = S.observations(spark, sf)
    return governance.quality_report(evidence.validation_status(o.filter("ticker not in ('T5', 'T6')"), ("value", "year", "source")), o.select("ticker").distinct())


@query("i04_manifest", """WITH a AS (SELECT doc_id, md5(text) h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unlisted' WHEN a.h <> b.h THEN 'mismatch' ELSE 'ok' END AS status FROM a FULL JOIN b USING (doc_id)""")
def i04(spark, sf):
    d = read(spark, sf, "documents")
    a = d.filter("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("h"))
    b = d.filter("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return governance.reconcile_manifest(a, b, "doc_id", "h")


@query("i06_leak_scan", """SELECT doc_id, CASE WHEN contains(text, 'token =') THEN 'token =' WHEN contains(text, 'AKIA') THEN 'AKIA' ELSE '@mail' END AS term FROM documents WHERE contains(text, 'token =') OR contains(text, 'AKIA') OR contains(text, '@mail')""")
def i06(spark, sf):
    return governance.leak_scan(read(spark, sf, "documents"), ["token =", "AKIA", "@mail"]).select("doc_id", "term")


@query("i07_sanitize", """SELECT doc_id, md5(replace(text, 'the ', 'THE ')) AS text FROM documents""")
def i07(spark, sf):
    return governance.sanitize(read(spark, sf, "documents").select("doc_id", "text"), {"the ": "THE "}).withColumn("text", F.md5("text"))


@query("i11_coverage", f"""{_O}, g AS (SELECT ticker, count(*) FILTER (confidence <> 'low') ok, count(*) FILTER (confidence = 'low') r FROM observations GROUP BY 1) SELECT count(*) AS requested, count(*) FILTER (ok > 0) AS with_observations, CAST(sum(r) AS BIGINT) AS rejected, CASE WHEN count(*) FILTER (ok > 0) = count(*) THEN 'complete' ELSE 'partial' END AS status FROM g""")
def i11(spark, sf):
    o = S.observations(spark, sf)
    return governance.coverage(o, o.select("ticker").distinct())
