"""Views over the test tables that stand in for filings, facts, prices, shares, cells and observations.

Company = nation key, sector = region key. Each view has a DataFrame form and the SQL text of the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sales(spark: SparkSession, sf: str, place: bool = False) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("company"))
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    at = [F.struct("_metadata.file_path", "_metadata.row_index").alias("place")] if place else []
    items = _t(spark, sf, "lineitem").select(*at, "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", *[F.col(x).cast("decimal(18,2)").alias(x) for x in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")])
    # both joins are by key, so Spark chooses broadcast or sort-merge by size; orders meet their customers first, so that lines, the larger
    # table, are shuffled once
    return items.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))


_SALES = """sales AS (SELECT CAST(c_nationkey AS INTEGER) company, CAST(o_orderdate AS DATE) d, o_orderstatus, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus,
  CAST(l_extendedprice AS DECIMAL(18,2)) l_extendedprice, CAST(l_discount AS DECIMAL(18,2)) l_discount, CAST(l_tax AS DECIMAL(18,2)) l_tax, CAST(l_quantity AS DECIMAL(18,2)) l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def filings(spark: SparkSession, sf: str, place: bool = False) -> DataFrame:
    """One row per filed account value: company, ref_date, version, statement, code, description, value, order_word, ordinal.

    Lines of one order can share a number, so rows can share an ordinal; with ``place`` the row's place in the stored table follows.
    """
    s = _sales(spark, sf, place)
    code = F.concat(F.when(F.col("l_returnflag") == "A", "1.01").when(F.col("l_returnflag") == "N", "2.01").otherwise("3.01"), F.when(F.col("l_linestatus") == "F", ".01").otherwise(".02"))
    word = F.when(F.col("o_orderstatus") == "F", "ÚLTIMO").when(F.col("o_orderstatus") == "O", "PENÚLTIMO").otherwise("ultimo ")
    return s.select(
        "company", F.last_day(F.add_months(F.trunc("d", "quarter"), 2)).alias("ref_date"), F.col("l_linenumber").cast("int").alias("version"), F.when(F.col("l_returnflag") == "R", "DRE").otherwise("BP").alias("statement"),
        code.alias("code"), F.concat(F.lit("Conta "), (F.col("l_partkey") % 5).cast("string")).alias("description"), F.col("l_extendedprice").alias("value"), word.alias("order_word"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), *(["place"] if place else []),
    )


FILINGS = (
    _SALES
    + """, filings AS (SELECT company, last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE)) ref_date, CAST(l_linenumber AS INTEGER) AS version,
  CASE WHEN l_returnflag = 'R' THEN 'DRE' ELSE 'BP' END AS statement,
  CASE l_returnflag WHEN 'A' THEN '1.01' WHEN 'N' THEN '2.01' ELSE '3.01' END || CASE WHEN l_linestatus = 'F' THEN '.01' ELSE '.02' END code,
  'Conta ' || CAST(l_partkey % 5 AS VARCHAR) description, l_extendedprice AS value,
  CASE o_orderstatus WHEN 'F' THEN 'ÚLTIMO' WHEN 'O' THEN 'PENÚLTIMO' ELSE 'ultimo ' END order_word, l_orderkey * 100 + l_linenumber ordinal FROM sales)"""
)


def quarter_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated quarter: company, year, q, revenue, cost, ebit, da (decimal(38,4)), with some quarters missing."""
    s = _sales(spark, sf).withColumns({"year": F.year("d"), "q": F.quarter("d")})
    p = F.col("l_extendedprice")
    money = {"revenue": F.sum(p), "cost": -F.sum((p * F.col("l_discount")).cast("decimal(18,4)")), "ebit": F.sum((p * F.col("l_tax")).cast("decimal(18,4)")) - F.sum(F.col("l_quantity") * 40), "da": F.sum(F.col("l_quantity"))}
    out = s.groupBy("company", "year", "q").agg(*[v.cast("decimal(38,4)").alias(k) for k, v in money.items()])
    return out.filter((F.col("company") * 7 + F.col("year") * 3 + F.col("q")) % 11 != 0)


QUARTERS = (
    _SALES
    + """, quarter_facts AS (SELECT company, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) q, CAST(sum(l_extendedprice) AS DECIMAL(38,4)) revenue,
  CAST(-sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS cost,
  CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) - sum(l_quantity * 40) AS DECIMAL(38,4)) ebit, CAST(sum(l_quantity) AS DECIMAL(38,4)) da
  FROM sales WHERE (company * 7 + year(d) * 3 + quarter(d)) % 11 <> 0 GROUP BY 1, 2, 3)"""
)


def ytd_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The first quarter isolated and year-to-date sums after it: company, year, q, is_ytd, revenue."""
    so_far = W.partitionBy("company", "year").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    q = quarter_facts(spark, sf)
    return q.select("company", "year", "q", F.sum("revenue").over(so_far).cast("decimal(38,4)").alias("revenue"), (F.col("q") > 1).alias("is_ytd"))


def mixed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """``ytd_facts``, and the isolated row beside the year-to-date one for every other company, as quarterly filings have them."""
    q = quarter_facts(spark, sf).filter("q > 1 and company % 2 = 0").select("company", "year", "q", F.col("revenue"), F.lit(False).alias("is_ytd"))
    return ytd_facts(spark, sf).unionByName(q)


YTD = QUARTERS + """, ytd_facts AS (SELECT a.company, a.year, a.q, a.q > 1 is_ytd, CAST(sum(b.revenue) AS DECIMAL(38,4)) revenue FROM quarter_facts a JOIN quarter_facts b ON a.company = b.company AND a.year = b.year AND b.q <= a.q GROUP BY 1, 2, 3)"""

MIXED = YTD + """, mixed_facts AS (SELECT company, year, q, is_ytd, revenue FROM ytd_facts UNION ALL SELECT company, year, q, false, revenue FROM quarter_facts WHERE q > 1 AND company % 2 = 0)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """company, date, close, adj_close, split_factor (0 = none)."""
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("company"))
    o = _t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("company", F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"), F.min("o_orderkey").alias("k"))
    return g.select("company", "date", "close", (F.col("close") * 0.5).alias("adj_close"), F.when(F.col("k") % 97 == 0, 0.5).when(F.col("k") % 89 == 0, 2.0).otherwise(0.0).alias("split_factor"))


PRICES = """prices AS (SELECT company, date, close, close * 0.5 AS adj_close, CAST(CASE WHEN k % 97 = 0 THEN 0.5 WHEN k % 89 = 0 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS split_factor FROM (
  SELECT CAST(c_nationkey AS INTEGER) company, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close, min(o_orderkey) k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""


_BLOCKED = ("shares_discrepancy", " Missing ", "UNRESOLVED", "blocked", "excluded", "Invalid", "missing_share_class_data", "cvm_scale_ambiguous")


def market_caps(spark: SparkSession, sf: str) -> DataFrame:
    """company, ref_date (quarter ends), market_cap, status, status_market_cap: some blocked by either status, some missing."""
    f = quarter_facts(spark, sf)
    ref = F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1)))
    h = F.col("company") * 13 + F.col("year") + F.col("q") * 5
    blocked = F.element_at(F.array(*map(F.lit, _BLOCKED)), F.col("company") % 8 + 1)
    return f.select(
        "company", ref.alias("ref_date"), F.when(h % 9 == 0, None).otherwise((F.col("revenue") / 10).cast("double")).alias("market_cap"), F.when(h % 7 == 0, blocked).otherwise("validated").alias("status"),
        F.when(h % 11 == 0, " Excluded").alias("status_market_cap"),
    )


MARKET_CAPS = (
    QUARTERS
    + """, market_caps AS (SELECT company, last_day(make_date(year, q * 3, 1)) ref_date, CASE WHEN (company * 13 + year + q * 5) % 9 = 0 THEN NULL ELSE CAST(revenue AS DOUBLE) / 10 END AS market_cap,
  CASE WHEN (company * 13 + year + q * 5) % 7 = 0 THEN (["""
    + ", ".join(f"'{b}'" for b in _BLOCKED)
    + """])[company % 8 + 1] ELSE 'validated' END AS status, CASE WHEN (company * 13 + year + q * 5) % 11 = 0 THEN ' Excluded' END AS status_market_cap FROM quarter_facts)"""
)
#: SQL of the rule for a valid value: positive, and no blocked status in either column.
_STOP = ", ".join(f"'{b.strip().lower()}'" for b in _BLOCKED)
VALID_CAP = f"coalesce(market_cap > 0 AND lower(trim(coalesce(status, ''))) NOT IN ({_STOP}) AND lower(trim(coalesce(status_market_cap, ''))) NOT IN ({_STOP}), false)"


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """company, sector, name: one row per nation."""
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("company"), F.col("n_regionkey").cast("int").alias("sector"), F.col("n_name").alias("name"))


REGISTRY = "registry AS (SELECT CAST(n_nationkey AS INTEGER) company, CAST(n_regionkey AS INTEGER) sector, n_name AS name FROM nation)"


def balances(spark: SparkSession, sf: str) -> DataFrame:
    """company, ref_date, code, description, value: a small account tree by quarter end, with leaves, parents and (for most companies) both totals.

    One aggregation; the rows come from an explode. The totals of even companies differ by 0, 1, 1.0001 or -0.5.
    """
    leaf = lambda code: F.sum(F.when(F.col("code") == code, F.col("value"))).cast("decimal(38,4)")
    g = filings(spark, sf).filter("statement = 'BP'").groupBy("company", "ref_date").agg(leaf("1.01.01").alias("a1"), leaf("1.01.02").alias("a2"), leaf("2.01.01").alias("b1"), leaf("2.01.02").alias("b2"))
    zero = F.lit(0).cast("decimal(38,4)")
    money = lambda x: x.cast("decimal(38,4)")
    both = lambda x, y: F.when(F.coalesce(x, y).isNotNull(), money(F.coalesce(x, zero) + F.coalesce(y, zero)))
    g = g.withColumns({"a": both(F.col("a1"), F.col("a2")), "b": both(F.col("b1"), F.col("b2"))})
    k, month = F.col("company"), F.month("ref_date")
    gap = F.when(month == 3, F.lit("0")).when(month == 6, F.lit("1")).when(month == 9, F.lit("1.0001")).otherwise("-0.5").cast("decimal(38,4)")
    rows = [
        ("1.01.01", "Conta", F.col("a1")), ("1.01.02", "Conta", F.col("a2")), ("2.01.04.01", "Conta", F.col("b1")), ("2.01.04.02", "Conta", F.col("b2")),
        ("1.01", "Grupo", F.when(k % 3 != 0, F.col("a"))), ("2.01.04", "Grupo", F.when(k % 3 != 0, F.col("b"))), ("2.01", "Grupo", F.when(k % 3 != 1, money(F.col("b") + 7))),
        ("1", "Ativo Total", F.when(k % 7 != 3, money(F.col("a") + 100))), ("2", "Passivo Total", F.when(k % 5 != 4, F.when(k % 2 == 0, money(F.col("a") + 100 + gap)).otherwise(money(F.col("b") + 50)))),
        ("2.02.09", "Passivo de Arrendamento", money(F.col("b1") / 10)),
    ]
    made = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(d).alias("description"), v.alias("value")) for c, d, v in rows])
    return g.select("company", "ref_date", F.explode(made).alias("r")).select("company", "ref_date", "r.*").filter("value is not null")


_ROWS = (
    ("1.01.01", "Conta", "a1"), ("1.01.02", "Conta", "a2"), ("2.01.04.01", "Conta", "b1"), ("2.01.04.02", "Conta", "b2"), ("1.01", "Grupo", "CASE WHEN company % 3 <> 0 THEN a END"),
    ("2.01.04", "Grupo", "CASE WHEN company % 3 <> 0 THEN b END"), ("2.01", "Grupo", "CASE WHEN company % 3 <> 1 THEN b + 7 END"), ("1", "Ativo Total", "CASE WHEN company % 7 <> 3 THEN a + 100 END"),
    ("2", "Passivo Total", "CASE WHEN company % 5 <> 4 THEN CASE WHEN company % 2 = 0 THEN a + 100 + CAST(CASE month(ref_date) WHEN 3 THEN '0' WHEN 6 THEN '1' WHEN 9 THEN '1.0001' ELSE '-0.5' END AS DECIMAL(38,4)) ELSE b + 50 END END"),
    ("2.02.09", "Passivo de Arrendamento", "CAST(b1 / 10 AS DECIMAL(38,4))"),
)
BALANCES = (
    FILINGS
    + """, bp AS (SELECT company, ref_date, """
    + ", ".join(f"CAST(sum(value) FILTER (code = '{c}') AS DECIMAL(38,4)) {n}" for c, n in (("1.01.01", "a1"), ("1.01.02", "a2"), ("2.01.01", "b1"), ("2.01.02", "b2")))
    + """ FROM filings WHERE statement = 'BP' GROUP BY 1, 2),
bs AS (SELECT *, CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN coalesce(a1, 0) + coalesce(a2, 0) END a, CASE WHEN b1 IS NOT NULL OR b2 IS NOT NULL THEN coalesce(b1, 0) + coalesce(b2, 0) END b FROM bp),
balances AS (SELECT * FROM ("""
    + " UNION ALL ".join(f"SELECT company, ref_date, '{c}' AS code, '{d}' AS description, CAST({v} AS DECIMAL(38,4)) AS value FROM bs" for c, d, v in _ROWS)
    + """) WHERE value IS NOT NULL)"""
)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, metric, year, q, value, confidence, source, scope, ordinal from events."""
    e = _t(spark, sf, "events")
    ticker = F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string"))
    return e.select(
        ticker.alias("ticker"), F.col("event_type").alias("metric"), (F.lit(2020) + (F.col("event_id") % 4)).cast("int").alias("year"), (F.floor(F.col("event_id") / 4) % 4 + 1).cast("int").alias("q"),
        F.col("value").cast("decimal(18,4)").alias("value"), F.when(F.col("event_id") % 5 == 0, "low").when(F.col("event_id") % 5 < 3, "medium").otherwise("high").alias("confidence"),
        F.when(F.col("event_id") % 3 == 0, "spreadsheet").otherwise("pdf").alias("source"), F.when(F.col("event_id") % 7 == 0, "segment").otherwise("consolidated").alias("scope"), F.col("event_id").alias("ordinal"),
    )


OBSERVATIONS = """observations AS (SELECT 'T' || CAST(user_id % 40 AS VARCHAR) ticker, event_type metric, CAST(2020 + event_id % 4 AS INTEGER) AS year, CAST(CAST(floor(event_id / 4) AS BIGINT) % 4 + 1 AS INTEGER) AS q,
  CAST(value AS DECIMAL(18,4)) AS value, CASE WHEN event_id % 5 = 0 THEN 'low' WHEN event_id % 5 < 3 THEN 'medium' ELSE 'high' END confidence,
  CASE WHEN event_id % 3 = 0 THEN 'spreadsheet' ELSE 'pdf' END AS source, CASE WHEN event_id % 7 = 0 THEN 'segment' ELSE 'consolidated' END AS scope, event_id ordinal FROM events)"""


# states of a document's six events: what each event type stands for at each place
_PLACES = (
    ("discovered", "discovered", "discovered", "accepted", "discovered"),
    ("accepted", "accepted", "accepted", "discovered", "rejected"),
    ("downloaded", "read", "imported", "accepted", "extraction_error"),
    ("converted", "company_resolved", "read", "read", "parsed"),
    ("validated", "parsed", "validated", "archived", "unresolved"),
    ("published", "preserved_existing", "rejected", "published", "read"),
)
_TYPES = ("signup", "view", "click", "purchase", "error")


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """document (six events each), state, at, ordinal, observations_count from events."""
    e = _t(spark, sf, "events")
    kind = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).cast("int")
    names = F.array(*[F.array(*map(F.lit, p)) for p in _PLACES])
    place = (F.col("event_id") % 6).cast("int")
    state = F.element_at(F.element_at(names, place + 1), kind)
    return e.select(F.floor(F.col("event_id") / 6).alias("document"), state.alias("state"), F.floor(F.col("event_id") / 2).alias("at"), F.col("event_id").alias("ordinal"), F.when(place == 4, F.floor("value").cast("long") % 3).alias("observations_count"))


LIFECYCLE = (
    "lifecycle AS (SELECT CAST(floor(event_id / 6) AS BIGINT) AS document, CASE event_id % 6 "
    + " ".join(f"WHEN {i} THEN CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in zip(_TYPES, p)) + " END" for i, p in enumerate(_PLACES))
    + " END AS state, CAST(floor(event_id / 2) AS BIGINT) AS at_ts, event_id AS ordinal, CASE WHEN event_id % 6 = 4 THEN CAST(floor(value) AS BIGINT) % 3 END AS observations_count FROM events)"
)
