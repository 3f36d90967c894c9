"""Financial indicators; every result is null when a part is missing, and ratios are null at a zero base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import norm_text
from fundamentals_spark.operators.accounts import leaves_only, root_or_leaf_sum
from fundamentals_spark.operators.asof import asof

SHORT_DEBT, LONG_DEBT, CASH, INVESTMENTS = "2.01.04", "2.02.01", "1.01.01", "1.01.02"


def lease_accounts(bp: DataFrame, by: list[str], counted: tuple[str, ...] = (SHORT_DEBT, LONG_DEBT)) -> DataFrame:
    """Liability leaves whose description names a lease, outside codes that are already counted."""
    rows = bp.filter(F.col("code").startswith("2") & norm_text(F.col("description"), "fold").rlike(r"\b(arrendamentos?|leasing)\b"))
    for c in counted:
        rows = rows.filter((F.col("code") != c) & ~F.col("code").startswith(c + "."))
    return leaves_only(rows, by)


def net_debt(bp: DataFrame, deduct_investments: bool = True, include_leases: bool = False, codes: dict[str, str] | None = None) -> DataFrame:
    """Short and long debt (and leases) less cash and investments by company and date; no debt or no cash account is an error."""
    c = {"short": SHORT_DEBT, "long": LONG_DEBT, "cash": CASH, "investments": INVESTMENTS} | (codes or {})
    by = ["company", "ref_date"]
    sums = root_or_leaf_sum(bp, list(c.values()), by)
    parts = [F.max(F.when(F.col("root") == code, F.col("value"))).alias(name) for name, code in c.items()]
    g = sums.groupBy(*by).agg(*parts, F.max("error").alias("dup"))
    if include_leases:
        g = g.join(lease_accounts(bp, by).groupBy(*by).agg(F.sum("value").alias("leases")), by, "left")
    else:
        g = g.withColumn("leases", F.lit(None).cast("decimal(38,4)"))
    zero = F.lit(0).cast("decimal(38,4)")
    error = F.when(F.col("dup").isNotNull(), F.col("dup")).when(F.col("short").isNull() & F.col("long").isNull(), "no_debt_account").when(F.col("cash").isNull(), "no_cash_account")
    deducted = F.coalesce("investments", zero) if deduct_investments else zero
    value = F.coalesce("short", zero) + F.coalesce("long", zero) + F.coalesce("leases", zero) - F.col("cash") - deducted
    return g.withColumns({"deducted": deducted, "error": error, "net_debt": F.when(error.isNull(), value)}).drop("dup")


# Accounts of each part of the net debt where a company has no rule of its own.
DEBT_CODES = {"short": (SHORT_DEBT,), "long": (LONG_DEBT,), "cash": (CASH,), "investments": (INVESTMENTS,)}


def _debt_rows(bp: DataFrame, codes: DataFrame | None) -> DataFrame:
    """Counted rows of ``bp`` with their part: of every (part, code) of the company the account itself, else its leaves.

    ``codes``: company, part, code. A company's codes of a part replace the default ones of that part.
    """
    default = F.create_map(*[x for k, v in DEBT_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    by = ["company", "ref_date", "part", "root"]
    rows = bp.select("company", "ref_date", "code", "description", "value")
    if codes is None:
        rows = rows.withColumn("__own", F.lit(None).cast("map<string,array<string>>"))
    else:
        lists = codes.dropna(subset=["company", "part", "code"]).groupBy("company", "part").agg(F.array_sort(F.collect_set(F.trim("code"))).alias("c"))
        own = lists.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("__own"))
        rows = rows.join(own, "company", "left")

    def of(part: str) -> Column:
        codes = F.coalesce(F.try_element_at("__own", F.lit(part)), F.element_at(default, F.lit(part)))
        return F.transform(codes, lambda c: F.struct(F.lit(part).alias("part"), c.alias("root")))

    wanted = F.flatten(F.array(*[of(k) for k in DEBT_CODES]))
    near = F.filter(wanted, lambda w: (F.col("code") == w["root"]) | F.col("code").startswith(F.concat(w["root"], F.lit("."))))
    at = rows.withColumn("__w", F.explode(near)).select("company", "ref_date", "code", "description", "value", "__w.part", "__w.root")
    has_root = F.max(F.col("code") == F.col("root")).over(W.partitionBy(*by))
    at = at.withColumn("__has", has_root)
    exact = at.filter("code = root")
    below = leaves_only(at.filter("not __has"), by)
    return exact.unionByName(below).drop("__has")


def net_debt_by_company(bp: DataFrame, codes: DataFrame | None = None, options: DataFrame | None = None, deduct_investments: bool = True, include_leases: bool = False) -> tuple[DataFrame, DataFrame]:
    """(net debt, audit rows) by company and date under rules of each company.

    ``codes``: company, part (short, long, cash, investments), code - several codes of a part are added up. ``options``:
    company, deduct_investments, include_leases; one row a company, null or absent: the given default. The first table has
    every component, the options applied and an error (duplicate_root, no_debt_account, no_cash_account) in place of a value;
    the second the counted accounts: company, ref_date, part, code, description, value. Leases are leaves outside counted debt accounts.
    """
    key = ["company", "ref_date"]
    rows = _debt_rows(bp, codes)
    flags = {"deduct_investments": deduct_investments, "include_leases": include_leases}
    chosen = bp.select("company").distinct()
    if options is not None:
        chosen = chosen.join(options.groupBy("company").agg(*[F.max(f).alias(f) for f in flags]), "company", "left")
    chosen = chosen.select("company", *[(F.coalesce(f, F.lit(v)) if options is not None else F.lit(v)).alias(f) for f, v in flags.items()])
    lease = bp.filter(F.col("code").startswith("2.") & norm_text(F.col("description"), "fold").rlike(r"\b(arrendamentos?|leasing)\b"))
    lease = lease.join(rows.filter("part in ('short', 'long')").select(*key, "code").distinct(), key + ["code"], "left_anti")
    lease = leaves_only(lease, key).join(chosen.filter("include_leases").select("company"), "company", "left_semi")
    audit = rows.select(*key, "part", "code", "description", "value").unionByName(lease.select(*key, F.lit("leases").alias("part"), "code", "description", "value"))
    twice = rows.filter("code = root").groupBy(*key, "part", "root").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg((F.max("n") > 1).alias("dup"))
    parts = [*DEBT_CODES, "leases"]
    sums = audit.groupBy(*key).agg(*[F.sum(F.when(F.col("part") == p, F.col("value"))).cast("decimal(38,4)").alias(p) for p in parts])
    g = bp.select(*key).distinct().join(sums, key, "left").join(twice, key, "left").join(chosen, "company")
    zero = F.lit(0).cast("decimal(38,4)")
    error = F.when(F.col("dup"), "duplicate_root").when(F.col("short").isNull() & F.col("long").isNull(), "no_debt_account").when(F.col("cash").isNull(), "no_cash_account")
    gross = F.coalesce("short", zero) + F.coalesce("long", zero) + F.coalesce("leases", zero)
    deducted = F.when(F.col("deduct_investments"), F.coalesce("investments", zero)).otherwise(zero)
    out = g.withColumns({"gross_debt": gross, "deducted": deducted, "error": error, "net_debt": F.when(error.isNull(), gross - F.col("cash") - deducted)}).drop("dup")
    return out, audit


def ltm(df: DataFrame, metric: str, by: list[str], n: int = 4) -> DataFrame:
    """Sum of n consecutive quarters that end at the row; null unless all are there. One row for each key and quarter."""
    w = W.partitionBy(*by).orderBy(F.col("year") * 4 + F.col("q")).rangeBetween(-(n - 1), 0)
    full = F.count(metric).over(w) == n
    return df.withColumns({f"{metric}_ltm": F.when(full, F.sum(metric).over(w)), "complete": full})


def margins(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """EBITDA = EBIT + D&A and margins in percent of revenue; the net margin where there is a column net_income.

    ``rules``: company, ifrs17. Companies under IFRS 17 have no comparable revenue: their margins are null and the flag says so.
    """
    out = df.withColumns({"ebitda": F.col("ebit") + F.col("da"), "gross": F.col("revenue") + F.col("cost")})
    ifrs17 = F.lit(False)
    if rules is not None:
        out = out.join(rules.select("company", F.col("ifrs17").alias("__ifrs17")).distinct(), "company", "left")
        ifrs17 = F.coalesce("__ifrs17", F.lit(False))
    pct = lambda x: F.when(~ifrs17, F.try_divide(F.col(x).cast("double") * 100, F.nullif(F.col("revenue").cast("double"), F.lit(0.0))))
    made = {"gross_margin": pct("gross"), "operating_margin": pct("ebit"), "ebitda_margin": pct("ebitda"), "margin_flag": F.when(ifrs17, "not_comparable")}
    if "net_income" in df.columns:
        made["net_margin"] = pct("net_income")
    return out.withColumns(made).drop("__ifrs17")


def cagr(df: DataFrame, value: str, by: list[str], n: int = 5) -> DataFrame:
    """(last / first) ** (1 / years) - 1 in percent over the last n annual rows; null with fewer than two or an end <= 0."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.col("year").desc()))
    last = df.withColumn("__rank", r).filter(F.col("__rank") <= n)
    g = last.groupBy(*by).agg(F.min_by(value, "year").cast("double").alias("a"), F.max_by(value, "year").cast("double").alias("b"), F.count(F.lit(1)).alias("points"))
    ok = (F.col("points") >= 2) & (F.col("a") > 0) & (F.col("b") > 0)
    return g.select(*by, "points", F.when(ok, (F.pow(F.try_divide(F.col("b"), F.nullif(F.col("a"), F.lit(0.0))), F.try_divide(F.lit(1.0), F.nullif(F.col("points") - 1, F.lit(0)))) - 1) * 100).alias("cagr"))


def cagr_periods(df: DataFrame, values: list[str], by: list[str], n: int = 5) -> DataFrame:
    """Growth of several values over the last n annual rows, or over the last n rows where fewer than two are annual.

    ``df``: by, year, q, is_ytd (annual: year-to-date fourth quarters). Every row counts as one interval. Null with fewer than
    two rows, an end of 0 or less, or - but for the first value - a missing value in between.
    """
    annual = F.coalesce(F.col("is_ytd") & (F.col("q") == 4), F.lit(False))
    rows = df.withColumn("__annual", annual).withColumn("__many", F.count_if("__annual").over(W.partitionBy(*by)) >= 2).filter("__annual or not __many")
    order = [F.col("year"), F.col("q"), F.col("is_ytd")]
    rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*[c.desc() for c in order]))).filter(F.col("__r") <= n)
    ends = [F.min_by(v, F.struct(*order)).cast("double").alias(f"a_{v}") for v in values] + [F.max_by(v, F.struct(*order)).cast("double").alias(f"b_{v}") for v in values]
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.max("__many").alias("annual"), *ends, *[F.count(v).alias(f"n_{v}") for v in values])

    def rate(v: str, gaps: bool) -> Column:
        ok = (F.col("points") >= 2) & (F.col(f"a_{v}") > 0) & (F.col(f"b_{v}") > 0)
        ok = ok if gaps else ok & (F.col(f"n_{v}") == F.col("points"))
        ratio, years = F.try_divide(F.col(f"b_{v}"), F.nullif(F.col(f"a_{v}"), F.lit(0.0))), F.nullif(F.col("points") - 1, F.lit(0))
        return F.when(ok, (F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1) * 100)

    return g.select(*by, "points", "annual", *[rate(v, i == 0).alias(f"cagr_{v}") for i, v in enumerate(values)])


def cagr_years(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Growth from the first to the last row by their distance in calendar years; null with a distance or an end of 0 or less. ``df``: by, year, one row a year."""
    ends = [f(v, "year").cast("double").alias(f"{p}_{v}") for v in values for f, p in ((F.min_by, "a"), (F.max_by, "b"))]
    g = df.groupBy(*by).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), *ends)
    years = F.nullif(F.col("last_year") - F.col("first_year"), F.lit(0))

    def rate(v: str) -> Column:
        ok = (F.col(f"a_{v}") > 0) & (F.col(f"b_{v}") > 0) & years.isNotNull()
        return F.when(ok, (F.pow(F.try_divide(F.col(f"b_{v}"), F.nullif(F.col(f"a_{v}"), F.lit(0.0))), F.try_divide(F.lit(1.0), years)) - 1) * 100)

    return g.select(*by, "first_year", "last_year", *[rate(v).alias(f"cagr_{v}") for v in values])


def working_capital(bp: DataFrame, revenue: DataFrame | None = None) -> DataFrame:
    """Current assets (1.01) less current liabilities (2.01) on dates that have both; in percent of ``revenue`` (company, ref_date, revenue) if given."""
    part = lambda c: F.max(F.when(F.col("code") == c, F.col("value")))
    g = bp.filter("code in ('1.01', '2.01')").groupBy("company", "ref_date").agg(part("1.01").alias("assets"), part("2.01").alias("liabilities"))
    out = g.filter("assets is not null and liabilities is not null").withColumn("working_capital", F.col("assets") - F.col("liabilities"))
    if revenue is None:
        return out
    j = out.join(revenue.select("company", "ref_date", "revenue"), ["company", "ref_date"], "left")
    return j.withColumn("pct_of_revenue", F.try_divide(F.col("working_capital").cast("double") * 100, F.nullif(F.col("revenue").cast("double"), F.lit(0.0))))


def enterprise_value(caps: DataFrame, debt: DataFrame) -> DataFrame:
    """Market value plus net debt where both exist on the same date; a blocked market value gives none."""
    ok = caps.filter("market_cap is not null and status = 'validated'").select("company", "ref_date", "market_cap")
    return ok.join(debt.filter("net_debt is not null").select("company", "ref_date", "net_debt"), ["company", "ref_date"]).withColumn("ev", F.col("market_cap") + F.col("net_debt").cast("double"))


def ev_ebitda(ev: DataFrame, ebitda: DataFrame) -> DataFrame:
    """EV over rolling EBITDA, null with a flag at null or zero."""
    j = ev.join(ebitda, ["company", "ref_date"], "left")
    e = F.nullif(F.col("ebitda_ltm").cast("double"), F.lit(0.0))
    return j.withColumns({"ev_ebitda": F.try_divide("ev", e), "flag": F.when(e.isNull(), "incomplete")})


def cash_cycle(bp: DataFrame, flows: DataFrame) -> DataFrame:
    """Days receivable, inventory, payable and cycle from average opening and closing balances; errors as rows.

    ``bp``: company, ref_date, receivables, inventories, payables. ``flows``: company, start, end, revenue, cogs.
    The opening balance is the last one before the start, the closing one the last on or before the end.
    """
    cols = ["receivables", "inventories", "payables"]
    f = flows.withColumns({"days": F.datediff("end", "start") + 1, "before": F.date_sub("start", 1)})
    f = asof(f, bp, ["company"], "before", "ref_date", cols, prefix="open_")
    f = asof(f, bp, ["company"], "end", "ref_date", cols, prefix="close_")
    cogs = F.abs("cogs")
    avg = {c: (F.col(f"open_{c}") + F.col(f"close_{c}")).cast("double") / 2 for c in cols}
    purchases = (cogs + F.col("close_inventories") - F.col("open_inventories")).cast("double")
    bases = {"receivables": F.col("revenue").cast("double"), "inventories": cogs.cast("double"), "payables": purchases}
    missing = avg["receivables"].isNull() | avg["inventories"].isNull() | avg["payables"].isNull()
    error = F.when(missing, "missing_balance").when((bases["receivables"] <= 0) | (bases["inventories"] <= 0) | (bases["payables"] <= 0) | bases["receivables"].isNull() | bases["inventories"].isNull(), "invalid_denominator")
    days = {c: F.when(error.isNull(), F.round(F.try_divide(avg[c], bases[c]) * F.col("days"), 4)) for c in cols}
    out = f.select("company", "start", "end", "days", days["receivables"].alias("pmr"), days["inventories"].alias("pme"), days["payables"].alias("pmp"), error.alias("error"))
    return out.withColumn("cycle", F.round(F.col("pmr") + F.col("pme") - F.col("pmp"), 4))


def horizontal(facts: DataFrame, by: list[str], period: str, value: str, mode: str = "adjacent") -> DataFrame:
    """Change in percent against the same account, (current / base - 1) * 100; null at zero or absent bases.

    The base is the account's value in the period before (of all periods of the company) in mode ``adjacent``, in the last
    period that has the account in mode ``last_seen``. One row for each key and period.
    """
    own = W.partitionBy(*by).orderBy(period)
    if mode == "adjacent":
        r = facts.withColumn("__n", F.dense_rank().over(W.partitionBy(by[0]).orderBy(period)))
        base = F.when(F.lag("__n").over(own) == F.col("__n") - 1, F.lag(value).over(own))
    else:
        r, base = facts, F.lag(value).over(own)
    base = F.nullif(base.cast("double"), F.lit(0.0))
    return r.withColumn("horizontal", (F.try_divide(F.col(value).cast("double"), base) - 1) * 100).drop("__n")


def vertical(facts: DataFrame, by: list[str], value: str, code: str = "code", description: str | None = None) -> DataFrame:
    """Percent of the total of its side in the same period: account 1 for assets, 2 for liabilities, 3.01 (revenue) for income
    accounts; null at zero or absent totals. Without a row of code 1 or 2 a row described as that total serves."""
    w = W.partitionBy(*by)
    side = F.substring_index(F.col(code), ".", 1)

    def total(root: str, names: tuple[str, ...]) -> Column:
        own = F.max(F.when(F.col(code) == root, F.col(value))).over(w)
        if description is None or not names:
            return own
        return F.coalesce(own, F.max(F.when(norm_text(F.col(description), "fold").isin(*names), F.col(value))).over(w))

    # fixed values: descriptions of the totals
    base = F.when(side == "1", total("1", ("ativo total",))).when(side == "2", total("2", ("passivo total", "passivo e patrimonio liquido"))).when(side == "3", total("3.01", ()))
    return facts.withColumn("vertical", F.try_divide(F.col(value).cast("double") * 100, F.nullif(base.cast("double"), F.lit(0.0))))


def reconcile(df: DataFrame, match: float = 0.01, review: float = 0.05) -> DataFrame:
    """official against disclosed: MATCH, IMMATERIAL, MATERIAL, METHODOLOGY, MISSING, NOT_COMPARABLE."""
    diff = F.try_divide(F.abs(F.col("disclosed") - F.col("official")).cast("double"), F.abs(F.nullif(F.col("official"), F.lit(0))).cast("double"))
    status = (
        F.when(F.col("official").isNull() | F.col("disclosed").isNull(), "MISSING").when(F.col("official") == 0, "NOT_COMPARABLE").when(F.col("methodology"), "METHODOLOGY")
        .when(diff <= match, "MATCH").when(diff <= review, "IMMATERIAL").otherwise("MATERIAL")
    )
    return df.withColumns({"difference": diff, "status": status})


# Metrics that every period's reconciliation lists.
CRITICAL_METRICS = (
    "receita_contabil_cvm", "receita_operacional_divulgada", "ebitda_contabil", "ebitda_ajustado_divulgado", "lucro_liquido", "divida_liquida_padronizada", "divida_liquida_divulgada", "market_cap_historico",
    "enterprise_value", "ev_ebitda_ltm",
)


def reconciliation_rows(periods: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key and critical metric (value, validated or MISSING_DATA), and one of accounting against disclosed
    adjusted EBITDA: METHODOLOGY_DIFFERENCE, NOT_COMPARABLE at zero, MISSING_DATA. Metrics that ``periods`` lacks are missing."""
    have = lambda m: F.col(m).cast("double") if m in periods.columns else F.lit(None).cast("double")
    official, disclosed = have("ebitda_contabil"), have("ebitda_ajustado_divulgado")
    none = F.lit(None).cast("double")
    row = lambda m, v, d, c: F.struct(F.lit(m).alias("metric"), v.alias("value"), d.alias("difference"), c.alias("classification"))
    rows = [row(m, have(m), none, F.when(have(m).isNull(), "MISSING_DATA").otherwise("validated")) for m in CRITICAL_METRICS]
    both = F.when(official.isNull() | disclosed.isNull(), "MISSING_DATA").when(official == 0, "NOT_COMPARABLE").otherwise("METHODOLOGY_DIFFERENCE")
    rows.append(row("ebitda_contabil_vs_ajustado", disclosed, disclosed - official, both))
    return periods.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.*")


def depreciation(dfc: DataFrame, periods: DataFrame) -> DataFrame:
    """|D&A| per period: synthetic rows where the company has any, else all candidate rows; a missing isolated quarter is
    year-to-date less the quarters before (a missing one counts as 0). ``dfc``: company, year, q, is_ytd, synthetic, value; ``periods``: company, year, q."""
    any_syn = F.max("synthetic").over(W.partitionBy("company"))
    rows = dfc.withColumn("__s", any_syn).filter("synthetic or not __s")
    g = rows.groupBy("company", "year", "q", "is_ytd").agg(F.abs(F.sum("value")).alias("v"))
    iso = g.filter("not is_ytd").select("company", "year", "q", F.col("v").alias("isolated"))
    ytd = g.filter("is_ytd").select("company", "year", "q", F.col("v").alias("ytd"))
    before = g.filter("is_ytd or q = 1").groupBy("company", "year", (F.col("q") + 1).alias("q")).agg(F.max("v").alias("prev"))
    j = periods.join(iso, ["company", "year", "q"], "left").join(ytd, ["company", "year", "q"], "left").join(before, ["company", "year", "q"], "left")
    zero = F.lit(0).cast("decimal(38,4)")
    return j.select("company", "year", "q", F.coalesce("isolated", F.abs(F.col("ytd") - F.coalesce("prev", zero))).alias("da"), F.when(F.col("isolated").isNotNull(), "isolated").when(F.col("ytd").isNotNull(), "ytd_difference").otherwise("missing").alias("source"))


def depreciation_ladder(df: DataFrame) -> DataFrame:
    """First of: explicit field, DVA line, the single combined line, the single candidate; several candidates are an error."""
    few = F.col("candidates").isNull() | (F.size("candidates") <= 1)
    value = F.coalesce("explicit", "dva", "combined", F.when(few, F.try_element_at("candidates", F.lit(1))))
    return df.withColumns({"da": F.abs(value), "error": F.when(value.isNull() & ~few, "ambiguous_candidates")})


def account_value(df: DataFrame, code: str, by: list[str], required: bool = False) -> DataFrame:
    """Value of exactly one row with the code per key: none gives null (or an error if required), several an error."""
    hit = F.col("code") == code
    g = df.groupBy(*by).agg(F.count_if(hit).alias("n"), F.max(F.when(hit, F.col("value"))).alias("v"))
    return g.select(*by, F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") > 1, "duplicate_account").when((F.col("n") == 0) & F.lit(required), "missing_account").alias("error"))


def match_accounts(bp: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each rule (kind, codes array, pattern, excluded): exact codes where the key has any, else description matches. Rules are rows of fixed size."""
    t = norm_text(F.col("description"), "fold")
    j = bp.join(F.broadcast(rules), F.array_contains("codes", F.col("code")) | (F.regexp_like(t, F.col("pattern")) & ~F.coalesce(F.regexp_like(t, F.col("excluded")), F.lit(False))))
    j = j.withColumn("exact", F.array_contains("codes", F.col("code")))
    has = F.max("exact").over(W.partitionBy(*by, "kind"))
    return j.withColumn("__h", has).filter("exact or not __h").drop("__h", "codes", "pattern", "excluded")


def augment_income_statement(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """``facts`` (company, ref_date, code, description, value) with derived lines (after, description, value), each right after its account; rows carry their place."""
    a = facts.withColumns({"anchor": F.col("code"), "step": F.lit(0), "derived": F.lit(False)})
    b = lines.select("company", "ref_date", F.lit(None).cast("string").alias("code"), "description", "value", F.col("after").alias("anchor"), F.lit(1).alias("step"), F.lit(True).alias("derived"))
    out = a.unionByName(b)
    place = F.row_number().over(W.partitionBy("company", "ref_date").orderBy("anchor", "step", "description", "value"))
    sign = F.when(F.max(F.col("value") > 0).over(W.partitionBy("company", "anchor", "step")), F.when(F.max(F.col("value") < 0).over(W.partitionBy("company", "anchor", "step")), "=").otherwise("+")).otherwise("-")
    return out.withColumns({"place": place, "sign": sign})


def deduction_ratio(obs: DataFrame) -> DataFrame:
    """Disallowance over gross revenue in percent, by ticker and period."""
    g = obs.groupBy("ticker", "year", "q").agg(F.max(F.when(F.col("metric") == "disallowance", F.col("value"))).alias("a"), F.max(F.when(F.col("metric") == "gross_revenue", F.col("value"))).alias("b"))
    return g.select("ticker", "year", "q", (F.try_divide(F.col("a").cast("double"), F.nullif(F.col("b").cast("double"), F.lit(0.0))) * 100).alias("ratio"))


def company_summary(registry: DataFrame, debt: DataFrame, capital: DataFrame, annual: DataFrame, caps: DataFrame) -> DataFrame:
    """Latest net debt, working capital and market value, last annual EBITDA and EV over it, per company."""
    d = debt.filter("net_debt is not null").groupBy("company").agg(F.max_by("net_debt", "ref_date").cast("double").alias("net_debt"))
    w = capital.groupBy("company").agg(F.max_by("working_capital", "ref_date").cast("double").alias("working_capital"))
    e = annual.groupBy("company").agg(F.max_by("ebitda", "year").cast("double").alias("ebitda"))
    c = caps.filter("market_cap is not null").groupBy("company").agg(F.max_by("market_cap", "ref_date").alias("market_cap"))
    j = registry.select("company").join(d, "company", "left").join(w, "company", "left").join(e, "company", "left").join(c, "company", "left")
    return j.withColumn("ev_ebitda_last_annual", F.try_divide(F.col("market_cap") + F.col("net_debt"), F.nullif(F.col("ebitda"), F.lit(0.0))))


def flags(*rules: tuple[Column, str, str, str]) -> Column:
    """Array of (metric, status, message) structs for the rules whose condition holds."""
    made = F.array(*[F.when(c, F.struct(F.lit(m).alias("metric"), F.lit(s).alias("status"), F.lit(t).alias("message"))) for c, m, s, t in rules])
    return F.filter(made, lambda x: x.isNotNull())


def cash_cycle_records(balances: DataFrame, flows: DataFrame, target_end: Column) -> DataFrame:
    """The cycle from flat records at one end date: the longest flow ending there, opening = latest balance before its start,
    closing = the balance of exactly the end. Same columns as ``cash_cycle``; a missing closing balance is an error."""
    longest = flows.filter(F.col("end") == target_end).groupBy("company").agg(F.min_by(F.struct("start", "end", "revenue", "cogs"), "start").alias("f")).select("company", "f.*")
    kept = longest.select("company", F.col("start").alias("__s"), F.col("end").alias("__e"))
    usable = balances.join(kept, "company").filter("ref_date < __s or ref_date = __e").drop("__s", "__e")
    exact = usable.filter(F.col("ref_date") == target_end).select("company").distinct()
    out = cash_cycle(usable, longest).join(exact.withColumn("__closing", F.lit(True)), "company", "left")
    no = F.col("__closing").isNull()
    return out.select("company", "start", "end", "days", *[F.when(~no, F.col(c)).alias(c) for c in ("pmr", "pme", "pmp")], F.when(no, "missing_balance").otherwise(F.col("error")).alias("error"), F.when(~no, F.col("cycle")).alias("cycle"))
