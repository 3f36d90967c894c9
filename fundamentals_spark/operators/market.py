"""Prices, shares, market values and sector aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.operators.asof import asof, best_row

MAX_STALE, CAP_STALE, HORIZONS, MIN_COVERAGE = 7, 120, (30, 90, 360), 0.70


def price_as_of(prices: DataFrame, dates: DataFrame, max_stale: int = MAX_STALE) -> DataFrame:
    """Last close on or before each (company, at), times every split factor after that trading day (0 counts as 1), rounded to 6."""
    factor = F.when(F.col("split_factor") > 0, F.col("split_factor")).otherwise(1.0)
    later = W.partitionBy("company").orderBy("date").rowsBetween(1, W.unboundedFollowing)
    p = prices.withColumn("future", F.coalesce(F.product(factor).over(later), F.lit(1.0)))
    return asof(dates, p, ["company"], "at", "date", ["close", "future"], max_stale).select("company", "at", "date", F.round(F.col("close") * F.col("future"), 6).alias("price"))


def adjusted_price_as_of(prices: DataFrame, dates: DataFrame, max_stale: int | None = MAX_STALE) -> DataFrame:
    return asof(dates, prices, ["company"], "at", "date", ["adj_close"], max_stale)


def shares_as_of(shares: DataFrame, dates: DataFrame) -> DataFrame:
    return asof(dates, shares, ["company"], "at", "date", ["shares"])


def _closest_scale() -> Column:
    """struct<gap, scale> of the scale in {1, 1000} that brings ``official`` closest to ``market``; the gap is a share of the scaled filed count."""

    def at(s: int) -> Column:
        filed = (F.col("official") * s).cast("double")
        return F.struct((F.abs(F.col("market") - filed) / F.nullif(filed, F.lit(0.0))).alias("gap"), F.lit(s).alias("scale"))

    return F.when((F.col("market") > 0) & (F.col("official") > 0), F.array_min(F.array(at(1), at(1000))))


def infer_share_scale(df: DataFrame, tol: float = 0.05) -> DataFrame:
    """Per row the scale of {1, 1000} that brings ``official`` closest to ``market``, within ``tol`` of the filed count, and per company the scale that all accepted rows agree on."""
    best = _closest_scale()
    out = df.withColumn("scale", F.when(best["gap"] <= tol, best["scale"]))
    w = W.partitionBy("company")
    return out.withColumn("proven", F.when(F.min("scale").over(w) == F.max("scale").over(w), F.min("scale").over(w)))


def validate_shares(df: DataFrame, tol: float = 0.05) -> DataFrame:
    """``df``: market, official, proven. Quantity, its source, difference in percent of the scaled filed count, and status; counts of 0 or less are missing."""
    best = _closest_scale()
    have_m, have_o = F.coalesce(F.col("market") > 0, F.lit(False)), F.coalesce(F.col("official") > 0, F.lit(False))
    status = (
        F.when(have_m & have_o, F.when(best["gap"] <= tol, "validated").otherwise("shares_discrepancy"))
        .when(have_m, "yahoo_only").when(have_o & F.col("proven").isNotNull(), "cvm_fallback_validated_scale").when(have_o, "cvm_scale_ambiguous").otherwise("missing")
    )
    quantity = F.when(status.isin("validated", "yahoo_only"), F.col("market")).when(status == "cvm_fallback_validated_scale", F.col("official") * F.col("proven"))
    source = F.when(status.isin("validated", "yahoo_only"), "market").when(status == "cvm_fallback_validated_scale", "filed")
    return df.withColumns({"status": status, "quantity": quantity, "quantity_source": source, "difference_pct": F.round(best["gap"] * 100, 6)})


def class_market_cap(classes: DataFrame, by: list[str]) -> DataFrame:
    """Sum of price x quantity x weight over share classes; null if any class lacks a part or has no positive weight."""
    bad = F.col("price").isNull() | F.col("quantity").isNull() | F.coalesce(F.col("weight") <= 0, F.lit(True))
    return classes.groupBy(*by).agg(F.when(F.count_if(bad) == 0, F.sum(F.col("price") * F.col("quantity") * F.col("weight"))).alias("market_cap"), F.count_if(bad).alias("invalid"))


def merge_alias_series(prices: DataFrame) -> DataFrame:
    """One price a day for each company: positive prices, the symbol with the lowest priority number first."""
    return best_row(prices.filter("adj_close > 0"), ["company", "date"], [F.col("priority"), F.col("symbol")])


def price_variation(series: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Last price against the last one on or before (last date - n days), in percent."""
    last = series.groupBy("company").agg(F.max("date").alias("last_date"), F.max_by("adj_close", "date").alias("last_price"))
    spine = last.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("at", F.expr("date_sub(last_date, horizon)"))
    j = asof(spine, series, ["company"], "at", "date", ["adj_close"])
    return j.select("company", "horizon", "last_date", F.col("date").alias("base_date"), ((F.try_divide(F.col("last_price"), F.nullif(F.col("adj_close"), F.lit(0.0))) - 1) * 100).alias("change_pct"))


# Statuses that block a market value.
BLOCKED = ("blocked", "excluded", "invalid", "missing", "missing_share_class_data", "shares_discrepancy", "cvm_scale_ambiguous", "unresolved")


def is_valid_market_cap(cap: Column, *statuses: Column) -> Column:
    """Positive, finite, and none of the status columns (trimmed, without case) holds a blocked status."""
    blocked = F.exists(F.array(*[F.lower(F.trim(F.coalesce(s, F.lit("")))) for s in statuses]), lambda s: s.isin(*BLOCKED)) if statuses else F.lit(False)
    return F.coalesce((cap > 0) & (cap < float("inf")) & ~blocked, F.lit(False))


#: Status columns of market values; those that a table has are looked at.
STATUS_FIELDS = ("status", "status_market_cap", "status_validacao_acoes", "status_validacao_market_cap")


def valid_cap(df: DataFrame) -> Column:
    """``is_valid_market_cap`` over the value and the status columns that ``df`` has."""
    return is_valid_market_cap(F.col("market_cap"), *[F.col(c) for c in STATUS_FIELDS if c in df.columns])


def market_cap_share(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Share of the sector's valid values in percent; invalid ones stay as rows with a reason.

    With a ``registry`` (sector, company) every registered company has a row on every date of its sector, and coverage is
    valid / registered; without one it is valid / rows. Where no value is valid there is no share.
    """
    if registry is not None:
        spine = df.select("sector", "ref_date").distinct().join(registry.select("sector", "company").distinct(), "sector")
        df = spine.join(df, ["sector", "ref_date", "company"], "left")
    ok = valid_cap(df)
    w = W.partitionBy("sector", "ref_date")
    total = F.sum(F.when(ok, F.col("market_cap"))).over(w)
    blocked = F.try_element_at(F.filter(F.array(*[F.lower(F.trim(F.col(c))) for c in STATUS_FIELDS if c in df.columns]), lambda s: s.isin(*BLOCKED)), F.lit(1)) if set(STATUS_FIELDS) & set(df.columns) else F.lit(None)
    return df.withColumns({
        "share_pct": F.when(ok & (total > 0), F.col("market_cap") / total * 100), "reason": F.when(~ok, F.when(F.col("market_cap").isNull(), "missing").when(F.col("market_cap") <= 0, "not_positive").otherwise(blocked)),
        "coverage": F.count_if(ok).over(w) / F.count(F.lit(1)).over(w),
    })


def sector_ev_ebitda(df: DataFrame) -> DataFrame:
    """Sum of EV over sum of rolling EBITDA for companies with both; null if the latter is not positive.

    included and excluded count companies; excluded_reasons lists (company, reason) of those left out, where there is a
    column company; diagnostics names what kept the multiple away.
    """
    both = F.col("ev").isNotNull() & F.col("ebitda_ltm").isNotNull()
    why = F.when(F.col("ev").isNull(), "missing_enterprise_value").when(F.col("ebitda_ltm").isNull(), "missing_ebitda_ltm")
    lists = [F.sort_array(F.collect_list(F.when(~both, F.struct("company", why.alias("reason"))))).alias("excluded_reasons")] if "company" in df.columns else []
    g = df.groupBy("sector", "ref_date").agg(F.sum(F.when(both, F.col("ev"))).alias("ev"), F.sum(F.when(both, F.col("ebitda_ltm"))).cast("double").alias("ebitda"), F.count_if(both).alias("included"), F.count_if(~both).alias("excluded"), *lists)
    return g.withColumns({"ev_ebitda": F.when(F.col("ebitda") > 0, F.try_divide("ev", F.nullif(F.col("ebitda"), F.lit(0.0)))), "diagnostics": F.when(F.col("included") == 0, "no_valid_company").when(F.col("ebitda") <= 0, "non_positive_ebitda")})


def sector_returns(caps: DataFrame, prices: DataFrame, registry: DataFrame, dates: DataFrame, horizons: tuple[int, ...] = HORIZONS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Weighted returns by sector, reference date and horizon.

    ``dates``: sector, ref_date. For every registered company: weight = last valid market value at the start (<= 120 days
    old), return = adjusted price at the reference over the one at the start (each <= 7 days old). A return needs both
    coverages of at least ``min_coverage``; value coverage is unknown (null, not checked) if any company's start value is.
    excluded lists (company, reason); the gaps are the greatest distances in days between wanted and found dates of those included.
    """
    spine = dates.join(registry.select("sector", "company"), "sector").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("start", F.expr("date_sub(ref_date, horizon)"))
    valid = caps.filter(valid_cap(caps)).select("company", F.col("ref_date").alias("cap_date"), "market_cap")
    s = asof(spine, valid, ["company"], "start", "cap_date", ["market_cap"], CAP_STALE)
    series = prices.filter("adj_close > 0").select("company", "date", "adj_close")
    s = asof(s, series, ["company"], "start", "date", ["adj_close"], MAX_STALE, "a_")
    s = asof(s, series, ["company"], "ref_date", "date", ["adj_close"], MAX_STALE, "b_")
    r = F.try_divide("b_adj_close", "a_adj_close") - 1
    s = s.withColumn("r", F.when(F.col("market_cap").isNotNull(), r))
    used = F.col("r").isNotNull()
    weight = F.sum(F.when(used, F.col("market_cap")))
    why = F.when(F.col("market_cap").isNull(), "no_valid_market_cap").when(~used, "no_recent_price")
    gap = lambda want, found: F.max(F.when(used, F.datediff(want, found)))
    g = s.groupBy("sector", "ref_date", "horizon").agg(
        F.count(F.lit(1)).alias("registered"), F.count_if(used).alias("included"), weight.alias("used_cap"), F.sum("market_cap").alias("all_cap"), F.count_if(F.col("market_cap").isNull()).alias("unknown"),
        F.sum(F.when(used, F.col("market_cap") * F.col("r"))).alias("wr"), F.max(F.when(used, F.struct("market_cap", F.col("company").alias("top_company")))).alias("top"),
        F.sort_array(F.collect_list(F.when(~used, F.struct("company", why.alias("reason"))))).alias("excluded"),
        gap("start", "a_date").alias("start_gap_days"), gap("ref_date", "b_date").alias("end_gap_days"), gap("start", "cap_date").alias("cap_gap_days"),
    )
    count_cov = F.col("included") / F.col("registered")
    value_cov = F.when(F.col("unknown") == 0, F.try_divide("used_cap", "all_cap"))
    ok = (count_cov >= min_coverage) & (value_cov.isNull() | (value_cov >= min_coverage))
    return g.select(
        "sector", "ref_date", "horizon", "registered", "included", count_cov.alias("count_coverage"), value_cov.alias("value_coverage"), F.when(ok, F.try_divide("wr", "used_cap")).alias("weighted_return"),
        F.try_divide("top.market_cap", "used_cap").alias("top_weight"), "top.top_company", "used_cap", "unknown", "excluded", "start_gap_days", "end_gap_days", "cap_gap_days",
    )


def top_k(df: DataFrame, k: int = 5) -> DataFrame:
    """The k largest valid market values of each sector; the row_number filter becomes a group limit before the shuffle."""
    ok = df.filter(valid_cap(df))
    rank = F.row_number().over(W.partitionBy("sector", "ref_date").orderBy(F.col("market_cap").desc(), "company"))
    return ok.withColumn("rank", rank).filter(F.col("rank") <= k)


def historic_market_cap(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """``shares``: company, at, market, official. Price as-of times validated quantity; a discrepancy blocks the value."""
    v = validate_shares(infer_share_scale(shares)).select("company", "at", "status", "quantity")
    p = price_as_of(prices, v.select("company", "at").distinct()).select("company", "at", "price")
    return v.join(p, ["company", "at"]).withColumn("market_cap", F.when(F.col("quantity").isNotNull(), F.col("price") * F.col("quantity")))


def current_market_cap(prices: DataFrame, shares: DataFrame, classes: DataFrame, tol: float = 0.05) -> DataFrame:
    """Last price times last shares; for companies with share classes the sum of price x quantity x weight over the classes.

    ``classes``: company, quantity, weight and price (null: the company's last price). Where the last shares differ from the
    weighted quantities by over ``tol`` of these, or a class lacks a part, the value is blocked; components stay.
    """
    p = prices.groupBy("company").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("price_date"))
    s = shares.groupBy("company").agg(F.max_by("shares", "date").alias("shares"))
    j = p.join(s, "company")
    c = classes.withColumnRenamed("price", "__class_price").join(j.select("company", F.col("price").alias("__price")), "company")
    c = c.withColumn("price", F.coalesce("__class_price", "__price"))
    equal = c.groupBy("company").agg(F.sum(F.col("quantity") * F.col("weight")).cast("double").alias("class_shares"), F.count(F.lit(1)).alias("components"))
    value = class_market_cap(c, ["company"]).withColumnRenamed("market_cap", "class_value")
    j = j.join(equal, "company", "left").join(value, "company", "left")
    diff = F.try_divide(F.abs(F.col("shares") - F.col("class_shares")).cast("double"), F.nullif(F.col("class_shares"), F.lit(0.0)))
    status = F.when(F.col("components").isNull(), "single_class").when(F.col("class_value").isNull(), "missing_share_class_data").when(diff <= tol, "validated_class_sum").otherwise("shares_discrepancy")
    cap = F.when(status == "single_class", F.col("price") * F.col("shares")).when(status == "validated_class_sum", F.col("class_value"))
    return j.withColumns({"difference_pct": diff * 100, "market_cap": cap, "status": status}).drop("class_value", "invalid")


def return_diagnostics(returns: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Flags and messages of ``sector_returns``: coverages under the minimum or unknown, a weight over 80 %, and used value at
    least ten times (or a tenth of) that of the date before with one."""
    w = W.partitionBy("sector", "horizon").orderBy("ref_date").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.nullif(F.col("used_cap"), F.lit(0.0)), ignorenulls=True).over(w)
    ratio = F.try_divide(F.greatest("used_cap", before), F.nullif(F.least("used_cap", before), F.lit(0.0)))
    change = F.when(before.isNotNull() & F.col("used_cap").isNotNull(), ratio)
    tests = [("concentrated", F.col("top_weight") > 0.8), ("cap_change_10x", change >= 10)]
    if "count_coverage" in returns.columns:
        tests.insert(0, ("low_count_coverage", F.col("count_coverage") < min_coverage))
    if "value_coverage" in returns.columns:
        known = F.col("value_coverage")
        tests.insert(1, ("unknown_value_coverage", F.col("unknown") > 0) if "unknown" in returns.columns else ("unknown_value_coverage", known.isNull()))
        tests.insert(2, ("low_value_coverage", known < min_coverage))
    messages = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda m: m.isNotNull())
    return returns.withColumns({"concentrated": F.col("top_weight") > 0.8, "cap_change": change, "jump": F.coalesce((ratio >= 10) & before.isNotNull(), F.lit(False)), "messages": messages})
