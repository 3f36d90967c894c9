"""Operational evidence: cells and lines of documents become observations with period, unit, confidence and status."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import norm_text
from fundamentals_spark.operators.asof import best_row

# How many rows above a cell may hold its header, in health sheets and in retail tables.
HEALTH_REACH, RETAIL_REACH = 499, 99


def attach_period(cells: DataFrame, lookback: int = 500, least_periods: int = 1, default: str | None = None) -> DataFrame:
    """Nearest period header above each cell in its column: last header within ``lookback`` rows, else the document's ``default`` column.

    ``cells``: doc, sheet, row, col, header_period. A row is a header only with ``least_periods`` periods in it (2 keeps a number
    like 2025 among values from being read as a year); its periods reach ``lookback`` rows down. Rows are counted by one
    partial aggregation, so a wide or long sheet is never gathered; a window follows one column of one sheet. Null periods are
    no headers, no header and no default is null.
    """
    kept = cells
    header = F.col("header_period")
    if least_periods > 1:
        rows = cells.filter(header.isNotNull()).groupBy("doc", "sheet", "row").agg(F.count(F.lit(1)).alias("__periods")).filter(F.col("__periods") >= least_periods)
        kept = cells.join(rows, ["doc", "sheet", "row"], "left")
        header = F.when(F.col("__periods").isNotNull(), header)
    above = W.partitionBy("doc", "sheet", "col").orderBy("row").rangeBetween(-lookback, -1)
    found = F.last(header, ignorenulls=True).over(above)
    return kept.withColumn("period", F.coalesce(found, F.col(default)) if default else found).drop("__periods")


def classify_labels(labels: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with the metric of the longest alias inside the normalised label; a forbidden pattern of the metric rejects it.

    ``dictionary``: metric, alias, forbidden (nullable pattern) - rule rows of fixed size, which are broadcast. Distinct labels alone meet the rules.
    """
    distinct = labels.select(label).distinct().withColumn("__n", norm_text(F.col(label), "token"))
    rules = dictionary.select("metric", norm_text(F.col("alias"), "token").alias("__a"), "forbidden")
    hits = distinct.join(F.broadcast(rules), F.concat(F.lit(" "), F.col("__n"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("__a"), F.lit(" "))) & ~F.coalesce(F.regexp_like("__n", F.col("forbidden")), F.lit(False)))
    best = hits.groupBy(label).agg(F.max(F.struct(F.length("__a").alias("n"), F.col("metric"))).alias("b")).select(label, F.col("b.metric").alias("metric"))
    return labels.join(best, label, "left")


def context_above(cells: DataFrame, k: int) -> DataFrame:
    """Text of the row and the k rows above it, joined."""
    w = W.partitionBy("doc", "sheet").orderBy("row").rowsBetween(-k, 0)
    return cells.withColumn("context", F.array_join(F.collect_list("text").over(w), " "))


# Terms above a cell that put it outside of the hospital block, terms that must all stand there, how far and wide to look.
OUTSIDE_BLOCK = ("sulamerica", "sul america", "seguros e previdencia")
INSIDE_BLOCK = ("hospitais", "oncologia")
BLOCK_REACH, BLOCK_COLUMNS = 17, 8


def section_scope(cells: DataFrame, name: str, outside: tuple[str, ...] = OUTSIDE_BLOCK, inside: tuple[str, ...] = INSIDE_BLOCK, reach: int = BLOCK_REACH, columns: int = BLOCK_COLUMNS) -> DataFrame:
    """``cells`` (doc, sheet, row, col from 1, text) with section: ``name`` where the rows above open that block, else null.

    The ``reach`` rows above a cell (its own is not among them) are read in their first ``columns`` columns, folded: any term of
    ``outside`` closes the block, else all terms of ``inside`` must occur. A term may run over cells of a row, not over rows. Each row
    becomes one flag a term before the window, so no text is carried down a sheet. Null texts are empty; cells stay as they are.
    """
    key = ["doc", "sheet", "row"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"])
    rows = cells.filter((F.col("col") <= columns) & F.col("text").isNotNull()).groupBy(*key).agg(norm_text(F.array_join(ordered, " "), "fold").alias("__t"))
    terms = [*outside, *inside]
    flags = rows.select(*key, *[F.col("__t").contains(t).alias(f"__f{i}") for i, t in enumerate(terms)])
    flags = cells.select(*key).distinct().join(flags, key, "left")
    above = W.partitionBy("doc", "sheet").orderBy("row").rangeBetween(-reach, -1)
    seen = [F.coalesce(F.max(f"__f{i}").over(above), F.lit(False)) for i in range(len(terms))]
    open_, closed = F.lit(True), F.lit(False)
    for i, s in enumerate(seen):
        open_, closed = (open_, closed | s) if i < len(outside) else (open_ & s, closed)
    decided = flags.select(*key, F.when(~closed & open_, name).alias("section"))
    return cells.join(decided, key, "left")


def explode_composite(cells: DataFrame) -> DataFrame:
    """Headers and values split at <br> or newlines into aligned (period, value) pairs; unequal lengths give none, variations and percentages go."""
    cut = lambda c: F.filter(F.split(c, r"<br\s*/?>|\n"), lambda x: F.trim(x) != "")
    h = F.filter(cut(F.col("header")), lambda x: F.upper(x).rlike(r"[0-9]{1,2}[MTQ][0-9]{2}") | F.lower(x).contains("var"))
    pairs = F.arrays_zip(h.alias("period"), cut(F.col("text")).alias("value"))
    ok = F.when(F.size(h) == F.size(cut(F.col("text"))), pairs).otherwise(F.array().cast("array<struct<period:string,value:string>>"))
    e = cells.withColumn("__p", F.explode(ok)).withColumns({"period": F.trim("__p.period"), "value": F.trim("__p.value")}).drop("__p")
    return e.filter(~F.lower("period").contains("var") & ~F.col("value").contains("%"))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "medium").otherwise("low")


def score_observations(obs: DataFrame) -> DataFrame:
    """Score by nature and source: reported 90 / 86 / 76 (spreadsheet, markdown, pdf), calculated 82, proxy 74, rejected 35."""
    score = (
        F.when(F.col("rejected"), 35).when(F.col("mapping") == "calculated", 82).when(F.col("mapping") == "proxy", 74)
        .when(F.col("source") == "spreadsheet", 90).when(F.col("source") == "markdown", 86).otherwise(76)
    )
    return obs.withColumns({"score": score, "confidence": confidence_label(score)})


# Further contexts that a metric's label or surroundings may not have.
_VARIATION = r"\b(?:var\.?|variacao|yoy|qoq|a/a|t/t)\b"


def judge_observations(obs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Nature, proxy, rejection, score and confidence of candidate values.

    ``obs``: metric, label, context, value, unit, source, calculated. ``definitions``: metric, allowed_proxies and
    forbidden_contexts (arrays of terms in order), proxy_score (null: 74) - one rule row a metric, joined by it. Terms are
    sought without case and accents in label and context. A forbidden term rejects unless it is an allowed proxy; so do
    variations beside an average ticket, patient-days as patients, net revenue as gross revenue, and gross revenue in money
    under 10. ``plausible`` tests patient-days: over 100 and no year. Null texts count as empty.
    """
    terms = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: norm_text(t, "fold"))
    rules = definitions.select(F.col("metric").alias("__m"), "allowed_proxies", "forbidden_contexts", "proxy_score")
    j = obs.join(rules, F.col("metric") == F.col("__m"), "left").withColumn("__hay", norm_text(F.concat_ws(" ", "label", "context"), "fold"))
    j = j.withColumns({"__ok": terms("allowed_proxies"), "__no": terms("forbidden_contexts")})
    hay, label = F.col("__hay"), norm_text(F.coalesce("label", F.lit("")), "fold")
    has = lambda *ts: F.exists(F.array(*map(F.lit, ts)), lambda t: hay.contains(t))
    calculated = F.coalesce("calculated", F.lit(False))
    place = F.array_position(F.transform("__ok", lambda t: hay.contains(t)), True).cast("int")
    proxy = F.when(calculated, "formula").when(place > 0, F.try_element_at("allowed_proxies", F.nullif(place, F.lit(0))))
    nature = F.when(calculated, "calculated").when(proxy.isNotNull(), "proxy").otherwise("reported")
    stop = F.array_position(F.transform("__no", lambda t: (t != "") & hay.contains(t) & ~F.array_contains("__ok", t)), True).cast("int")
    days = has("pacientes-dia", "paciente-dia")
    number, money = F.col("value").cast("double"), F.coalesce(norm_text(F.col("unit"), "fold").contains("r$"), F.lit(True))
    rejection = (
        F.when(stop > 0, F.try_element_at("forbidden_contexts", F.nullif(stop, F.lit(0))))
        .when((F.col("metric") == "Ticket Médio") & hay.rlike(_VARIATION), "variation_context")
        .when((F.col("metric") == "N. Pacientes") & days & (place.isNull() | (place == 0)), "pacientes-dia_is_not_unique_patients")
        .when((F.col("metric") == "Receita Bruta") & has("receita liquida", "net revenue"), "net_revenue_is_not_gross_revenue")
        .when((F.col("metric") == "Receita Bruta") & (number < 10) & money, "gross_revenue_value_incompatible_with_unit")
    )
    source = F.when(F.col("source").startswith("spreadsheet"), 90).when(F.col("source") == "release_table", 86).otherwise(76)
    score = F.when(rejection.isNotNull(), 35).when(nature == "proxy", F.coalesce("proxy_score", F.lit(74))).when(calculated, 82).otherwise(source)
    by_day = label.contains("pacientes-dia") | label.contains("paciente-dia")
    # fixed values: years that stand in headers
    plausible = F.coalesce(~by_day | ((number > 100) & ~F.floor(number).isin(2025, 2026)), F.lit(False)) & number.isNotNull()
    out = j.withColumns({"nature": nature, "proxy_for": proxy, "rejection_reason": rejection, "source_score": source, "score": score, "confidence": confidence_label(score), "plausible": plausible})
    review = (F.col("confidence") == "low") | F.col("rejection_reason").isNotNull()
    return out.withColumn("requires_review", review).drop("__m", "__hay", "__ok", "__no", "allowed_proxies", "forbidden_contexts", "proxy_score")


# Fields that evidence needs, and beginnings of flags that quarantine it.
EVIDENCE_FIELDS = ("ticker", "metric", "period", "value", "unit", "source_document")
_QUARANTINE = ("profile_publication:", "ownership_basis_expected:", "unexpected_")


def evidence_status(obs: DataFrame) -> DataFrame:
    """validation_status and the missing fields: null, empty or zero fields and low confidence give low_confidence; the flag
    breakdown_without_explicit_total gives quarantined_scope, flags of the profile's expectations quarantined. ``obs``: the
    fields, confidence, validation_flags (null: none)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    absent = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0) if c == "value" else text(c) == ""
    missing = F.filter(F.array(*[F.when(absent(c), F.lit(c)) for c in EVIDENCE_FIELDS]), lambda x: x.isNotNull())
    flags = F.coalesce("validation_flags", F.array().cast("array<string>"))
    bad = F.exists(flags, lambda f: F.exists(F.array(*map(F.lit, _QUARANTINE)), lambda p: F.startswith(f, p)))
    status = (
        F.when(F.array_contains(flags, "breakdown_without_explicit_total"), "quarantined_scope").when(bad, "quarantined")
        .when((F.size(missing) == 0) & F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False)), "valid").otherwise("low_confidence")
    )
    return obs.withColumns({"validation_status": status, "validation_missing_fields": missing})


def validation_status(obs: DataFrame, required: tuple[str, ...] = ("value", "period", "source")) -> DataFrame:
    """valid, low_confidence, quarantined (a required field is missing or flagged) or quarantined_scope."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    status = F.when(F.col("scope") == "segment", "quarantined_scope").when(F.size(missing) > 0, "quarantined").when(F.col("confidence") == "low", "low_confidence").otherwise("valid")
    return obs.withColumns({"missing": F.array_join(missing, ","), "status": status})


def dedupe_observations(obs: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    return best_row(obs, key, rank)


def drop_identical_series(obs: DataFrame, key: list[str], item: list[str], first: list[str]) -> DataFrame:
    """Of the items of a key whose series (period to value) are equal, the first by ``first`` stays, with all of its rows.

    ``obs``: key, item, period, value and the order columns, which are those of an item's smallest row. A period that repeats
    within an item counts once if its values agree, else with each of them. Series are compared by their number of points and
    two sums of 64-bit hashes of the points, so that no series is gathered; items without any point are equal to one another.
    Null periods and values are points of their own. Null keys form a key.
    """
    point = F.struct("period", "value")
    points = obs.groupBy(*key, *item, "period", "value").agg(F.min(F.struct(*first)).alias("__first"))
    sums = [F.sum(F.xxhash64(F.lit(seed), point).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "__a"), (2, "__b"))]
    series = points.groupBy(*key, *item).agg(F.count(F.lit(1)).alias("__n"), *sums, F.min("__first").alias("__first"))
    order = W.partitionBy(*key, "__n", "__a", "__b").orderBy("__first", *item)
    gone = series.withColumn("__r", F.row_number().over(order)).filter("__r > 1").select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate([*key, *item])])
    on = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate([*key, *item])]
    return obs.join(gone, on, "left_anti")


def fill_missing(primary: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """``primary`` and those rows of ``fallback`` whose key it lacks."""
    return primary.unionByName(fallback.join(primary.select(*key).distinct(), key, "left_anti"))


def derive_ratio(obs: DataFrame, numerator: str, denominator: str, name: str) -> DataFrame:
    """Ratio of two metrics of one ticker, period and scope; else a diagnostic row with a reason."""
    g = obs.groupBy("ticker", "year", "q", "scope").agg(F.max(F.when(F.col("metric") == numerator, F.col("value"))).alias("a"), F.max(F.when(F.col("metric") == denominator, F.col("value"))).alias("b"))
    reason = F.when(F.col("a").isNull(), "missing_numerator").when(F.col("b").isNull(), "missing_denominator").when(F.col("b") == 0, "zero_denominator")
    return g.select("ticker", "year", "q", "scope", F.lit(name).alias("metric"), F.when(reason.isNull(), F.try_divide(F.col("a").cast("double"), F.nullif(F.col("b").cast("double"), F.lit(0.0)))).alias("value"), reason.alias("reason"))


# Derived retail metrics as (metric, numerator, denominator, unit, reason when it cannot be computed).
RETAIL_RATIOS = (
    ("digital_revenue_share", "digital_revenue_brl", "comparable_total_revenue_brl", "%", "missing_or_incompatible_comparable_revenue_base"),
    ("physical_revenue_per_sqm", "physical_revenue_brl", "sales_area_sqm", "R$/m²", "missing_or_incompatible_physical_revenue_or_area"),
)


def derive_retail(obs: DataFrame) -> DataFrame:
    """Digital share and physical revenue per area of each ticker and period; rows that cannot be computed carry a reason.

    ``obs``: ticker, period, metric, value, scope, status, segment (consolidated or breakdown), area_basis, ordinal. Only valid
    consolidated rows count, of several the last by ordinal. Both parts must have the same scope (two nulls are the same). A
    closing (or unstated) area lowers confidence to medium, with a flag.
    """
    rows = obs.filter("status = 'valid' and segment = 'consolidated'")
    names = [n for r in RETAIL_RATIOS for n in r[1:3]]
    last = [F.max_by(F.struct("value", "scope", "area_basis"), F.when(F.col("metric") == n, F.col("ordinal"))).alias(n) for n in names]
    g = rows.groupBy("ticker", "period").agg(*last)

    def ratio(metric: str, top: str, base: str, unit: str, reason: str) -> Column:
        a, b = F.col(f"{top}.value").cast("double"), F.nullif(F.col(f"{base}.value").cast("double"), F.lit(0.0))
        ok = F.coalesce(a.isNotNull() & b.isNotNull() & F.col(f"{top}.scope").eqNullSafe(F.col(f"{base}.scope")), F.lit(False))
        closing = F.lit(base == "sales_area_sqm") & (F.coalesce(F.nullif(F.col(f"{base}.area_basis"), F.lit("")), F.lit("closing")) == "closing")
        flag = F.when(ok & closing, "closing_area_used_instead_of_average_area")
        return F.struct(
            F.lit(metric).alias("metric"), F.when(ok, F.try_divide(a, b)).alias("value"), F.lit(unit).alias("unit"), F.col(f"{top}.scope").alias("scope"), F.when(ok, F.when(closing, "medium").otherwise("high")).alias("confidence"),
            flag.alias("validation_flag"), F.when(ok, "derived").otherwise("not_calculated").alias("status"), F.when(~ok, reason).alias("reason"),
        )

    return g.select("ticker", "period", F.explode(F.array(*[ratio(*r) for r in RETAIL_RATIOS])).alias("r")).select("ticker", "period", "r.*")


def check_observations(obs: DataFrame, metrics: DataFrame | list[str], key: list[str], ticker: str | None = None) -> DataFrame:
    """Array of contract errors for every row.

    unknown_metric ends the checks of its row. Else: ticker_mismatch (``ticker`` given), missing_value (null or not finite),
    bad_period, unit_mismatch (``metrics`` as rule rows metric, unit), duplicate_key (all but the first of a key by ordinal,
    or all where there is none), and by ``nature``: missing_<field> of a reported row (source_document, source_type,
    row_label, raw_value), missing_formula of a derived one, missing_nature of others. Checks whose columns the table lacks
    are left out.
    """
    has = set(obs.columns)
    rules = None if isinstance(metrics, list) else metrics.select(F.col("metric").alias("__m"), F.col("unit").alias("__unit")).distinct()
    rows = obs if rules is None else obs.join(rules, F.col("metric") == F.col("__m"), "left")
    unknown = ~F.col("metric").isin(*metrics) if rules is None else F.col("__m").isNull()
    unknown = F.coalesce(unknown, F.lit(True))
    w = W.partitionBy(*key)
    dup = F.row_number().over(w.orderBy("ordinal")) > 1 if "ordinal" in has else F.count(F.lit(1)).over(w) > 1
    number = F.col("value").cast("double")
    period = F.coalesce(~F.col("period").rlike(r"^([1-4]T[0-9]{2}|20[0-9]{2})$"), F.lit(True)) if "period" in has else ~F.col("q").between(1, 4)
    checks = [("missing_value", number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))), ("bad_period", period), ("duplicate_key", dup)]
    if ticker is not None:
        checks.insert(0, ("ticker_mismatch", ~F.upper("ticker").eqNullSafe(F.lit(ticker.upper()))))
    if rules is not None and "unit" in has:
        checks.append(("unit_mismatch", ~F.col("unit").eqNullSafe(F.col("__unit"))))
    if "nature" in has:
        nature = F.coalesce("nature", F.lit(""))
        for f in ("source_document", "source_type", "row_label", "raw_value"):
            if f in has:
                checks.append((f"missing_{f}", (nature == "reported") & (F.coalesce(F.col(f).cast("string"), F.lit("")) == "")))
        if "formula" in has:
            checks.append(("missing_formula", (nature == "derived") & (F.coalesce("formula", F.lit("")) == "")))
        checks.append(("missing_nature", ~nature.isin("reported", "derived")))
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda e: e.isNotNull())
    return rows.withColumn("errors", F.when(unknown, F.array(F.lit("unknown_metric"))).otherwise(errors)).drop("__m", "__unit")


def vso(obs: DataFrame, require_adjacent: bool = False, materiality: float = 0.05) -> DataFrame:
    """Net sales over (opening inventory + launches) by ticker, basis and quarter.

    Opening = closing inventory, on the same basis, of the latest earlier quarter in which the ticker has any observation; if
    that quarter lacks it, it is missing. Bases null or ``unknown`` are incompatible. ``reconciliation`` compares the closing
    inventory with base - net sales, relative to the base; ``confidence`` is medium for material differences.
    """
    part = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in ("net_sales", "launches", "inventory")}
    g = obs.groupBy("ticker", "basis", "year", "q").agg(*[v.alias(k) for k, v in part.items()]).withColumn("i", F.col("year") * 4 + F.col("q"))
    earlier = F.max("i").over(W.partitionBy("ticker").orderBy("i").rangeBetween(W.unboundedPreceding, -1))
    own = F.last(F.struct("i", "inventory")).over(W.partitionBy("ticker", "basis").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumns({"before": earlier, "own": own})
    here = (F.col("own.i") == F.col("before")) & ((F.col("before") == F.col("i") - 1) | F.lit(not require_adjacent))
    g = g.withColumn("opening", F.when(here, F.col("own.inventory")))
    base = F.col("opening") + F.col("launches")
    missing = F.col("net_sales").isNull() | F.col("launches").isNull() | F.col("opening").isNull()
    bad_basis = F.coalesce(F.col("basis") == "unknown", F.lit(True))
    status = F.when(missing, "missing").when(bad_basis, "incompatible").when(base <= 0, "non_positive_base").otherwise("ok")
    name = F.when(missing, "missing_components").when(bad_basis, "incompatible_basis").when(base <= 0, "invalid_denominator").otherwise("derived")
    gap = F.abs(F.col("inventory") - (base - F.col("net_sales"))).cast("double")
    rec = (
        F.when((status != "ok") | gap.isNull(), "not_calculable").when(gap <= 1e-9, "reconciled")
        .when(gap / F.greatest(F.abs(base.cast("double")), F.lit(1.0)) <= materiality, "immaterial_difference").otherwise("material_difference")
    )
    value = F.when(status == "ok", F.try_divide(F.col("net_sales").cast("double"), F.nullif(base.cast("double"), F.lit(0.0))))
    out = g.select("ticker", "basis", "year", "q", value.alias("vso"), status.alias("status"), name.alias("calculation_status"), rec.alias("reconciliation"))
    near = F.when(~F.col("reconciliation").isin("not_calculable"), F.col("reconciliation") != "material_difference")
    return out.withColumns({"reconciled": near, "confidence": F.when(F.col("status") == "ok", F.when(F.col("reconciliation") == "material_difference", "medium").otherwise("high"))})


def roe(df: DataFrame) -> DataFrame:
    """Rolling income over average equity."""
    avg = (F.col("equity_open") + F.col("equity_close")) / 2
    status = F.when(F.col("income").isNull() | avg.isNull(), "missing").when(avg <= 0, "non_positive_equity").otherwise("ok")
    return df.withColumns({"roe": F.when(status == "ok", F.try_divide(F.col("income").cast("double"), F.nullif(avg.cast("double"), F.lit(0.0)))), "status": status})


def credit_loss_proxy(df: DataFrame) -> DataFrame:
    """|allowance| over gross receivables; gross is net + |allowance| where it is not given."""
    loss = F.abs("allowance")
    gross = F.coalesce(F.col("gross"), F.col("net") + loss)
    return df.withColumns({"gross_used": gross, "proxy": F.when(gross > 0, F.try_divide(loss.cast("double"), F.nullif(gross.cast("double"), F.lit(0.0))))})


def roe_by_scope(df: DataFrame) -> DataFrame:
    """``roe`` with the status of incompatible scopes. ``df``: income, equity_open, equity_close, scopes_match (null: they do)."""
    avg = (F.col("equity_open").cast("double") + F.col("equity_close").cast("double")) / 2
    match = F.coalesce("scopes_match", F.lit(True))
    status = F.when(F.col("income").isNull() | avg.isNull(), "missing_components").when(~match, "incompatible_basis").when(avg <= 0, "invalid_denominator").otherwise("derived")
    return df.withColumns({"average_equity": F.when(status.isin("derived", "invalid_denominator"), avg), "value": F.when(status == "derived", F.try_divide(F.col("income").cast("double"), F.nullif(avg, F.lit(0.0)))), "calculation_status": status})


def credit_loss_by_scope(df: DataFrame) -> DataFrame:
    """``credit_loss_proxy`` with its status and whether gross was rebuilt. ``df``: allowance, gross, net, same_scope (null: it is)."""
    loss = F.abs(F.col("allowance").cast("double"))
    rebuilt = F.col("gross").isNull() & F.col("net").isNotNull() & loss.isNotNull()
    gross = F.coalesce(F.col("gross").cast("double"), F.col("net").cast("double") + loss)
    status = F.when(loss.isNull() | gross.isNull(), "missing_components").when(~F.coalesce("same_scope", F.lit(True)), "incompatible_basis").when(gross <= 0, "invalid_denominator").otherwise("derived")
    return df.withColumns({"gross_used": gross, "gross_rebuilt": rebuilt, "value": F.when(status == "derived", F.try_divide(loss, F.nullif(gross, F.lit(0.0)))), "calculation_status": status})


def annualize(obs: DataFrame, by: list[str]) -> DataFrame:
    """Annual rows: stock = fourth quarter, flow = sum of four quarters (all needed), ratio never; a reported year wins. ``obs``: by, nature, year, q (null = annual), value."""
    g = obs.filter("q is not null").groupBy(*by, "nature", "year").agg(F.countDistinct("q").alias("n"), F.sum("value").alias("s"), F.max(F.when(F.col("q") == 4, F.col("value"))).alias("last"))
    made = g.select(*by, "nature", "year", F.when(F.col("nature") == "stock", F.col("last")).when((F.col("nature") == "flow") & (F.col("n") == 4), F.col("s")).alias("value"), F.lit("derived").alias("origin")).filter("value is not null")
    reported = obs.filter("q is null").select(*by, "nature", "year", "value", F.lit("reported").alias("origin"))
    return fill_missing(reported, made, by + ["year"])


# Labels of a breakdown.
BREAKDOWNS = ("por regiao", "por produto", "by region", "by product")


def quarantine(obs: DataFrame) -> DataFrame:
    """A breakdown label that is no total, or evidence whose first four bold numbers are all over 100 times the value, is rejected.

    ``obs``: label, evidence, value, and unit (of the evidence; null or no such column: millions). Zero and unreadable
    numbers of the evidence do not count.
    """
    from fundamentals_spark.functions.text import norm_unit, parse_number

    unit = F.coalesce(F.col("unit"), F.lit("R$ MM")) if "unit" in obs.columns else F.lit("R$ MM")
    bold = F.slice(F.regexp_extract_all(F.col("evidence"), F.lit(r"\*\*([0-9][0-9.,]*)\*\*"), F.lit(1)), 1, 4)
    numbers = F.transform(bold, lambda n: norm_unit(parse_number(n, "operational").cast("double"), unit)["value"])
    ratios = F.transform(F.filter(numbers, lambda n: n != 0), lambda n: F.abs(n / F.nullif(F.col("value").cast("double"), F.lit(0.0))))
    label = norm_text(F.col("label"), "fold")
    breakdown = F.exists(F.array(*map(F.lit, BREAKDOWNS)), lambda x: label.contains(x)) & ~label.contains("total")
    reason = F.when(breakdown, "breakdown_as_total").when((F.size(ratios) > 0) & (F.array_min(ratios) > 100), "scale_incompatible_with_evidence")
    return obs.withColumns({"rejection_reason": reason, "kept_value": F.when(reason.isNull(), F.col("value"))})


def prune_trailing_zeros(obs: DataFrame, by: list[str]) -> DataFrame:
    """Rows after the last period with a non-zero value go; low confidence neither counts nor goes, and without a non-zero value all stay."""
    low = F.col("confidence").eqNullSafe("low") if "confidence" in obs.columns else F.lit(False)
    at = F.col("year") * 4 + F.col("q")
    last = F.max(F.when((F.col("value") != 0) & ~low, at)).over(W.partitionBy(*by))
    return obs.withColumn("__l", last).filter(low | F.col("__l").isNull() | (at <= F.col("__l"))).drop("__l")


def ratio_on_common_periods(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """a / b on shared keys; zero denominators are left out."""
    return a.select(*key, F.col("value").alias("__a")).join(b.select(*key, F.col("value").alias("__b")), key).filter("__b <> 0").select(*key, F.try_divide(F.col("__a").cast("double"), F.col("__b").cast("double")).alias("value"))


def coverage_warnings(obs: DataFrame, companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per company and metric: not_found, rejected_candidates, medium_confidence or ok."""
    g = obs.groupBy("ticker", "metric").agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))
    spine = companies.join(metrics, how="cross").join(g, ["ticker", "metric"], "left")
    return spine.select("ticker", "metric", F.when(F.col("high").isNull(), "not_found").when(F.col("high") > 0, "ok").when(F.col("medium") > 0, "medium_confidence").otherwise("rejected_candidates").alias("warning"))


def resolve_documents(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Company of a text by the longest of its names in it; a tie between companies is unresolved. ``names``: company, name, method (broadcast rule rows)."""
    t = docs.select("doc_id", F.concat(F.lit(" "), norm_text(F.col("text"), "token"), F.lit(" ")).alias("__t"))
    n = names.select("company", "method", F.concat(F.lit(" "), norm_text(F.col("name"), "token"), F.lit(" ")).alias("__n"))
    hits = t.join(F.broadcast(n), F.col("__t").contains(F.col("__n"))).withColumn("n", F.length("__n"))
    top = hits.withColumn("m", F.max("n").over(W.partitionBy("doc_id"))).filter("n = m").groupBy("doc_id").agg(F.countDistinct("company").alias("c"), F.min("company").alias("company"), F.min("method").alias("method"))
    return docs.select("doc_id").join(top, "doc_id", "left").select("doc_id", F.when(F.col("c") == 1, F.col("company")).alias("company"), F.when(F.col("c") == 1, F.col("method")).when(F.col("c") > 1, "tie").otherwise("none").alias("method"))


#: Names and tickers that one automaton holds; more are an error.
MOST_NAMES = 200_000


def _names_in(names: list[tuple[int, str]]):
    """Rows of (doc_id, ids of the names that stand anywhere in ``hay``), by one pass of an Aho-Corasick automaton over each text."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for at, name in names:
            automaton.add_word(name, (*automaton.get(name, ()), at))
        if names:
            automaton.make_automaton()
        for batch in batches:
            hits = [sorted({at for _, ids in automaton.iter(text) for at in ids}) if text and names else [] for text in batch.column("hay").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "hits"])

    return run


def company_of_document(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """company, method and evidence of every document, by its path, text and source address; null where nothing or a tie speaks.

    ``docs``: doc_id, path, text, url; ``companies``: company, ticker, cnpj, names array<string> (legacy tickers and aliases), domains
    array<string>. A company's evidence is its longest hit: a ticker or name anywhere in path or text (in any case), its CNPJ
    within the text's digits, else its domain as the address's host. The company with the longest evidence wins, two of equal
    length are a tie. method is filename_ticker, content_cnpj, official_domain or content_alias. Names are rule rows: at
    most ``MOST_NAMES``, which one automaton matches; CNPJs and domains are equi joins.
    """
    named = companies.select("company", F.explode(F.array_distinct(F.concat(F.array("ticker"), F.coalesce("names", F.array().cast("array<string>"))))).alias("name")).filter("name <> ''")
    rules = [(r["company"], r["name"]) for r in named.distinct().limit(MOST_NAMES + 1).collect()]
    if len(rules) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    path, text = F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.upper(F.concat_ws(" ", path, text)).alias("hay")).mapInArrow(_names_in([(k, n.upper()) for k, (_, n) in enumerate(rules)]), f"doc_id {kind}, hits array<long>")
    table = docs.sparkSession.createDataFrame([(k, c, n) for k, (c, n) in enumerate(rules)], f"hit long, company {companies.schema['company'].dataType.simpleString()}, evidence string")
    by_name = found.select("doc_id", F.explode("hits").alias("hit")).join(F.broadcast(table), "hit").select("doc_id", "company", "evidence", F.lit("alias").alias("kind"))
    digits = docs.select("doc_id", F.regexp_replace(text, "[^0-9]", "").alias("d")).filter(F.length("d") >= 14)
    windows = digits.select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(d) - 13), i -> substring(d, i, 14))"))).alias("digits"))
    ids = companies.select("company", "cnpj", F.regexp_replace("cnpj", "[^0-9]", "").alias("digits")).filter(F.length("digits") == 14)
    by_cnpj = windows.join(ids, "digits").select("doc_id", "company", F.concat(F.lit("CNPJ:"), "cnpj").alias("evidence"), F.lit("cnpj").alias("kind"))
    host = docs.select("doc_id", F.lower(F.try_element_at(F.split("url", "/"), F.lit(3))).alias("host")).filter("host <> ''")
    domains = companies.select("company", F.explode("domains").alias("domain")).select("company", F.lower("domain").alias("host")).distinct()
    by_host = host.join(domains, "host").select("doc_id", "company", F.concat(F.lit("DOMAIN:"), "host").alias("evidence"), F.lit("domain").alias("kind"))
    by_host = by_host.join(by_cnpj.select("doc_id", "company").distinct(), ["doc_id", "company"], "left_anti")  # a CNPJ stands for the domain
    every = by_name.unionByName(by_cnpj).unionByName(by_host)
    best = every.groupBy("doc_id", "company").agg(F.max(F.struct(F.length("evidence").alias("n"), F.col("evidence").alias("e"))).alias("best"), F.max(F.col("kind") == "cnpj").alias("cnpj"), F.max(F.col("kind") == "domain").alias("domain"))
    best = best.join(companies.select("company", "ticker"), "company")
    lead = best.groupBy("doc_id").agg(F.max(F.struct("best.n", "company", "best.e", "cnpj", "domain", "ticker")).alias("top"), F.max("best.n").alias("n"), F.collect_list("best.n").alias("all"))
    lead = lead.filter(F.size(F.filter("all", lambda x: x == F.col("n"))) == 1)
    out = docs.select("doc_id", F.upper(path).alias("path")).join(lead, "doc_id", "left")
    in_path = out["path"].contains(F.upper("top.ticker"))
    method = F.when(F.col("top").isNull(), None).when(in_path, "filename_ticker").when(F.col("top.cnpj"), "content_cnpj").when(F.col("top.domain"), "official_domain").otherwise("content_alias")
    return out.select("doc_id", F.col("top.company").alias("company"), method.alias("method"), F.col("top.e").alias("evidence"))


def metric_series(obs: DataFrame) -> DataFrame:
    """ticker, metric, periods map, worst confidence and number of sources."""
    order = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    label = F.concat(F.col("q").cast("string"), F.lit("T"), F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
    return obs.groupBy("ticker", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label.alias("k"), F.col("value").alias("v"))))).alias("periods"), F.min_by("confidence", order).alias("worst"), F.countDistinct("source").alias("sources"))


def preserve_snapshot(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new snapshot, and the old rows of tickers that the new one lacks, with status preserved_existing_data."""
    kept = old.join(new.select("ticker").distinct(), "ticker", "left_anti")
    return new.withColumn("status", F.lit("updated")).unionByName(kept.withColumn("status", F.lit("preserved_existing_data")))


def snapshot_outcome(companies: DataFrame, new: DataFrame, old: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, status) after a run. A company's new rows replace its old ones; without new rows the old ones stay.

    ``companies``: ticker. ``documents``: ticker, status (null or error) of the documents of this run. Status by ticker:
    found_new_data, preserved_existing_data, else extraction_failed (a document has an error), unsupported_document (there were
    documents) or source_unavailable. Rows of tickers outside ``companies`` stay out.
    """
    asked = companies.select("ticker").distinct()
    fresh, past = new.join(asked, "ticker", "left_semi"), old.join(asked, "ticker", "left_semi")
    has = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    docs = documents.groupBy("ticker").agg(F.max(F.coalesce(F.col("status") == "error", F.lit(False))).alias("failed"))
    j = asked.join(has(fresh, "__new"), "ticker", "left").join(has(past, "__old"), "ticker", "left").join(docs, "ticker", "left")
    status = F.when(F.col("__new"), "found_new_data").when(F.col("__old"), "preserved_existing_data").when(F.col("failed"), "extraction_failed").when(F.col("failed").isNotNull(), "unsupported_document").otherwise("source_unavailable")
    return fill_missing(fresh, past, ["ticker"]), j.select("ticker", status.alias("status"), F.when(F.col("__new").isNotNull() | F.col("__old").isNotNull(), "found").otherwise("not_found").alias("coverage_status"))


def latest_metric(obs: DataFrame) -> DataFrame:
    """Latest value of each ticker and metric without low confidence; an annual row (null quarter) ranks after the fourth quarter."""
    return best_row(obs.filter("confidence <> 'low'"), ["ticker", "metric"], [F.col("year").desc(), F.coalesce("q", F.lit(5)).desc(), F.col("ordinal").desc()])


def resolve_by_priority(obs: DataFrame, key: list[str]) -> DataFrame:
    """high before medium before manual before others; the first row wins ties."""
    p = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "manual", 2).otherwise(3)
    return best_row(obs, key, [p, F.col("ordinal")])


def benchmark(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Each expected row (id, ticker, metric, year, q, value, protected) against extracted rows: protected_state, false_positive, not_found, found_without_expected_value, match (within max(0.01, 1 %)) or mismatch."""
    a = actual.groupBy("ticker", "metric", "year", "q").agg(F.collect_set(F.col("value").cast("double")).alias("found"))
    j = expected.join(a, ["ticker", "metric", "year", "q"], "left")
    v = F.col("value").cast("double")
    near = F.exists(F.col("found"), lambda x: F.abs(x - v) <= F.greatest(F.lit(0.01), F.abs(v) * 0.01))
    has = F.col("found").isNotNull()
    return j.select("id", F.when(F.col("protected") & ~has, "protected_state").when(F.col("protected"), "false_positive").when(~has, "not_found").when(v.isNull(), "found_without_expected_value").when(near, "match").otherwise("mismatch").alias("outcome"))


# States of an expected row that should have no extracted counterpart.
_PROTECTED = ("não divulgado", "nao divulgado", "não aplicável", "nao aplicavel", "ambíguo", "ambiguo")


def benchmark_matrix(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Outcome of every expected row (id, ticker, state, indicator, value, period, unit) against the ticker's extracted rows
    (ticker, metric, name, value, period, unit): protected_state or false_positive for protected states, not_found,
    found_without_expected_value, match or mismatch.

    An extracted row is a candidate if its name or metric contains the indicator, without case. A match is within
    max(0.01, 1 %) of the value and has the period (Q counts as T) and contains the unit, where the row states them. Indicators
    meet the ticker's distinct names (as many as a dictionary has), values meet in neighbouring cells of a scale on which the
    tolerance is at most one cell; so the rows of a ticker never meet all against all.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    cell = lambda v: F.floor(F.signum(v) * F.asinh(F.abs(v)) / 0.0125)
    a = actual.select("ticker", low("metric").alias("a_metric"), low("name").alias("a_name"), F.col("value").cast("double").alias("a_value"), F.upper(F.coalesce("period", F.lit(""))).alias("a_period"), low("unit").alias("a_unit")).distinct()
    any_row = a.select("ticker", F.lit(True).alias("any_row")).distinct()
    e = expected.withColumns({"e_name": low("indicator"), "e_period": F.translate(F.upper(F.trim(F.coalesce("period", F.lit("")))), "Q", "T"), "e_unit": low("unit"), "e_value": F.col("value").cast("double"), "guarded": low("state").isin(*_PROTECTED)})
    e = e.select("id", "ticker", "e_name", "e_period", "e_unit", "e_value", "guarded")
    named = lambda: F.col("a_name").contains(F.col("e_name")) | F.col("a_metric").contains(F.col("e_name"))
    asked = e.select("ticker", "e_name").distinct()
    known = asked.join(a.select("ticker", "a_name", "a_metric").distinct(), "ticker").filter(named()).select("ticker", "e_name", F.lit(True).alias("found")).distinct()
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    near_e = e.filter(finite(F.col("e_value"))).withColumn("cell", F.explode(F.array(*[cell(F.col("e_value")) + i for i in (-1, 0, 1)])))
    near_a = a.filter(finite(F.col("a_value"))).withColumn("cell", cell(F.col("a_value")))
    fits = (F.abs(F.col("a_value") - F.col("e_value")) <= F.greatest(F.lit(0.01), F.abs("e_value") * 0.01)) & ((F.col("e_period") == "") | (F.col("a_period") == F.col("e_period"))) & ((F.col("e_unit") == "") | F.col("a_unit").contains(F.col("e_unit")))
    hits = near_e.join(near_a, ["ticker", "cell"]).filter(named() & fits).select("id", F.lit(True).alias("fits")).distinct()
    j = e.join(hits, "id", "left").join(known, ["ticker", "e_name"], "left").join(any_row, "ticker", "left")
    outcome = (
        F.when(F.col("guarded") & F.col("any_row").isNull(), "protected_state").when(F.col("guarded"), "false_positive").when(F.col("found").isNull(), "not_found")
        .when(F.col("e_value").isNull(), "found_without_expected_value").when(F.col("fits"), "match").otherwise("mismatch")
    )
    return j.select("id", "ticker", outcome.alias("outcome"))


def build_observations(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """Observations with evidence from classified cells: value, unit, period, basis, nature and flags from the profile's expectations.

    ``cells``: doc, ticker, metric, label, period, value, unit, source, context. ``profile``: ticker, metric, expected_basis, expected_sign (rule rows).
    """
    from fundamentals_spark.functions.text import norm_unit, ownership_basis

    c = cells.filter("metric is not null and value is not null").join(F.broadcast(profile), ["ticker", "metric"], "left")
    basis = ownership_basis(F.concat_ws(" ", "label", "context"))
    checks = F.array(F.when(F.col("expected_basis").isNotNull() & (F.col("expected_basis") != basis), F.lit("unexpected_basis")), F.when((F.col("expected_sign") == "positive") & (F.col("value") < 0), F.lit("unexpected_sign")), F.when(F.col("period").isNull(), F.lit("missing_period")))
    u = norm_unit(F.col("value").cast("double"), F.col("unit"))
    return c.select("doc", "ticker", "metric", "period", u["value"].alias("value"), u["unit"].alias("unit"), u["multiplier"].alias("multiplier"), basis.alias("ownership_basis"), "source", F.col("value").cast("double").alias("raw_value"), F.col("unit").alias("raw_unit"), F.col("label").alias("row_label"), F.filter(checks, lambda x: x.isNotNull()).alias("validation_flags"))


def flatten_observations(docs: DataFrame) -> DataFrame:
    """One row per observation of company documents: ticker, metric and the observation's fields. ``docs``: ticker, metrics map<string, array<struct>>."""
    m = docs.select("ticker", F.explode("metrics").alias("metric", "items"))
    return m.select("ticker", "metric", F.explode("items").alias("o")).select("ticker", "metric", "o.*")
