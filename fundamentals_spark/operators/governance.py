"""Manual overrides, lifecycle tracking, quality reports and comparison outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from fundamentals_spark.operators.asof import best_row
from fundamentals_spark.operators.indicators import cagr_years

KEY = ["ticker", "metric", "year", "q"]
# Events of a document's life, the ones that may follow each (``discovered`` may follow any), those that end it, and reserved field names.
TRANSITIONS = {
    "discovered": ("discovered", "accepted", "rejected", "extraction_error"),
    "accepted": ("accepted", "downloaded", "imported", "converted", "read", "published", "rejected", "extraction_error"),
    "downloaded": ("imported", "converted", "read", "extraction_error"),
    "imported": ("converted", "read", "extraction_error"),
    "converted": ("read", "extraction_error"),
    "read": ("company_resolved", "parsed", "validated", "unresolved", "extraction_error"),
    "company_resolved": ("parsed", "validated", "unresolved", "extraction_error"),
    "parsed": ("validated", "published", "rejected", "extraction_error"),
    "validated": ("published", "preserved_existing", "rejected", "extraction_error"),
}
TERMINAL = ("published", "preserved_existing", "rejected", "unresolved", "extraction_error")
PROCESSED = ("read", "company_resolved", "parsed", "validated", "published")
RESERVED = ("run_id", "document_id", "state", "at")


def normalize_overrides(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The last active row of each key stays active, earlier ones become history; other states stay as they are."""
    rank = F.row_number().over(W.partitionBy(*key, F.col("status") == "active").orderBy(F.col("ordinal").desc()))
    return df.withColumn("__r", rank).withColumn("status", F.when((F.col("status") == "active") & (F.col("__r") > 1), "superseded").otherwise(F.col("status"))).drop("__r")


def upsert_overrides(base: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Base rows (key, value, status, more) after changes (key, value, op), with ``error``; at most one change and one active row a key.

    An upsert updates the key's active row and appends one where there is none; a delete turns the active row into a ``deleted``
    one. Rows of any other status are history: nothing matches or revives them. A delete without an active row changes
    nothing and gives a row with error ``no_active_row``. A null or empty status is active. Columns that only ``base`` has stay, null in appended rows.
    """
    rows = base.withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active")))
    more = [c for c in base.columns if c not in (*key, "value", "status")]
    c = changes.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("value").alias("__new"), F.col("op").alias("__op"))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    j = rows.filter("status = 'active'").join(c, match, "full")
    lost = (F.col("__op") == "delete") & F.col("status").isNull()
    status = F.when(lost, None).when(F.col("__op") == "delete", "deleted").otherwise("active")
    value = F.when(F.col("__op") == "upsert", F.col("__new")).when(~F.coalesce(lost, F.lit(False)), F.col("value"))
    done = j.select(*[F.coalesce(k, f"__{k}").alias(k) for k in key], value.alias("value"), *more, status.alias("status"), F.when(lost, "no_active_row").alias("error"))
    return done.unionByName(rows.filter("status <> 'active'").select(*key, "value", *more, "status", F.lit(None).cast("string").alias("error")))


def resolve_overrides(obs: DataFrame, overrides: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Each active override: superseded by an accepted (high or medium) automatic value, else applied with a warning.

    Rows of another status pass through as they are, without a used value or a warning. Without a ``status`` column all are active.
    """
    auto = best_row(obs.filter("confidence in ('high', 'medium') and value is not null"), key, [F.when(F.col("confidence") == "high", 0).otherwise(1), F.col("ordinal").desc()])
    given = overrides.withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active"))) if "status" in overrides.columns else overrides.withColumn("status", F.lit("active"))
    j = given.join(auto.select(*key, F.col("value").alias("automatic_value"), F.col("confidence").alias("automatic_confidence")), key, "left")
    live = F.col("status") == "active"
    hit = live & F.col("automatic_confidence").isNotNull()
    return j.withColumns({
        "automatic_value": F.when(live, F.col("automatic_value")), "automatic_confidence": F.when(live, F.col("automatic_confidence")), "status": F.when(hit, "superseded").otherwise(F.col("status")),
        "used_value": F.when(live, F.coalesce("automatic_value", "value")), "warning": F.when(live & ~hit, "manual_value_in_use"),
    })


def merge_manual(obs: DataFrame, overrides: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The observations, and behind them every override that stays active as an observation of confidence ``MANUAL`` and nature ``manual``."""
    active = resolve_overrides(obs, overrides, key).filter("status = 'active'").select(*key, "value", F.lit("MANUAL").alias("confidence"), F.lit("manual").alias("nature"))
    return obs.select(*key, "value", "confidence", F.lit("automatic").alias("nature")).unionByName(active)


def check_transitions(events: DataFrame) -> DataFrame:
    """Events with an error: unknown_state, reserved_fields (keys of an optional map column ``fields``), after_terminal_state, or
    illegal_transition, where a state may not follow the one before it in the log."""
    w = W.partitionBy("document").orderBy("at", "ordinal")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    e = events.withColumns({"previous": F.lag("state").over(w), "ended": F.coalesce(F.max(F.col("state").isin(*TERMINAL)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))})
    known = F.coalesce(F.col("state").isin(*TRANSITIONS, *TERMINAL), F.lit(False))
    legal = (F.col("state") == "discovered") | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("previous")), F.col("state")), F.lit(False))
    reserved = F.coalesce(F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, RESERVED))), F.lit(False)) if "fields" in events.columns else F.lit(False)
    return e.withColumn("error", F.when(~known, "unknown_state").when(reserved, "reserved_fields").when(F.col("ended"), "after_terminal_state").when(~legal, "illegal_transition"))


def run_summary(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: documents found, accepted, processed (by the last state), with observations (last observations_count over 0,
    where there is such a column), unresolved, with errors, rejected, published; events; coverage complete / partial / none."""
    by = by or []
    order = F.struct("at", "ordinal")
    seen = F.max_by("observations_count", F.when(F.col("observations_count").isNotNull(), order)) if "observations_count" in events.columns else F.lit(None).cast("long")
    last = events.groupBy(*by, "document").agg(F.max_by("state", order).alias("last"), F.max(F.col("state") == "accepted").alias("accepted"), seen.alias("observations"), F.count(F.lit(1)).alias("n"))
    ends = {"unresolved": "unresolved", "errors": "extraction_error", "rejected": "rejected", "published": "published"}
    g = last.groupBy(*by).agg(
        F.count(F.lit(1)).alias("found"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("last").isin(*PROCESSED)).alias("processed"), F.count_if(F.col("observations") > 0).alias("with_observations"),
        *[F.count_if(F.col("last") == s).alias(n) for n, s in ends.items()], F.sum("n").alias("events"),
    )
    return g.withColumn("coverage", F.when(F.col("processed") == 0, "none").when(F.col("processed") == F.col("found"), "complete").otherwise("partial"))


def quality_report(obs: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company: valid, quarantined and zero observations, and class valid / quarantined_only / not_found."""
    g = obs.groupBy("ticker").agg(F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status").startswith("quarantined")).alias("quarantined"), F.count_if((F.col("status") == "valid") & (F.col("value") == 0)).alias("zero"))
    j = companies.join(g, "ticker", "left").fillna(0, ["valid", "quarantined", "zero"])
    return j.withColumn("class", F.when(F.col("valid") > 0, "valid").when(F.col("quarantined") > 0, "quarantined_only").otherwise("not_found"))


def sector_quality_report(obs: DataFrame, companies: DataFrame, sector: list[str] | None = None) -> DataFrame:
    """One row for each sector: companies requested, with valid observations, not found, quarantined only; valid,
    quarantined and zero observations; number of valid observations by unit (scales); status and warnings.

    ``companies``: sector, ticker, snapshot_status (null: none). ``obs``: ticker, validation_status (null: valid), confidence,
    value, unit, raw_unit. Valid rows have high or medium confidence. A sector without a company that has one fails the gate.
    """
    key = sector or ["sector"]
    valid = (F.coalesce("validation_status", F.lit("valid")) == "valid") & F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))
    held = F.coalesce(F.col("validation_status").startswith("quarantined"), F.lit(False))
    unit = F.coalesce(F.nullif(F.col("raw_unit"), F.lit("")), F.nullif(F.col("unit"), F.lit("")), F.lit("unknown"))
    rows = companies.select(*key, "ticker").distinct().join(obs, "ticker").withColumns({"__v": valid, "__q": held, "__u": unit})
    per = rows.groupBy(*key, "ticker").agg(F.count_if("__v").alias("v"), F.count_if("__q").alias("h"), F.count_if(F.col("__v") & (F.col("value") == 0)).alias("z"))
    scales = rows.filter("__v").groupBy(*key, "__u").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__u", "n")))).alias("scales_detected"))
    asked = companies.groupBy(*key, "ticker").agg(F.max(F.coalesce(F.col("snapshot_status") == "not_found", F.lit(False))).alias("lost"))
    j = asked.join(per, key + ["ticker"], "left").fillna(0, ["v", "h", "z"])
    lost = F.col("lost")
    g = j.groupBy(*key).agg(
        F.count(F.lit(1)).alias("companies_requested"), F.count_if(~lost & (F.col("v") > 0)).alias("companies_with_valid_observations"), F.count_if(lost).alias("companies_not_found"),
        F.count_if(~lost & (F.col("v") == 0) & (F.col("h") > 0)).alias("companies_quarantined_only"), F.sum("v").alias("valid_observations"), F.sum("h").alias("quarantined_observations"), F.sum("z").alias("zero_observations"),
    )
    partial = F.when(F.col("companies_with_valid_observations") < F.col("companies_requested"), "partial_coverage")
    status = F.when(F.col("companies_with_valid_observations") == 0, "failed_quality_gate").otherwise("success")
    return g.join(scales, key, "left").withColumns({"warning": partial, "status": status})


def observation_coverage(obs: DataFrame) -> DataFrame:
    """Sorted periods and metrics of each ticker's valid observations of high or medium confidence. ``obs``: ticker, metric, period, validation_status, confidence."""
    valid = obs.filter((F.coalesce("validation_status", F.lit("valid")) == "valid") & F.col("confidence").isin("high", "medium"))
    return valid.groupBy("ticker").agg(F.array_sort(F.collect_set(F.nullif(F.col("period"), F.lit("")))).alias("periods"), F.array_sort(F.collect_set(F.nullif(F.col("metric"), F.lit("")))).alias("metrics"))


def reconcile_manifest(listed: DataFrame, physical: DataFrame, key: str, digest: str) -> DataFrame:
    """missing, unlisted, mismatch or ok for every listed or physical file."""
    a, b = listed.select(key, F.col(digest).alias("__a")), physical.select(key, F.col(digest).alias("__b"))
    return a.join(b, key, "full").select(key, F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unlisted").when(F.col("__a") != F.col("__b"), "mismatch").otherwise("ok").alias("status"))


def merge_manifest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New records over old ones by key."""
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    return best_row(both, key, [F.col("__g").desc(), F.col("ordinal").desc()]).drop("__g")


def leak_scan(df: DataFrame, terms: list[str], column: str = "text") -> DataFrame:
    """Rows that hold a blocked term, with the first of them."""
    hit = F.try_element_at(F.filter(F.array(*map(F.lit, terms)), lambda t: F.col(column).contains(t)), F.lit(1))
    return df.withColumn("term", hit).filter("term is not null")


def sanitize(df: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Literal replacements, in the order given, in every string at any depth of structs, arrays and map values; keys, names and other types stay.

    Nulls stay null at every level, empty strings to be replaced are passed over. The columns are rewritten from the schema, so
    there is no user function; columns without a string below them are not touched.
    """

    def rewrite(c: Column, kind: DataType) -> Column | None:
        if isinstance(kind, StringType):
            for old, new in replacements.items():
                if old:
                    c = F.replace(c, F.lit(old), F.lit(new))
            return c
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: rewrite(x, kind.elementType)) if _holds_strings(kind) else None
        if isinstance(kind, MapType):
            return F.transform_values(c, lambda _, v: rewrite(v, kind.valueType)) if _holds_strings(kind) else None
        if isinstance(kind, StructType) and _holds_strings(kind):
            fields = [(rewrite(c.getField(f.name), f.dataType) if _holds_strings(f.dataType) else c.getField(f.name)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        return None

    return df.select(*[(rewrite(F.col(_quoted(f.name)), f.dataType).alias(f.name) if _holds_strings(f.dataType) else F.col(_quoted(f.name))) for f in df.schema.fields])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _holds_strings(kind: DataType) -> bool:
    """A string anywhere below, but for the keys of maps."""
    if isinstance(kind, StructType):
        return any(_holds_strings(f.dataType) for f in kind.fields)
    inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType if isinstance(kind, MapType) else None
    return isinstance(kind, StringType) if inner is None else _holds_strings(inner)


def coverage(obs: DataFrame, companies: DataFrame) -> DataFrame:
    """One row: requested, with and without observations, rejected, status."""
    g = obs.groupBy("ticker").agg(F.count_if(F.col("confidence") != "low").alias("ok"), F.count_if(F.col("confidence") == "low").alias("rejected"))
    j = companies.join(g, "ticker", "left")
    s = j.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("ok") > 0).alias("with_observations"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"))
    return s.withColumn("status", F.when(F.col("with_observations") == F.col("requested"), "complete").when(F.col("with_observations") > 0, "partial").otherwise("not_applicable"))


def catalog(files: DataFrame, content: str = "content", origin: str = "origin") -> DataFrame:
    """sha256, 20-digit short id, size and stable id = sha256(origin, NUL, content hash)."""
    digest = F.sha2(F.col(content), 256)
    return files.withColumns({"sha256": digest, "short_id": F.substring(digest, 1, 20), "size": F.octet_length(F.col(content)), "stable_id": F.sha2(F.concat(F.col(origin), F.lit("\u0000"), digest), 256)})


def validate_overrides(df: DataFrame, registry: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows with a registered ticker of the same sector, a known metric, a quarter and a finite number. ``registry``: ticker, sector."""
    ok = F.col("metric").isin(*metrics) & F.col("q").between(1, 4) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.abs(F.col("value").cast("double")) < float("inf"))
    return df.filter(ok).join(registry.select("ticker", "sector").distinct(), ["ticker", "sector"], "left_semi")


def parse_overrides(df: DataFrame, registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Raw manual records with canonical ticker, metric, period and number; ``error`` names the first thing that is wrong.

    ``df``: ticker, sector (null: the company's), metric, period, value (text). ``registry``: ticker, alias, sector, with one row
    for every spelling (the ticker itself included). ``metrics``: sector, metric, alias. Spellings compare without case; periods
    are 1T26 / 1Q2026, FY26 / FY2026 or 2026; numbers have digits, points and commas - with a comma, points are thousands.
    Errors: unknown_ticker, sector_mismatch, unknown_metric, bad_period, bad_value. Both rule tables have a fixed size.
    """
    fold = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    names = registry.select(fold(F.col("alias")).alias("__alias"), F.col("ticker").alias("__ticker"), F.lower("sector").alias("__sector")).dropDuplicates(["__alias"])
    kinds = metrics.select(F.lower("sector").alias("__ms"), fold(F.col("alias")).alias("__ma"), F.col("metric").alias("__metric")).dropDuplicates(["__ms", "__ma"])
    own = F.coalesce(F.nullif(F.lower(F.trim("sector")), F.lit("")), F.col("__sector"))
    j = df.join(names, fold(F.col("ticker")) == F.col("__alias"), "left").withColumn("__own", own)
    j = j.join(kinds, (F.col("__own") == F.col("__ms")) & (fold(F.col("metric")) == F.col("__ma")), "left")
    p = F.regexp_replace(fold(F.col("period")), " ", "")
    q, fy = r"^([1-4])[TQ]([0-9]{2})?([0-9]{2})$", r"^FY(20)?([0-9]{2})$"
    period = F.when(p.rlike(q), F.concat(F.regexp_extract(p, q, 1), F.lit("T"), F.regexp_extract(p, q, 3))).when(p.rlike(fy), F.concat(F.lit("FY20"), F.regexp_extract(p, fy, 2))).when(p.rlike("^20[0-9]{2}$"), p)
    t = F.trim(F.col("value").cast("string"))
    local = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    number = F.when(t.rlike(r"^-?[0-9.,]+$"), local.try_cast("double"))
    error = (
        F.when(F.col("__ticker").isNull(), "unknown_ticker").when(F.col("__own") != F.col("__sector"), "sector_mismatch").when(F.col("__metric").isNull(), "unknown_metric")
        .when(period.isNull(), "bad_period").when(number.isNull() | (F.abs(number) == float("inf")), "bad_value")
    )
    made = {"ticker": F.coalesce("__ticker", "ticker"), "sector": F.col("__own"), "metric": F.coalesce("__metric", "metric"), "period": F.coalesce(period, F.col("period")), "value": number, "error": error}
    out = j.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[v.alias(f"__out_{k}") for k, v in made.items()])
    return out.withColumnsRenamed({f"__out_{k}": k for k in made})


def merge_manifest_scope(previous: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """``all``: the current rows and old overrides; ``financial``: current financial rows over old others; ``operational``: the union. Rows: component, path."""
    if scope == "all":
        return current.unionByName(previous.filter("component = 'override'")).distinct()
    if scope == "financial":
        return previous.filter("component not in ('financial', 'chart')").unionByName(current.filter("component in ('financial', 'chart')")).distinct()
    return previous.unionByName(current.filter("component = 'operational'")).distinct()


def comparison_table(indicators: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per company and metric with the latest period that has a value. ``indicators``: company, year, q and the metrics."""
    long = indicators.select("company", "year", "q", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("company", "year", "q", "m.*")
    top = long.groupBy("company", "metric").agg(F.max_by(F.struct("year", "q", "value"), F.when(F.col("value").isNotNull(), F.struct("year", "q"))).alias("t"))
    return top.select("company", "metric", "t.year", "t.q", "t.value")


# Margins of the comparison, and states of a quality flag that take their value away.
COMPARED_MARGINS = ("margem_bruta", "margem_operacional", "margem_ebitda", "margem_liquida")
_NO_VALUE = ("incomplete", "not_comparable")


def comparison_payload(registry: DataFrame, records: DataFrame, cycles: DataFrame, variations: DataFrame, units: DataFrame) -> DataFrame:
    """The twelve compared metrics of every company, each with its own latest valid period.

    ``registry``: company. ``records``: company, year, q, is_ytd, receita_liquida, lucro_liquido, the four margins,
    ev_ebitda_ltm, quality_flags (array of metric, status, message). ``cycles``: company, start, end, cycle.
    ``variations``: company, horizon (30, 90, 360), change_pct. ``units``: company, period, value, confidence, year, q.
    Growth runs from the first to the last annual record by calendar years; margins come from the last annual record and go
    where its flag is incomplete or not comparable; EV/EBITDA is the last record with a value; the cycle is that of the last
    whole calendar year. Result: company, metric, value, period, quality, confidence.
    """
    annual = records.filter("is_ytd and q = 4")
    growth = cagr_years(annual, ["receita_liquida", "lucro_liquido"], ["company"])
    span = F.when(F.col("last_year") > F.col("first_year"), F.concat_ws("–", F.col("first_year").cast("string"), F.col("last_year").cast("string")))
    cell = lambda m, v, p, q=None, c=None: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), p.alias("period"), (F.lit(None).cast("string") if q is None else q).alias("quality"), (F.lit(None).cast("string") if c is None else c).alias("confidence"))
    last = annual.groupBy("company").agg(F.max_by(F.struct("year", "quality_flags", *COMPARED_MARGINS), "year").alias("r"))
    valued = records.filter("ev_ebitda_ltm is not null")
    ev = valued.groupBy("company").agg(F.max_by(F.struct("year", "q", "ev_ebitda_ltm"), F.struct("year", "q", "is_ytd")).alias("e"))
    whole = cycles.filter((F.date_format("start", "MM-dd") == "01-01") & (F.date_format("end", "MM-dd") == "12-31"))
    cyc = whole.groupBy("company").agg(F.max_by(F.struct("end", "cycle"), "end").alias("c"))
    var = variations.groupBy("company").agg(*[F.max(F.when(F.col("horizon") == h, F.col("change_pct"))).alias(f"d{h}") for h in (30, 90, 360)])
    kept = units.filter("value is not null and coalesce(confidence, '') <> 'low'")
    unit = kept.groupBy("company").agg(F.max_by(F.struct("value", "period", "confidence"), F.struct("year", F.coalesce("q", F.lit(5)))).alias("u"))
    j = registry.select("company").distinct()
    for side in (growth, last, ev, cyc, var, unit):
        j = j.join(side, "company", "left")
    fy = F.when(F.col("r.year").isNotNull(), F.concat(F.lit("FY"), F.col("r.year").cast("string")))

    def margin(m: str) -> Column:
        flag = F.try_element_at(F.filter("r.quality_flags", lambda f: f["metric"] == m), F.lit(1))["status"]
        return cell(m, F.when(~F.coalesce(flag.isin(*_NO_VALUE), F.lit(False)), F.col(f"r.{m}")), fy, flag)

    cells = [
        cell("cagr_receita", F.col("cagr_receita_liquida"), span), cell("cagr_lucros", F.col("cagr_lucro_liquido"), span),
        cell("ciclo_financeiro", F.col("c.cycle"), F.when(F.col("c.end").isNotNull(), F.concat(F.lit("FY"), F.year("c.end").cast("string")))), *[margin(m) for m in COMPARED_MARGINS],
        cell("ev_ebitda", F.col("e.ev_ebitda_ltm"), F.when(F.col("e.year").isNotNull(), F.concat(F.lit("LTM "), F.col("e.q").cast("string"), F.lit("T"), F.lpad((F.col("e.year") % 100).cast("string"), 2, "0")))),
        *[cell(f"delta_preco_{h}d", F.col(f"d{h}"), F.lit("Atual")) for h in (30, 90, 360)],
        cell("n_unidades", F.col("u.value"), F.col("u.period"), c=F.when(F.col("u").isNull(), "not_found").otherwise(F.col("u.confidence"))),
    ]
    return j.select("company", F.explode(F.array(*cells)).alias("m")).select("company", "m.*")


def comparison_charts(records: DataFrame, cycles: DataFrame) -> DataFrame:
    """The five annual series of the comparison: company, chart, period (FY and year), value, quality. Inputs as in ``comparison_payload``."""
    annual = records.filter("is_ytd and q = 4")
    flag = lambda m: F.try_element_at(F.filter("quality_flags", lambda f: f["metric"] == m), F.lit(1))["status"]
    rows = F.array(*[F.struct(F.lit(m).alias("chart"), F.col(m).cast("double").alias("value"), flag(m).alias("quality")) for m in COMPARED_MARGINS])
    margins = annual.select("company", F.concat(F.lit("FY"), F.col("year").cast("string")).alias("period"), F.explode(rows).alias("m")).select("company", "m.chart", "period", "m.value", "m.quality")
    whole = cycles.filter((F.date_format("start", "MM-dd") == "01-01") & (F.date_format("end", "MM-dd") == "12-31"))
    cyc = whole.select("company", F.lit("ciclo_financeiro").alias("chart"), F.concat(F.lit("FY"), F.year("end").cast("string")).alias("period"), F.col("cycle").cast("double").alias("value"), F.lit(None).cast("string").alias("quality"))
    return margins.unionByName(cyc)


def chart_series(indicators: DataFrame, value: str) -> DataFrame:
    """company, year, value in millions and place in the display order."""
    place = F.row_number().over(W.partitionBy("company").orderBy("year"))
    return indicators.select("company", "year", (F.col(value).cast("double") / 1e6).alias("value"), place.alias("place"))


def audit_rows(registry: DataFrame, **blocks: DataFrame) -> DataFrame:
    """One row per company and block (each a table with ``company``): rows and status OK or missing."""
    out = None
    for name, df in blocks.items():
        g = df.groupBy("company").agg(F.count(F.lit(1)).alias("n"))
        part = registry.select("company").join(g, "company", "left").select("company", F.lit(name).alias("block"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").otherwise("OK").alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def validate_snapshots(df: DataFrame, sector: str, required: tuple[str, ...]) -> DataFrame:
    """Array of errors for every snapshot row: another sector, a missing field, no observations without an accepted empty state."""
    errors = F.array(F.when(~F.col("sector").eqNullSafe(F.lit(sector)), F.lit("wrong_sector")), *[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required], F.when((F.coalesce("observations", F.lit(0)) == 0) & ~F.coalesce(F.col("state") == "empty_accepted", F.lit(False)), F.lit("no_observations")))
    return df.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))
