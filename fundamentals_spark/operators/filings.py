"""Selection of filings: identity, scope, exercise order, last version, restatement, share capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import norm_text
from fundamentals_spark.operators.asof import best_row


def keeps_order(word: Column, mode: str) -> Column:
    """Whether a row with this order word stays in the mode (see ``filter_order``); ``contains`` keeps whatever another mode does."""
    t = norm_text(word, "upper")
    return {"exact": t == "ULTIMO", "not_previous": t.contains("ULTIMO") & ~t.contains("PENULTIMO"), "contains": t.contains("ULTIMO")}[mode]


def filter_order(df: DataFrame, column: str = "order_word", mode: str = "exact") -> DataFrame:
    """Current-exercise rows. ``exact``: the word is ULTIMO; ``not_previous``: contains it and not PENULTIMO; ``contains``: contains it, so comparatives stay."""
    return df.filter(keeps_order(F.col(column), mode))


def latest_version(df: DataFrame, by: list[str], account: list[str], version: str = "version", tiebreak: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Rows of the greatest version for each ``by``, then one for each account: the one greatest by ``tiebreak``, which must end in something unique."""
    top = df.withColumn("__top", F.max(version).over(W.partitionBy(*by))).filter(F.col(version) == F.col("__top")).drop("__top")
    return best_row(top, by + account, [F.col(c).desc() for c in tiebreak])


def latest_restatement(df: DataFrame, key: list[str], order: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the greatest by ``order``, of equal ones the smallest by ``first``."""
    return best_row(df, key, [F.col(c).desc() for c in order] + [F.col(c).asc() for c in first])


def latest_cash_flow(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the last version for each company and date, errors): one date must not mix the direct and indirect method."""
    w = W.partitionBy("company", "ref_date")
    top = df.withColumn("__v", F.max("version").over(w)).filter("version = __v").drop("__v")
    mixed = top.groupBy("company", "ref_date").agg(F.countDistinct("method").alias("n")).filter("n > 1").select("company", "ref_date", F.lit("mixed_cash_flow_methods").alias("error"))
    return top.join(mixed.select("company", "ref_date"), ["company", "ref_date"], "left_anti"), mixed


def resolve_issuer(filings: DataFrame, registry: DataFrame) -> DataFrame:
    """Filing rows with company, match and error. ``registry``: company, cvm_code, cnpj. Two equi joins instead of one with OR.

    match is cd_cvm, or cnpj_fallback where the code is missing; a code and a CNPJ of different companies give identity_conflict, no match gives not_registered.
    """
    by_code = registry.select(F.col("company").alias("by_code"), "cvm_code")
    by_cnpj = registry.select(F.col("company").alias("by_cnpj"), "cnpj")
    j = filings.join(by_code, "cvm_code", "left").join(by_cnpj, "cnpj", "left")
    conflict = F.col("by_code").isNotNull() & F.col("by_cnpj").isNotNull() & (F.col("by_code") != F.col("by_cnpj"))
    conflict = conflict | (F.col("cvm_code").isNotNull() & F.col("by_code").isNull() & F.col("by_cnpj").isNotNull())
    return j.withColumns({
        "company": F.when(~conflict, F.coalesce("by_code", "by_cnpj")), "match": F.when(~conflict & F.col("by_code").isNotNull(), "cd_cvm").when(~conflict & F.col("by_cnpj").isNotNull(), "cnpj_fallback"),
        "error": F.when(conflict, "identity_conflict").when(F.coalesce("by_code", "by_cnpj").isNull(), "not_registered"),
    }).drop("by_code", "by_cnpj")


def resolve_companies(filings: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filing rows with company and match, report of every company of ``registry``: company, rows, match, error).

    A company's rows are those of its code or its CNPJ. It is blocked as a whole, with all of its rows: identity_conflict, if it has rows
    of both and one of its code has a foreign CNPJ or one of its CNPJ a foreign code; mixed_identities, if its rows hold more
    than one pair of code and CNPJ; company_not_found, if it has none. match is cd_cvm where any row has the code, else cnpj_fallback.
    """
    reg = registry.select("company", F.col("cvm_code").alias("__code"), F.col("cnpj").alias("__cnpj"))
    same_code, same_cnpj = F.col("cvm_code").eqNullSafe(F.col("__code")), F.col("cnpj").eqNullSafe(F.col("__cnpj"))
    coded = filings.join(reg, F.col("cvm_code") == F.col("__code"))
    rows = coded.unionByName(filings.join(reg, F.col("cnpj") == F.col("__cnpj")).filter(~same_code))
    stats = rows.groupBy("company").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(same_code).alias("coded"), F.count_if(same_cnpj).alias("known"), F.count_if((same_code & F.col("cnpj").isNotNull() & ~same_cnpj) | (same_cnpj & F.col("cvm_code").isNotNull() & ~same_code)).alias("foreign"),
        F.countDistinct(F.coalesce("cvm_code", F.lit("")), F.coalesce("cnpj", F.lit(""))).alias("pairs"),
    )
    error = F.when(F.col("rows").isNull(), "company_not_found").when((F.col("coded") > 0) & (F.col("known") > 0) & (F.col("foreign") > 0), "identity_conflict").when(F.col("pairs") > 1, "mixed_identities")
    report = registry.select("company").join(stats, "company", "left").withColumn("error", error)
    report = report.select("company", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("error").isNull(), F.when(F.col("coded") > 0, "cd_cvm").otherwise("cnpj_fallback")).alias("match"), "error")
    return rows.drop("__code", "__cnpj").join(report.filter("error is null").select("company", "match"), "company"), report


def near_names(names: DataFrame, filings: DataFrame, most: int = 10) -> DataFrame:
    """company, name, shared, rank: up to ``most`` filers whose names share a word of five letters or more with one of the company's.

    ``names``: company, name; ``filings``: name (and more). An index of words on both sides, joined by word; more shared words come first.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(norm_text(F.col(c), "token"), " "), lambda w: F.length(w) >= 5)))
    own = names.select("company", words("name").alias("word")).distinct()
    theirs = filings.select("name").distinct().select("name", words("name").alias("word"))
    shared = own.join(theirs, "word").groupBy("company", "name").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(W.partitionBy("company").orderBy(F.desc("shared"), "name"))
    return shared.withColumn("rank", rank).filter(F.col("rank") <= most)


def select_scope(df: DataFrame, scope: str = "scope") -> DataFrame:
    """Consolidated rows where a company and date have any, else all."""
    is_con = norm_text(F.col(scope), "fold").contains("consolid")
    return df.withColumn("__c", is_con).withColumn("__any", F.max("__c").over(W.partitionBy("company", "ref_date"))).filter("__c or not __any").drop("__c", "__any")


def select_registered_scope(df: DataFrame, registry: DataFrame, scope: str = "scope") -> DataFrame:
    """Rows in the scope that the company's registry entry asks for (company, statement_scope: consolidado, individual or
    auto; null or absent: auto, which is ``select_scope``). A company without rows in its scope on a date keeps one row there, with error scope_not_found and no value."""
    wanted = registry.groupBy("company").agg(F.max(F.lower(F.trim("statement_scope"))).alias("__want"))
    text, want = norm_text(F.col(scope), "fold"), F.col("__want")
    con, ind = F.coalesce(text.contains("consolid"), F.lit(False)), F.coalesce(text.contains("individual"), F.lit(False))
    auto = F.coalesce(~want.isin("consolidado", "individual"), F.lit(True))
    # what each date has is counted before its rows meet it, so a date's rows are nowhere sorted or held together
    has = df.groupBy("company", "ref_date").agg(F.max(con).alias("__con"), F.max(ind).alias("__ind")).join(wanted, "company", "left")
    dates = has.select(F.col("company").alias("__company"), F.col("ref_date").alias("__ref_date"), "__con", auto.alias("__auto"), (want == "consolidado").alias("__wants_con"), (~auto & ~F.when(want == "consolidado", F.col("__con")).otherwise(F.col("__ind"))).alias("__none"))
    j = df.join(dates, F.col("company").eqNullSafe(F.col("__company")) & F.col("ref_date").eqNullSafe(F.col("__ref_date")))
    fits = F.when(F.col("__auto"), con | ~F.col("__con")).when(F.col("__wants_con"), con).otherwise(ind)
    first = best_row(j.filter("__none"), ["company", "ref_date"], [F.col(c).asc() for c in ("code", "ordinal") if c in df.columns] + [F.col(scope).asc()])
    missing = first.withColumns({"value": F.lit(None).cast(df.schema["value"].dataType), "scope_error": F.lit("scope_not_found")})
    return j.filter(~F.col("__none") & fits).withColumn("scope_error", F.lit(None).cast("string")).unionByName(missing).select(*df.columns, "scope_error")


def quarter_spine(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row for each row of ``df`` and quarter end between two dates."""
    first = F.trunc(start, "quarter")
    days = F.transform(F.sequence(first, end, F.expr("interval 3 months")), lambda d: F.last_day(F.add_months(d, 2)))
    return df.withColumn("ref_date", F.explode(F.filter(days, lambda d: d <= end)))


def latest_share_capital(df: DataFrame, spine: DataFrame) -> DataFrame:
    """The capital row with the greatest (version, is_dfp) on a (company, ref_date) spine; status missing where none is."""
    best = df.groupBy("company", "ref_date").agg(F.max_by("shares", F.struct("version", "is_dfp")).alias("shares"))
    return spine.join(best, ["company", "ref_date"], "left").withColumn("status", F.when(F.col("shares").isNull(), "missing").otherwise("reported"))


def account_key(code: Column, description: Column, fixed: Column) -> Column:
    """Code and FIXED, or code and normalised description for accounts that are not fixed."""
    return F.concat_ws("|", code, F.when(fixed == "S", F.lit("FIXED")).otherwise(norm_text(description, "fold")))


def canonicalize_ticker(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of a legacy ticker move to the current one, unless that one has rows. ``aliases``: legacy, ticker."""
    have = df.select(F.col("ticker").alias("current")).distinct()
    usable = aliases.join(have, F.col("ticker") == F.col("current"), "left_anti").select("legacy", F.col("ticker").alias("to"))
    return df.join(usable, F.col("ticker") == F.col("legacy"), "left").withColumn("ticker", F.coalesce("to", "ticker")).drop("legacy", "to")


def apply_scale(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """``value`` times its declared scale; a dated override (company, scale, start, end, factor) multiplies further.

    An unknown word gives error unknown_scale, a date after the last override's end gives scale_override_expired; both null the value.
    """
    word = norm_text(F.col("scale"), "upper")
    base = F.when(word.isin("UNIDADE", "UNIDADES"), 1).when(word.isin("MIL", "MILHAR"), 1000).when(word.isin("MILHAO", "MILHOES"), 1000000)
    o = overrides.select(F.col("company").alias("o_company"), F.col("scale").alias("o_scale"), "start", "end", "factor")
    ends = overrides.groupBy(F.col("company").alias("e_company"), F.col("scale").alias("e_scale")).agg(F.max("end").alias("last_end"))
    j = df.join(o, (F.col("company") == F.col("o_company")) & (F.col("scale") == F.col("o_scale")) & F.col("ref_date").between(F.col("start"), F.col("end")), "left")
    j = j.join(ends, (F.col("company") == F.col("e_company")) & (F.col("scale") == F.col("e_scale")), "left")
    error = F.when(base.isNull(), "unknown_scale").when(F.col("ref_date") > F.col("last_end"), "scale_override_expired")
    out = F.when(error.isNull(), F.col("value") * base * F.coalesce("factor", F.lit(1)))
    return j.withColumns({"scaled": out, "error": error}).drop("o_company", "o_scale", "start", "end", "factor", "e_company", "e_scale", "last_end")


def filing_audit(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Per registered company: lines, dates, versions and status missing / OK."""
    a = df.groupBy("company").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("ref_date").alias("dates"), F.array_join(F.array_sort(F.collect_set(F.col("version").cast("string"))), ",").alias("versions"))
    return registry.select("company").join(a, "company", "left").select("company", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("dates", F.lit(0)).alias("dates"), "versions", F.when(F.col("lines").isNull(), "missing").otherwise("OK").alias("status"))


def method_audit(df: DataFrame, spine: DataFrame) -> DataFrame:
    """company, file_year, methods, lines, ref_dates, versions and status for each row of ``spine`` (company, file_year).

    ``df``: company, file_year, ref_date, version, method. ``methods`` names each method once, by its first date (methods of one
    date by name), joined by arrows. Status is ``missing``, ``OK`` or ``OK_method_transition``; null dates and versions are not
    listed, a null method counts for nothing. Lists hold the distinct values of one company and year; lines are counted
    before that, so a company with many lines is no large group.
    """
    by = ["company", "file_year"]
    lines = df.groupBy(*by, "method", "ref_date", "version").agg(F.count(F.lit(1)).alias("n"))
    first = F.transform(F.array_sort(F.collect_set(F.when(F.col("method").isNotNull(), F.struct("since", "method")))), lambda x: x["method"])
    since = F.min("ref_date").over(W.partitionBy(*by, "method"))
    g = lines.withColumn("since", since).groupBy(*by).agg(
        F.array_join(first, " -> ").alias("methods"), F.size(first).alias("__m"), F.sum("n").alias("lines"),
        F.array_join(F.array_sort(F.collect_set("ref_date")).cast("array<string>"), ", ").alias("ref_dates"), F.array_join(F.array_sort(F.collect_set("version")).cast("array<string>"), ", ").alias("versions"),
    )
    status = F.when(F.col("lines").isNull(), "missing").when(F.col("__m") > 1, "OK_method_transition").otherwise("OK")
    return spine.select(*by).join(g, by, "left").select(*by, "methods", F.coalesce("lines", F.lit(0)).alias("lines"), "ref_dates", "versions", status.alias("status"))
