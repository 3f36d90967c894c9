"""Account structure, dense matrices and period arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import account_sort_key, ancestors
from fundamentals_spark.operators.asof import best_row


def master_accounts(df: DataFrame, key: list[str], order: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """All accounts with the description of the most recent row; of rows equal by ``order`` the smallest by ``first`` stands."""
    rows = best_row(df, key, [F.col(c).desc() for c in order] + [F.col(c).asc() for c in first])
    return rows.select(*key, "description").withColumn("sort_key", account_sort_key(F.col("code")))


def master_accounts_mode(df: DataFrame) -> DataFrame:
    """code and its most frequent description; ties go to the latest date, then the alphabet."""
    counts = df.groupBy("code", "description").agg(F.count(F.lit(1)).alias("n"), F.max("ref_date").alias("last"))
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.col("n").desc(), F.col("last").desc(), "description"))
    return counts.withColumn("r", rank).filter("r = 1").select("code", "description", "n")


def dense_matrix(facts: DataFrame, by: list[str], account: str = "code", period: str = "ref_date", value: str = "value") -> DataFrame:
    """Every account for every (company, period) present; absent values stay null. The account list joins by constant key,
    so Spark broadcasts it while it is small and shuffles otherwise."""
    spine = facts.select(*by, period).distinct().join(facts.select(account).distinct(), how="cross")
    return spine.join(facts.groupBy(*by, period, account).agg(F.sum(value).alias(value)), by + [period, account], "left")


def synthetic_accounts(facts: DataFrame, definitions: DataFrame, by: list[str]) -> DataFrame:
    """``facts`` with rows for (synthetic, code) definitions: sums that are null only if every part is null; parts get a parent code."""
    added = facts.join(definitions, "code").groupBy(*by, F.col("synthetic").alias("code")).agg(F.sum("value").alias("value")).withColumn("parent", F.lit(None).cast("string"))
    marked = facts.join(definitions, "code", "left").withColumnRenamed("synthetic", "parent").select(*by, "code", "value", "parent")
    return marked.unionByName(added.select(*by, "code", "value", "parent"))


def leaves_only(df: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """Rows without a descendant among the rows of the same key: an anti join on exploded ancestors, not on prefixes."""
    up = df.select(*by, F.explode(ancestors(F.col(code))).alias(code)).distinct()
    return df.join(up, by + [code], "left_anti")


def root_or_leaf_sum(facts: DataFrame, roots: list[str], by: list[str]) -> DataFrame:
    """For each key and root: the root's own value, or the sum of its leaf descendants where it has none; a root filed twice is an error."""
    codes = F.array(*[F.lit(r) for r in roots])
    at = facts.withColumn("root", F.explode(F.filter(codes, lambda r: (F.col("code") == r) | F.col("code").startswith(F.concat(r, F.lit("."))))))
    own = at.filter("code = root").groupBy(*by, "root").agg(F.count(F.lit(1)).alias("times"), F.max("value").alias("own"))
    below = leaves_only(at.filter("code <> root"), by + ["root"]).groupBy(*by, "root").agg(F.sum("value").alias("leaves"))
    j = own.join(below, by + ["root"], "full")
    return j.select(*by, "root", F.when(F.coalesce("times", F.lit(0)) <= 1, F.when(F.col("times") == 1, F.col("own")).otherwise(F.col("leaves"))).alias("value"), F.when(F.col("times") > 1, "duplicate_root").alias("error"), F.when(F.col("times") >= 1, "root").otherwise("leaves").alias("method"))


def derive_q4(facts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Fourth quarters as full year - first three, where all exist and no fourth is reported. ``facts``: by, year, part (Q1, Q2, Q3, Q4, FY)."""
    part = {p: F.max(F.when(F.col("part") == p, F.col(value))) for p in ("Q1", "Q2", "Q3", "Q4", "FY")}
    g = facts.groupBy(*by, "year").agg(*[v.alias(k) for k, v in part.items()], F.max((F.col("part") == "Q4").cast("int")).alias("has4"))
    return g.filter("has4 = 0 and FY is not null and Q1 is not null and Q2 is not null and Q3 is not null").select(*by, "year", F.lit("Q4").alias("part"), (F.col("FY") - F.col("Q1") - F.col("Q2") - F.col("Q3")).alias(value), F.lit(True).alias("derived"))


def isolate_quarters(facts: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Isolated value of a flow: year-to-date less that of the quarter before (null if it is missing), or as filed; and its source.

    A quarter may have an isolated and a year-to-date row; only year-to-date rows and first quarters are subtracted.
    """
    sums = facts.filter(F.col("is_ytd") | (F.col("q") == 1)).groupBy(*by, "year", "q").agg(F.max_by(metric, F.struct("is_ytd", metric)).alias("p_value"))
    before = sums.select(*[F.col(b).alias(f"p_{b}") for b in by], F.col("year").alias("p_year"), (F.col("q") + 1).alias("p_q"), "p_value")
    ytd = F.col("is_ytd") & (F.col("q") > 1)
    on = [F.col(b) == F.col(f"p_{b}") for b in by] + [F.col("year") == F.col("p_year"), F.col("q") == F.col("p_q"), ytd]
    j = facts.join(before, on, "left")
    return j.select(*by, "year", "q", F.when(ytd, F.col(metric) - F.col("p_value")).otherwise(F.col(metric)).alias(metric), F.when(ytd, "ytd_menos_ytd_anterior").otherwise("periodo_isolado").alias("source"))


def pick_periods(df: DataFrame, view: str, by: list[str]) -> DataFrame:
    """One row for each year (annual: year-to-date fourth quarters) or quarter (isolated ones and first quarters).

    Rows of the same reference year come first (column same_reference_year, if there is one), then full years, then the later
    reference, then the later end, then the higher ordinal.
    """
    if view == "annual":
        rows, key = df.filter("q = 4 and is_ytd"), by + ["year"]
    else:
        rows, key = df.filter("not is_ytd or q = 1"), by + ["year", "q"]
    same = [F.col("same_reference_year").desc()] if "same_reference_year" in df.columns else []
    full = (F.col("is_ytd") & (F.col("q") == 4)).desc()
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*same, full, F.col("ref_date").desc(), F.col("end_date").desc(), F.col("ordinal").desc()))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")


def balance_check(facts: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Account 1 (assets) against account 2 (liabilities and equity) by company and date: difference and OK or VERIFY, also when one is missing."""
    g = facts.groupBy("company", "ref_date").agg(*[F.max(F.when(F.col("code") == c, F.col("value"))).alias(n) for c, n in (("1", "assets"), ("2", "liabilities"))])
    diff = F.col("assets") - F.col("liabilities")
    g = g.filter("assets is not null or liabilities is not null")
    return g.withColumns({"difference": diff, "status": F.when(F.abs(diff) <= tolerance, "OK").otherwise("VERIFY")})


def verify_coverage(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows and dates of every registered company and whether its rows equal the greatest number."""
    g = facts.groupBy("company").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ref_date").alias("n_dates"))
    j = registry.select("company").join(g, "company", "left").fillna(0, ["n_rows", "n_dates"])
    j = j.crossJoin(g.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("__most")))  # one row, one number
    return j.withColumn("status", F.when(F.col("n_rows") == 0, "missing").when(F.col("n_rows") == F.col("__most"), "OK").otherwise("incomplete")).drop("__most")
