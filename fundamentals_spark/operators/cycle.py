"""Accounts of the cash cycle: which balance-sheet rows are receivables, inventories and payables, by rules of the sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import ancestors, norm_text

KINDS = ("receivables", "inventories", "payables")

# General rule of each kind, as (codes, patterns of descriptions).
GENERAL = {
    "receivables": (("1.01.03",), (r"contas? a receber", r"clientes")),
    "inventories": (("1.01.04",), (r"estoques?",)),
    "payables": (("2.01.02",), (r"fornecedores?",)),
}

# Rule of sectors with long cycles, as (current codes, non-current codes, non-current group, patterns of descriptions in
# that group, excluded patterns).
EXTENDED = {
    "receivables": (
        ("1.01.03",), ("1.02.01.08", "1.02.01.09"), "1.02",
        (r"recebiveis imobiliarios", r"recebiveis de clientes", r"clientes", r"contas? a receber"),
        (r"partes relacionadas", r"tribut", r"aplicac", r"valor justo"),
    ),
    "inventories": (
        ("1.01.04",), ("1.02.01.04", "1.02.01.05", "1.02.01.06"), "1.02",
        (r"estoques?", r"imoveis a comercializar", r"imoveis em construcao", r"unidades em construcao", r"terrenos"),
        (r"propriedades para investimento", r"investimentos?", r"imobilizado", r"intangivel", r"tribut"),
    ),
    "payables": (
        ("2.01.02",), ("2.02.01.01", "2.02.01.02"), "2.02",
        (r"fornecedores?", r"terrenos? a pagar", r"aquisicao de terrenos?", r"aquisicao de imoveis", r"contas a pagar por aquisicao"),
        (r"emprestimos?", r"financiamentos?", r"debentures", r"provis", r"tribut", r"partes relacionadas"),
    ),
}

# Groups whose accounts are current.
CURRENT = ("1.01", "2.01")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def _counted(bp: DataFrame) -> DataFrame:
    """The rows of ``cycle_accounts`` and, with a null kind, rows that count for nothing, so that no company and date is lost.

    One pass over ``bp`` and one shuffle: both rules are windows of one key, whose rows are one balance sheet's accounts of a kind.
    """
    text, code, wide = norm_text(F.col("description"), "fold"), F.col("code"), F.coalesce("extended", F.lit(False))
    tests = []
    for k in KINDS:
        codes, named = GENERAL[k]
        short, long, group, described, excluded = EXTENDED[k]
        exact = F.coalesce(code.isin(*codes), F.lit(False))
        coded = F.coalesce(code.isin(*short, *long), F.lit(False))
        inside = F.coalesce(code.startswith(group), F.lit(False)) & ~_any(text, excluded) & _any(text, described)
        hit = F.when(wide, coded | inside).otherwise(exact | _any(text, named))
        tests.append(F.struct(F.lit(k).alias("kind"), hit.alias("hit"), exact.alias("exact")))
    hits = bp.withColumn("extended", wide).withColumn("__k", F.explode_outer(F.filter(F.array(*tests), lambda t: t["hit"]))).withColumns({"kind": F.col("__k.kind"), "exact": F.col("__k.exact")})
    one = W.partitionBy("company", "ref_date", "kind", "extended")
    place = F.row_number().over(one.orderBy(F.col("exact").desc(), F.col("ordinal").asc(), code.asc(), F.col("description").asc()))
    above = F.flatten(F.collect_set(F.when(F.col("extended"), ancestors(code))).over(one))
    is_leaf = ~F.coalesce(F.array_contains("__above", code), F.lit(False))
    rows = hits.withColumns({"__place": place, "__above": above}).filter(F.when(F.col("extended"), is_leaf).otherwise(F.col("__place") == 1))
    is_current = F.coalesce(code.startswith(CURRENT[0]) | code.startswith(CURRENT[1]), F.lit(False))
    return rows.select("company", "ref_date", "extended", "kind", "code", "description", "value", is_current.alias("current"))


def cycle_accounts(bp: DataFrame) -> DataFrame:
    """The counted rows: company, ref_date, extended, kind, code, description, value, current.

    ``bp``: company, ref_date, code, description, value, ordinal (place in the document), extended (the company's sector has a long
    cycle; null is no). Otherwise the first row with the kind's code counts, or, where no row of the date has it, the first
    one whose folded description matches (equal places: the smaller code, then description). With it, all rows with a current or non-current code, and described ones of the
    non-current group unless excluded, less those above another counted row. Kinds are tested as expressions on each row:
    no join with rules. Null codes and descriptions match nothing; rows without a value count as rows and leave the value null.
    """
    return _counted(bp).filter("kind is not null")


def cycle_balances(bp: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """receivables, inventories, payables of every company and date of ``bp``, each with its current and non-current part, for ``cash_cycle``.

    A kind without a counted row is null, which ``cash_cycle`` reports as a missing balance; a part without rows is 0 beside the other.
    """
    key = ["company", "ref_date"]
    rows = _counted(bp) if accounts is None else accounts
    money = lambda c: F.sum(F.when(c, F.col("value"))).cast("decimal(38,4)")
    sums, zero = [], F.lit(0).cast("decimal(38,4)")
    for k in KINDS:
        of = F.col("kind") == k
        total = money(of)
        part = lambda c, total=total: F.when(total.isNotNull(), F.coalesce(money(c), zero))
        sums += [total.alias(k), part(of & F.col("current")).alias(f"{k}_current"), part(of & ~F.col("current")).alias(f"{k}_noncurrent")]
    totals = rows.groupBy(*key).agg(*sums)
    return totals if accounts is None else bp.select(*key).distinct().join(totals, key, "left")
