"""Accounts of the cash cycle by sector: codes before descriptions, exclusions, no double counting, current and non-current parts."""

from datetime import date

from fundamentals_spark.operators import cycle, indicators

D0, D1 = date(2024, 12, 31), date(2025, 12, 31)
SCHEMA = "company int, ref_date date, code string, description string, value decimal(38,4), ordinal int, extended boolean"


def rows_of(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(c, d, k, t, None if v is None else Decimal(v), i, x) for i, (c, d, k, t, v, x) in enumerate(rows)], SCHEMA)


def test_general_rule(spark):
    rows = [
        (1, D1, "1.01.09", "Clientes no país", 1, False), (1, D1, "1.01.03", "Outro nome", 2, False), (1, D1, "1.01.03", "Repetida", 3, None), (1, D1, "1.02.01.08", "Contas a receber", 4, False),
        (1, D1, "1.01.08", "ESTOQUE de peças", 5, False), (1, D1, "1.01.07", "Estoques", 6, False), (1, D1, None, None, 7, False),
        (2, D1, "3.01", None, 8, False),
    ]
    got = sorted((r.company, r.kind, r.code, int(r.value), r.current) for r in cycle.cycle_accounts(rows_of(spark, rows)).collect())
    assert got == [(1, "inventories", "1.01.08", 5, True), (1, "receivables", "1.01.03", 2, True)]
    b = {r.company: r for r in cycle.cycle_balances(rows_of(spark, rows)).collect()}
    assert (b[1].receivables, b[1].receivables_current, b[1].receivables_noncurrent, b[1].payables, b[1].payables_current) == (2, 2, 0, None, None)
    assert b[2].receivables is None
    empty = rows_of(spark, rows).limit(0)
    assert cycle.cycle_accounts(empty).count() == 0 and cycle.cycle_balances(empty).count() == 0


def test_extended_rule(spark):
    rows = [
        (1, D1, "1.01.03", "Clientes", 100, True), (1, D1, "1.01.03.01", "Clientes a faturar", 60, True), (1, D1, "1.02.01.08", "Tributos a recuperar", 20, True), (1, D1, "1.02.09", "Recebíveis Imobiliários", 7, True),
        (1, D1, "1.02.10", "Clientes - partes relacionadas", 1000, True), (1, D1, "1.02.11", "Terrenos", 5, True), (1, D1, "1.02.11.01", "Terrenos em estoque", 4, True), (1, D1, "1.02.11.01", "Terrenos em estoque", 4, True),
        (1, D1, "2.02.05", "Aquisição de imóveis", 9, True), (1, D1, "2.02.06", "Debêntures e terrenos a pagar", 900, True), (1, D1, "2.01.02", "x", 1, True),
    ]
    b = cycle.cycle_balances(rows_of(spark, rows)).first()
    # the coded parent counts although a row below it carries another code, which no rule of current accounts names
    assert (b.receivables_current, b.receivables_noncurrent, b.receivables) == (100, 27, 127)
    assert (b.inventories_current, b.inventories_noncurrent, b.inventories) == (0, 8, 8)
    assert (b.payables_current, b.payables_noncurrent, b.payables) == (1, 9, 10)


def test_cycle_of_a_sector(spark):
    rows = [(1, d, k, "x", v, True) for d in (D0, D1) for k, v in (("1.01.03", 100), ("1.02.01.09", 46), ("1.01.04", 73), ("2.01.02", 10), ("2.02.01.02", 63))]
    flows = spark.createDataFrame([(1, date(2025, 1, 1), D1, 730.0, -365.0)], "company int, start date, end date, revenue double, cogs double")
    r = indicators.cash_cycle(cycle.cycle_balances(rows_of(spark, rows)), flows).first()
    assert (r.pmr, r.pme, r.pmp, r.cycle, r.error) == (73.0, 73.0, 73.0, 73.0, None)
