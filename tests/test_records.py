"""JSON of any shape becomes one kind of row; a plain recursive walk is the judge."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.sources import files, records


def rows(spark, *docs, **kw):
    texts = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(texts, "id int, j string")
    return [tuple(r) for r in records.flatten_json_records(df, "j", ["id"], **kw).select("id", "ticker", "scope", "code", "description", "start", "period", "value", "error").collect()]


def test_flat_grouped_and_nested_forms_give_equal_facts(spark):
    flat = [{"codigo": "1.01", "descricao": "Caixa", "periodo": "2025", "valor": 10}, {"codigo": "1.01", "descricao": "Caixa", "periodo": "2026", "valor": "1.234,5"}]
    grouped = {"periodos": [{"data": "2025", "contas": [{"CD_CONTA": "1.01", "DS_CONTA": "Caixa", "VL_CONTA": 10}]}, {"data": "2026", "grupo": {"x": {"y": [{"cd_conta": "1.01", "ds_conta": "Caixa", "vl_conta": 1234.5}]}}}]}
    nested = {"kind": "bp", "companies": {"ABC3": {"scope": "con", "rows": [{"code": "1.01", "description": "Caixa", "values": {"2025": 10, "2026": 1234.5, "2027": None}}]}}}
    got = rows(spark, flat, grouped, nested)
    facts = {("1.01", "Caixa", "2025", 10.0), ("1.01", "Caixa", "2026", 1234.5)}
    for i in range(3):
        assert sorted((r[3], r[4], r[6], r[7]) for r in got if r[0] == i) == sorted(facts)
    assert {(r[1], r[2]) for r in got if r[0] == 2} == {("ABC3", "con")} and {r[1] for r in got if r[0] < 2} == {None}
    df = spark.createDataFrame([(json.dumps(nested),)], "j string")
    typed = df.select(F.from_json("j", files.STATEMENT_DOCUMENT).alias("d")).select("d.*")
    a = files.flatten_statements(typed).select("kind", "ticker", "scope", "code", "description", "period", "value").collect()
    b = records.flatten_json_records(df, "j", []).select("kind", "ticker", "scope", "code", "description", "period", "value").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_periods_of_result_documents_come_from_their_dates(spark):
    doc = {"companies": {"A": {"tipo_dre": "ind", "period_metadata": {"1T26": {"start_date": "2026-01-01", "end_date": "2026-03-31"}}, "rows": [{"code": "3.01", "description": "Receita", "values": {"1T26": 7, "2T26": 8}}]}}}
    assert sorted(rows(spark, doc), key=str) == [(0, "A", "ind", "3.01", "Receita", "2026-01-01", "2026-03-31", 7.0, None), (0, "A", "ind", "3.01", "Receita", None, "2T26", 8.0, None)]


def test_errors_and_what_gives_no_row(spark):
    one = {"conta": "1", "valor": 5}
    got = rows(spark, "{bad", None, "", "[]", "7", {"a": [1, "x", None]}, one, {"a": {"b": [one]}}, {"conta": "1", "valor": None, "inner": [one]}, {"conta": None, "valor": 3, "date": "2020"})
    assert [(r[0], r[8]) for r in sorted(got, key=lambda r: r[0])] == [(0, "not_json"), (2, "not_json"), (6, "no_period"), (7, "no_period")]
    assert [[(r[3], r[8]) for r in rows(spark, {"a": {"b": [one]}}, depth=d)] for d in (2, 3)] == [[(None, "too_deep")], [("1", "no_period")]]
    assert records.flatten_json_records(spark.createDataFrame([], "id int, j string"), "j", ["id"]).count() == 0


@pytest.mark.parametrize(("given", "number"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("(3,5)", -3.5), ("-", None), ("nan", None), ("12d", None), (True, None), (2, 2.0), ("1.234", 1.234), (" 7 ", 7.0), ("1e3", 1000.0), ([1], None)])
def test_numbers(spark, given, number):
    got = rows(spark, {"conta": "1", "date": "2020", "valor": given})
    assert [r[7] for r in got] == ([] if number is None else [number])


def test_depth_ignores_brackets_in_texts(spark):
    texts = ['{"a":"[[[{\\"[["}', "[[1],[[2]]]", "", None, json.dumps("x" * 200_000 + '"[' * 1000)]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r[0] for r in df.select(records.json_depth(F.col("j"))).collect()] == [1, 3, 0, 0, 0]


def walk(node, period=None):
    if isinstance(node, list):
        for x in node:
            yield from walk(x, period)
    elif isinstance(node, dict):
        period = node.get("periodo") if node.get("periodo") is not None else period
        if node.get("conta") is not None and "valor" in node:
            if node["valor"] is not None:
                yield (node["conta"], period, float(node["valor"]))
        else:
            for x in node.values():
                yield from walk(x, period)


def test_random_trees_against_a_plain_walk(spark):
    rng = random.Random(5)

    def tree(level):
        kind = rng.random()
        if level == 0 or kind < 0.3:
            node = {"conta": str(rng.randrange(5)), "valor": rng.choice([None, 1, 2.5])}
        elif kind < 0.6:
            return [tree(level - 1) for _ in range(rng.randrange(4))]
        else:
            node = {f"k{i}": tree(level - 1) for i in range(rng.randrange(4))}
        if rng.random() < 0.4:
            node["periodo"] = rng.choice([None, "2024", "2025"])
        return node

    docs = [tree(7) for _ in range(120)]
    got = rows(spark, *docs)
    want = [(i, *r) for i, d in enumerate(docs) for r in walk(d)]
    assert len(want) > 100 and sorted(map(str, [(r[0], r[3], r[6], r[7]) for r in got])) == sorted(map(str, want))
