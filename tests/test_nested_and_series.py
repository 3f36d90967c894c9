"""Strings at any depth, header rows, equal series and method transitions on small tables."""

from datetime import date

from pyspark.sql import functions as F

from fundamentals_spark.operators import evidence, filings, governance


def test_sanitize_reaches_every_depth(spark):
    schema = "s string, `a.b` struct<x: string, y: array<map<string, struct<z: string, n: int>>>>, n int, t array<array<string>>, nothing struct<x: string>, m map<string, int>"
    home = "/home/me/"
    df = spark.createDataFrame([(home + "f", (home, [{home: (home + "q", 1)}, None]), 3, [[home, None], None], None, {home: 1}), (None, None, None, None, (None,), None)], schema)
    out = governance.sanitize(df, {home: "", "": "never", "f": "g"})
    assert out.schema.simpleString() == df.schema.simpleString()
    a, b = out.collect()
    assert a.s == "g" and a["a.b"].x == "" and a["a.b"].y == [{home: ("q", 1)}, None] and a.t == [["", None], None] and a.nothing is None and a.m == {home: 1} and a.n == 3
    assert b.s is None and b["a.b"] is None and b.nothing is not None and b.nothing.x is None
    assert governance.sanitize(df.select("n", "m"), {home: ""}).collect() == df.select("n", "m").collect()


def test_header_rows_need_two_periods(spark):
    cells = [("d", 1, 1, "2024"), ("d", 1, 2, "2025"), ("d", 2, 1, "2023"), ("d", 2, 2, None), ("d", 3, 1, None), ("d", 3, 2, None), ("d", 4, 3, None), ("d", 500, 1, None), ("d", 501, 1, None), ("e", 1, 1, "2020"), ("e", 2, 1, None)]
    df = spark.createDataFrame([(d, "s", r, c, p, "own" if d == "e" else None) for d, r, c, p in cells], "doc string, sheet string, row int, col int, header_period string, fallback string")
    got = {(r.doc, r.row, r.col): r.period for r in evidence.attach_period(df, evidence.HEALTH_REACH, 2, "fallback").collect()}
    assert got[("d", 3, 1)] == "2024" and got[("d", 3, 2)] == "2025" and got[("d", 4, 3)] is None and got[("e", 2, 1)] == "own"
    assert got[("d", 500, 1)] == "2024" and got[("d", 501, 1)] is None and got[("d", 1, 1)] is None
    one = {(r.doc, r.row, r.col): r.period for r in evidence.attach_period(df).collect()}
    assert one[("d", 3, 1)] == "2023" and one[("e", 2, 1)] == "2020" and len(got) == len(one) == len(cells)
    assert evidence.attach_period(df.limit(0), 9, 2, "fallback").count() == 0


def test_equal_series_leave_the_first(spark):
    rows = [("A", "x", "1", 1.0, 5), ("A", "x", "2", None, 6), ("A", "y", "2", None, 1), ("A", "y", "1", 1.0, 2), ("A", "y", "1", 1.0, 3), ("A", "z", "1", 1.0, 0), ("A", None, "1", 2.0, 4), ("B", "x", "1", 1.0, 9), ("B", "x", "2", None, 9), (None, "p", "1", 1.0, 1), (None, "q", "1", 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, item string, period string, value double, ordinal int")
    out = evidence.drop_identical_series(df, ["k"], ["item"], ["ordinal"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows if r[:2] not in {("A", "x"), (None, "q")})
    assert evidence.drop_identical_series(df.limit(0), ["k"], ["item"], ["ordinal"]).count() == 0


def test_method_transitions(spark):
    d = [date(2025, m, 28) for m in (3, 6, 9)]
    rows = [(1, 2025, d[0], 1, "MI"), (1, 2025, d[0], 1, "MI"), (1, 2025, d[1], 2, "MD"), (1, 2025, d[2], 10, "MI"), (2, 2025, d[1], None, "MD"), (3, 2025, None, 1, None)]
    df = spark.createDataFrame(rows, "company int, file_year int, ref_date date, version int, method string")
    spine = spark.createDataFrame([(c,) for c in (1, 2, 3, 4)], "company int").withColumn("file_year", F.lit(2025))
    got = [tuple(r) for r in filings.method_audit(df, spine).orderBy("company").collect()]
    assert got[0] == (1, 2025, "MI -> MD", 4, "2025-03-28, 2025-06-28, 2025-09-28", "1, 2, 10", "OK_method_transition")
    assert got[1] == (2, 2025, "MD", 1, "2025-06-28", "", "OK") and got[2] == (3, 2025, "", 1, "", "1", "OK") and got[3] == (4, 2025, None, 0, None, None, "missing")
