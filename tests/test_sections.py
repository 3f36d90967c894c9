"""Which block of a sheet a cell belongs to."""

from fundamentals_spark.operators import evidence


def test_section_scope(spark):
    cells = [("d", 1, 1, "HOSPITAIS,"), ("d", 1, 2, "Oncologia"), ("d", 2, 1, "Receita"), ("d", 2, 9, "SulAmérica"), ("d", 3, 1, None), ("d", 18, 1, "x"), ("d", 19, 1, "x"), ("e", 1, 1, "hospitais"), ("e", 2, 1, "oncologia"), ("e", 3, 1, "Seguros e"), ("e", 3, 2, "Previdência"), ("e", 4, 1, "x"), ("f", 5, 1, "x")]
    df = spark.createDataFrame([(d, "s", r, c, t) for d, r, c, t in cells], "doc string, sheet string, row int, col int, text string")
    got = {(r.doc, r.row, r.col): r.section for r in evidence.section_scope(df, "hospital").collect()}
    assert len(got) == len(cells)
    assert {k for k, v in got.items() if v == "hospital"} == {("d", 2, 1), ("d", 2, 9), ("d", 3, 1), ("d", 18, 1), ("e", 3, 1), ("e", 3, 2)}
    assert evidence.section_scope(df.limit(0), "hospital").count() == 0
