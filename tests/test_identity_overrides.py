"""Identities by company, near names, documents' companies, overrides with history, trailing zeros."""

from fundamentals_spark.operators import evidence, filings, governance

REGISTRY = [(1, "000001", "1"), (2, "000002", "2"), (3, "000003", "3"), (4, "000004", "4"), (5, "000005", "5"), (6, "000006", "6")]


def test_a_company_is_blocked_as_a_whole(spark):
    reg = spark.createDataFrame(REGISTRY, "company int, cvm_code string, cnpj string")
    rows = [("000001", "1"), ("000001", "1"), ("000002", "2"), ("000002", "9"), (None, "3"), (None, "3"), ("000004", "4"), (None, "4"), ("000008", "5"), (None, None)]
    kept, report = filings.resolve_companies(spark.createDataFrame([(*r, "x") for r in rows], "cvm_code string, cnpj string, match2 string"), reg)
    assert {r.company: (r.rows, r.match, r.error) for r in report.collect()} == {
        1: (2, "cd_cvm", None), 2: (2, None, "identity_conflict"), 3: (2, "cnpj_fallback", None), 4: (2, None, "mixed_identities"), 5: (1, "cnpj_fallback", None), 6: (0, None, "company_not_found"),
    }
    assert sorted(map(str, ((r.company, r.cvm_code, r.match, r.match2) for r in kept.collect()))) == sorted(map(str, [(1, "000001", "cd_cvm", "x")] * 2 + [(3, None, "cnpj_fallback", "x")] * 2 + [(5, "000008", "cnpj_fallback", "x")]))
    assert filings.resolve_companies(spark.createDataFrame([], "cvm_code string, cnpj string"), reg)[1].filter("error = 'company_not_found'").count() == 6


def test_near_names(spark):
    names = spark.createDataFrame([(1, "Construtora Aurora S.A."), (1, "Aurora Participações"), (2, "XY")], "company int, name string")
    filers = spark.createDataFrame([("AURORA PARTICIPACOES LTDA",), ("CONSTRUTORA HORIZONTE",), ("BANCO SUL",), ("AURORA PARTICIPACOES LTDA",), (None,)], "name string")
    assert [(r.company, r.name, r.shared, r["rank"]) for r in filings.near_names(names, filers).orderBy("rank").collect()] == [(1, "AURORA PARTICIPACOES LTDA", 2, 1), (1, "CONSTRUTORA HORIZONTE", 1, 2)]


def test_company_of_a_document(spark):
    companies = [
        (1, "AURO3", "12.345.678/0001-95", ["Aurora"], ["ri.aurora.example"]), (2, "HORI4", "98.765.432/0001-10", ["Horizonte", "HORI11"], ["ri.hori.example"]), (3, "SULB5", "11222333000144", ["Aurora"], None),
        (4, "LONG3", "55.666.777/0001-88", None, ["investor-relations.example"]),
    ]
    docs = [
        (1, "x/auro3_2T25.pdf", "nothing", None), (2, "a.pdf", "inscrita no cnpj 98765432/0001-10, aurora", None), (3, "a.pdf", "A AURORA cresce", None), (4, "a.pdf", "", "https://RI.hori.example/a/b"), (5, None, None, None),
        (6, "a.pdf", "horizonte e hori11", "https://other.example/"), (7, "hori4.pdf", "12345678000195", None), (8, "a.pdf", "5566677700018", None), (9, "a.pdf", "aurora", "http://investor-relations.example/x"),
    ]
    got = evidence.company_of_document(spark.createDataFrame(docs, "doc_id long, path string, text string, url string"), spark.createDataFrame(companies, "company int, ticker string, cnpj string, names array<string>, domains array<string>"))
    assert {r.doc_id: (r.company, r.method, r.evidence) for r in got.collect()} == {
        1: (1, "filename_ticker", "AURO3"), 2: (2, "content_cnpj", "CNPJ:98.765.432/0001-10"), 3: (None, None, None), 4: (2, "official_domain", "DOMAIN:ri.hori.example"), 5: (None, None, None), 6: (2, "content_alias", "Horizonte"),
        7: (1, "content_cnpj", "CNPJ:12.345.678/0001-95"), 8: (None, None, None), 9: (4, "official_domain", "DOMAIN:investor-relations.example"),
    }


BASE = "ticker string, metric string, year int, q int, value double, status string, created_at string"


def test_upserts_touch_active_rows_only(spark):
    base = [("A", "m", 1, 1, 1.0, "superseded", "a"), ("A", "m", 1, 1, 2.0, "active", "b"), ("B", "m", 1, 1, 3.0, "deleted", "c"), ("C", "m", 1, 1, 4.0, None, "d"), ("D", "m", 1, 1, 5.0, "active", "e"), (None, "m", 1, 1, 6.0, "active", "f")]
    changes = [("A", "m", 1, 1, 9.0, "upsert"), ("B", "m", 1, 1, 8.0, "upsert"), ("C", "m", 1, 1, None, "delete"), ("E", "m", 1, 1, None, "delete"), (None, "m", 1, 1, 7.0, "upsert")]
    out = governance.upsert_overrides(spark.createDataFrame(base, BASE), spark.createDataFrame(changes, "ticker string, metric string, year int, q int, value double, op string"))
    assert sorted(((r.ticker, r.value, r.status, r.created_at, r.error) for r in out.collect()), key=str) == sorted(
        [("A", 1.0, "superseded", "a", None), ("A", 9.0, "active", "b", None), ("B", 3.0, "deleted", "c", None), ("B", 8.0, "active", None, None), ("C", 4.0, "deleted", "d", None), ("D", 5.0, "active", "e", None), ("E", None, None, None, "no_active_row"), (None, 7.0, "active", "f", None)], key=str
    )


def test_history_is_not_resolved_again(spark):
    obs = spark.createDataFrame([("A", "m", 1, 1, 5.0, "high", 1), ("B", "m", 1, 1, None, "high", 2), ("C", "m", 1, 1, 6.0, "medium", 3)], "ticker string, metric string, year int, q int, value double, confidence string, ordinal int")
    man = spark.createDataFrame([(t, "m", 1, 1, 9.0, s, str(k)) for k, (t, s) in enumerate([("A", "active"), ("A", "deleted"), ("A", "superseded"), ("B", "active"), ("C", "deleted")])], BASE)
    got = {r.created_at: (r.status, r.used_value, r.warning, r.automatic_value) for r in governance.resolve_overrides(obs, man).collect()}
    assert got == {"0": ("superseded", 5.0, None, 5.0), "1": ("deleted", None, None, None), "2": ("superseded", None, None, None), "3": ("active", 9.0, "manual_value_in_use", None), "4": ("deleted", None, None, None)}
    merged = governance.merge_manual(obs, man).collect()
    assert len(merged) == 4 and [(r.ticker, r.value, r.confidence) for r in merged if r.nature == "manual"] == [("B", 9.0, "MANUAL")]


def test_trailing_zeros(spark):
    rows = [("A", 2024, 1, 5.0, "high"), ("A", 2024, 2, 0.0, "high"), ("A", 2024, 3, 7.0, "low"), ("A", 2024, 4, 0.0, None), ("Z", 2024, 1, 0.0, "high"), ("Z", 2024, 2, 3.0, "low"), ("Z", 2024, 3, None, "high")]
    got = evidence.prune_trailing_zeros(spark.createDataFrame(rows, "ticker string, year int, q int, value double, confidence string"), ["ticker"]).collect()
    assert sorted((r.ticker, r.q) for r in got) == [("A", 1), ("A", 3), ("Z", 1), ("Z", 2), ("Z", 3)]
