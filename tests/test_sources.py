"""Round trips of scans and sinks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.sources import files

HEAD = "CNPJ_CIA;CD_CVM;DENOM_CIA;DT_REFER;VERSAO;ORDEM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA"


def test_statement_csv(spark, tmp_path):
    p = tmp_path / "itr_cia_aberta_BPA_con_2026.csv"
    p.write_bytes(f"{HEAD}\n1;014460.0;CIA É;2026-03-31;1;ÚLTIMO;1.01;Caixa;10.5\n".encode("iso-8859-1"))
    r = files.read_statement_csv(spark, str(p), "ITR", "BP").first()
    assert (r.DENOM_CIA, r.ORDEM_EXERC, r.ANO_ARQUIVO, r.VL_CONTA) == ("CIA É", "ÚLTIMO", 2026, "10.5")
    (tmp_path / "bad.csv").write_text("A;B\n1;2\n")
    with pytest.raises(ValueError, match="VL_CONTA"):
        files.read_statement_csv(spark, str(tmp_path / "bad.csv"), "ITR", "BP")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("itr_DFC_MI_con_2026.csv", HEAD + "\n" + "x" * 2000)
        z.writestr("other.txt", "y" * 10)
    (tmp_path / "b.zip").write_bytes(b"PK" + b"0" * 2000)
    (tmp_path / "c.zip").write_bytes(b"PK")
    got = files.expand_filing_archives(spark, f"{tmp_path}/*.zip", r"DFC_(MD|MI)_(con|ind)").collect()
    assert sorted((r.path[-5:], r.line_no, r.error) for r in got if r.error) == [("b.zip", None, "not_a_zip"), ("c.zip", None, "too_small")]
    assert [r.line for r in got if r.member and r.line_no == 0] == [HEAD]


def test_share_capital(spark, tmp_path):
    p = tmp_path / "capital_2026.csv"
    p.write_text("CNPJ_CIA;DT_REFER;VERSAO;QT_ACAO_TOTAL_CAP_INTEGR;QT_ACAO_ORDIN_CAP_INTEGR;QT_ACAO_PREF_CAP_INTEGR\n73.178.600/0001-18;2026-03-31;1;100;;7\n73.178.600/0001-18;2025-03-31;1;1;1;1\n11;2026-03-31;1;1;1;1\n")
    reg = spark.createDataFrame([("73178600000118",)], "cnpj string")
    assert [tuple(r)[2:] for r in files.read_share_capital(spark, str(p), reg).collect()] == [(1, 100, 0, 7)]


def test_documents_round_trip(spark):
    facts = spark.createDataFrame([("bp", "A", "con", "1", "Ativo", None, "2025", 1.0), ("bp", "A", "con", "1", "Ativo", None, "2026", 2.0), ("bp", "A", "con", "1.01", "Caixa", "1", "2026", 3.0)], "kind string, ticker string, scope string, code string, description string, parent_code string, period string, value double")
    doc = files.to_statement_documents(facts).first()
    assert doc.periods == ["2025", "2026"] and [r.code for r in doc.rows] == ["1", "1.01"]
    nested = spark.createDataFrame([("bp", {"A": ("con", [("1", "Ativo", None, {"2025": 1.0, "2026": 2.0, "2027": None}), ("1.01", "Caixa", "1", {"2026": 3.0})])})], files.STATEMENT_DOCUMENT)
    assert sorted(map(str, files.flatten_statements(nested).collect())) == sorted(map(str, facts.collect()))
    flat = files.flatten_records(spark.createDataFrame([("1.01", None, 5.0), ("2", "9", None)], "CD_CONTA string, conta string, VL_CONTA double"), {"code": ["conta", "cd_conta"], "value": ["vl_conta"]})
    assert [tuple(r) for r in flat.collect()] == [("1.01", "5.0")]


def test_markdown_and_types(spark):
    text = "# Resultados\n<!-- page 3 -->\n| Indicador | 1T26 |\n|---|---:|\n| VGV | 250.000 |\ntexto\n| a |\n"
    cells = [tuple(r) for r in files.markdown_cells(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc string, text string")).orderBy("table_no", "row", "col").collect()]
    assert cells == [("d", 3, "Resultados", 1, 1, 0, "Indicador"), ("d", 3, "Resultados", 1, 1, 1, "1T26"), ("d", 3, "Resultados", 1, 2, 0, "VGV"), ("d", 3, "Resultados", 1, 2, 1, "250.000"), ("d", 3, "Resultados", 2, 1, 0, "a")]
    kinds = spark.createDataFrame([(b"%PDF-1.7",), (b"PK\x03\x04x",), (b"\xd0\xcf\x11\xe0",), (b"\n<!DOCTYPE html>",), (b"",), (None,)], "c binary").select(files.sniff_content_type(F.col("c")))
    assert [r[0] for r in kinds.collect()] == ["pdf", "zip", "xls", "html", "unknown", "unknown"]


def test_publish_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(1, "retail", "financial"), (2, "retail", "operational"), (3, "health", "financial")]
    files.publish(spark.createDataFrame(rows, "v int, sector string, component string"), path)
    files.publish(spark.createDataFrame([(9, "retail", "financial")], "v int, sector string, component string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "sector", "component").collect()) == [(2, "retail", "operational"), (3, "health", "financial"), (9, "retail", "financial")]


def test_archives_need_every_expected_member(spark, tmp_path):
    for name, members in {"itr_2025.zip": ("con", "ind"), "itr_2026.zip": ("con",), "itr.zip": ("con", "ind")}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(f"itr_cia_aberta_DRE_{m}_{name[4:8] if name != 'itr.zip' else 2025}.csv", HEAD + "\n" + "x" * 2000)
    want = ("itr_cia_aberta_DRE_con_{year}.csv", "itr_cia_aberta_DRE_ind_{year}.csv")
    got = files.expand_filing_archives(spark, f"{tmp_path}/*.zip", "DRE", expected=want).groupBy("path", "error").count().collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.error, r["count"]) for r in got) == [("itr.zip", "members_missing", 1), ("itr_2025.zip", None, 4), ("itr_2026.zip", "members_missing", 1)]
