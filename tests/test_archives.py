"""The archive source against the plain CSV scan, with filters, damage and memory."""

import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from fundamentals_spark.sources import archives, files

HEAD = "CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;GRUPO_DFP;MOEDA;ESCALA_MOEDA;ORDEM_EXERC;DT_FIM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA;ST_CONTA_FIXA;EXTRA"


def lines(year, n=40):
    return [f"{i % 3}.0;{year}-03-31;{1 + i % 2};CIA É {i % 3};{i % 3};DF;REAL;MIL;ÚLTIMO;{year}-03-31;1.{i:02d};" + (f'"Caixa; {i}"' if i % 5 else "") + f";{i * 1.5};S;x" for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    for year in (2025, 2026):
        with zipfile.ZipFile(tmp_path / f"itr_{year}.zip", "w", zipfile.ZIP_DEFLATED if year == 2025 else zipfile.ZIP_STORED) as z:
            for scope in ("con", "ind"):
                z.writestr(f"itr_cia_aberta_BPA_{scope}_{year}.csv", "\n".join([HEAD, *lines(year), ""]).encode("iso-8859-1"))
            z.writestr("readme.txt", "z" * 3000)
    return tmp_path


def test_rows_equal_the_csv_scan(spark, folder, tmp_path_factory):
    got = archives.read_filing_archives(spark, f"{folder}/itr_*.zip")
    assert got.rdd.getNumPartitions() == 4
    plain = tmp_path_factory.mktemp("plain")
    for year in (2025, 2026):
        with zipfile.ZipFile(folder / f"itr_{year}.zip") as z:
            z.extractall(plain, [n for n in z.namelist() if n.endswith("csv")])
    want = files.read_statement_csv(spark, f"{plain}/*.csv", "ITR", "BPA")
    columns = [c for c in archives.COLUMNS if c in want.columns]
    pick = lambda df, year: sorted(map(str, df.select(*columns, F.col(year).alias("y")).collect()))
    assert pick(got, "year") == pick(want, "ANO_ARQUIVO") and got.count() == 160
    assert {r[0] for r in got.select("scope").distinct().collect()} == {"con", "ind"}
    assert got.filter("error is not null or DT_INI_EXERC is not null").count() == 0


def test_filters_are_applied_in_the_reader(spark, folder):
    df = archives.read_filing_archives(spark, f"{folder}/*.zip")
    some = df.filter("scope = 'con' and year = 2026 and CD_CVM in ('1', '2') and VERSAO > 1")
    assert some.rdd.getNumPartitions() == 1
    want = [s.split(";") for s in lines(2026) if s.split(";")[4] in "12" and s.split(";")[2] == "2"]
    assert sorted(r.CD_CONTA for r in some.collect()) == sorted(w[10] for w in want)
    assert df.filter("year = 1999").count() == 0 and df.filter("CD_CVM = '9'").count() == 0
    reader = archives.FilingReader({"path": f"{folder}/*.zip"})
    left = list(reader.pushFilters([EqualTo(("scope",), "con"), In(("CD_CVM",), ["1"]), EqualTo(("error",), "x"), GreaterThan(("VERSAO",), "1"), EqualTo(("CD_CVM",), "2")]))
    assert left == [EqualTo(("error",), "x"), GreaterThan(("VERSAO",), "1")] and reader.wanted == {"scope": {"con"}, "CD_CVM": set()}
    assert all(p.member.endswith(("con_2025.csv", "con_2026.csv")) for p in reader.partitions())


def test_damage_has_one_row_with_an_error(spark, folder):
    (folder / "a.zip").write_bytes(b"PK")
    (folder / "b.zip").write_bytes(b"PK" + b"0" * 2000)
    with zipfile.ZipFile(folder / "c_2024.zip", "w") as z:
        z.writestr("x_con_2024.csv", "A;B\n1;2\n" + "y" * 2000)
        z.writestr("y_ind_2024.csv", "")
    data = bytearray((folder / "itr_2026.zip").read_bytes())
    data[data.index(b"CIA")] ^= 1  # inside the first member's stored bytes
    (folder / "d_2026.zip").write_bytes(bytes(data))
    df = archives.read_filing_archives(spark, f"{folder}/*.zip")
    bad = sorted((r.path.rsplit("/", 1)[-1], (r.member or "")[-12:], r.error.split(":")[0]) for r in df.filter("error is not null").collect())
    assert bad == [("a.zip", "", "too_small"), ("b.zip", "", "not_a_zip"), ("c_2024.zip", "con_2024.csv", "columns_missing"), ("c_2024.zip", "ind_2024.csv", "columns_missing"), ("d_2026.zip", "con_2026.csv", "bad_checksum")]
    assert df.filter("path like '%d_2026.zip' and error is null").count() == 40
    need = archives.read_filing_archives(spark, f"{folder}/itr_*.zip", expected=("itr_cia_aberta_BPA_con_{year}.csv", "other_{year}.csv"))
    assert [r.error for r in need.collect()] == ["members_missing"] * 2
    assert archives.read_filing_archives(spark, f"{folder}/none*.zip").count() == 0


def test_memory_does_not_grow_with_a_member(tmp_path):
    row = (lines(2026, 2)[1] + "\n").encode("iso-8859-1")
    peaks = []
    for blocks in (4, 16):
        name = f"big{blocks}_2026.zip"
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z, z.open("x_con_2026.csv", "w") as out:
            out.write((HEAD + "\n").encode())
            for _ in range(blocks):
                out.write(row * 10_000)
        reader = archives.FilingReader({"path": f"{tmp_path}/{name}"})
        (part,) = reader.partitions()
        tracemalloc.start()
        n = sum(b.num_rows for b in reader.read(part))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == blocks * 10_000
    assert peaks[1] < 1.2 * peaks[0]
