"""Scans and sinks: filing CSV files and archives, share capital, prices, nested statement documents, Markdown tables, publishing."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.functions.text import norm_cnpj

#: Columns every statement file must have.
REQUIRED = ("CNPJ_CIA", "CD_CVM", "DENOM_CIA", "DT_REFER", "VERSAO", "ORDEM_EXERC", "CD_CONTA", "DS_CONTA", "VL_CONTA")
STATEMENT_OPTIONS = {"sep": ";", "encoding": "ISO-8859-1", "header": True}


def read_statement_csv(spark: SparkSession, path: str, doc: str, statement: str) -> DataFrame:
    """All columns as strings, with document type, statement and the year in the file's name; a missing required column raises ValueError."""
    df = spark.read.options(**STATEMENT_OPTIONS).csv(path)  # every column is a string without a schema
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    year = F.regexp_extract(F.input_file_name(), r"_(\d{4})\.csv", 1)
    return df.withColumns({"DOCUMENTO": F.lit(doc), "DEMONSTRACAO": F.lit(statement), "ANO_ARQUIVO": F.nullif(year, F.lit("")).cast("int")})


def expand_filing_archives(spark: SparkSession, glob: str, members: str, least_bytes: int = 1024, expected: tuple[str, ...] = ()) -> DataFrame:
    """(path, member, line_no, line, error) of the members of ZIP archives whose name matches the pattern; one archive at a time in a task.

    An archive under ``least_bytes``, with a failing checksum, without a matching member or without one of the ``expected``
    member names gives one row with an error and no line. ``{year}`` in an expected name is the last year 19xx or 20xx in the
    archive's file name; an archive without a year there lacks such members.
    """

    def complete(path: str, names: list[str]) -> bool:
        years = re.findall(r"(?<!\d)(?:19|20)\d{2}(?!\d)", path.rsplit("/", 1)[-1])
        return {e.replace("{year}", years[-1] if years else "") for e in expected} <= set(names)

    def rows(path: str, content: bytes):
        if len(content) < least_bytes:
            return [(path, None, None, None, "too_small")]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if z.testzip():
                    return [(path, None, None, None, "bad_checksum")]
                names = [n for n in z.namelist() if re.search(members, n)]
                if not names or not complete(path, z.namelist()):
                    return [(path, None, None, None, "members_missing")]
                return [(path, n, i, line, None) for n in names for i, line in enumerate(z.read(n).decode("iso-8859-1").splitlines())]
        except zipfile.BadZipFile:
            return [(path, None, None, None, "not_a_zip")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(rows(path, bytes(content)), columns=["path", "member", "line_no", "line", "error"])
                out["line_no"] = out["line_no"].astype("Int64")
                yield out

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, member string, line_no long, line string, error string")


def read_share_capital(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """cnpj, ref_date, version and three share counts of registered companies; dates outside the file's year go.

    Counts may have decimals after a point or comma, which go; blank and unreadable ones are 0. The columns read are plain
    ASCII, so files in Windows-1252 and in UTF-8 give the same rows.
    """
    df = spark.read.options(sep=";", header=True, encoding="UTF-8").csv(path)
    counts = {"total": "QT_ACAO_TOTAL_CAP_INTEGR", "common": "QT_ACAO_ORDIN_CAP_INTEGR", "preferred": "QT_ACAO_PREF_CAP_INTEGR"}
    out = df.select(
        norm_cnpj(F.col("CNPJ_CIA")).alias("cnpj"), F.try_to_date("DT_REFER").alias("ref_date"), F.col("VERSAO").try_cast("int").alias("version"),
        *[F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(38,6)").cast("long"), F.lit(0).cast("long")).alias(n) for n, c in counts.items()], F.regexp_extract(F.input_file_name(), r"_(\d{4})\.csv", 1).alias("y"),
    )
    inside = (F.col("y") == "") | (F.year("ref_date").cast("string") == F.col("y"))
    return out.filter(inside).drop("y").join(registry.select("cnpj").distinct(), "cnpj", "left_semi")


def read_prices(df: DataFrame) -> DataFrame:
    """symbol, date, close, adj_close (close where absent), split_factor (0 = none) from a raw price table; rows without a close go."""
    return df.filter(F.col("close").isNotNull() & ~F.isnan("close")).select("symbol", "date", "close", F.coalesce("adj_close", "close").alias("adj_close"), F.coalesce("split_factor", F.lit(0.0)).alias("split_factor"))


STATEMENT_DOCUMENT = "kind string, companies map<string, struct<scope: string, rows: array<struct<code: string, description: string, parent_code: string, values: map<string, double>>>>>"


def flatten_statements(df: DataFrame) -> DataFrame:
    """kind, ticker, scope, code, description, parent_code, period, value from nested documents; null values go."""
    c = df.select("kind", F.explode("companies").alias("ticker", "c"))
    r = c.select("kind", "ticker", F.col("c.scope").alias("scope"), F.explode("c.rows").alias("r"))
    return r.select("kind", "ticker", "scope", "r.code", "r.description", "r.parent_code", F.explode("r.values").alias("period", "value")).filter("value is not null")


def flatten_records(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Logical columns from the first present alias of each; rows without a value go."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, options in aliases.items():
        found = [F.col(f"`{have[o.lower()]}`").cast("string") for o in options if o.lower() in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*cols).filter(F.col("value").isNotNull()) if "value" in aliases else df.select(*cols)


def to_statement_documents(facts: DataFrame) -> DataFrame:
    """One nested document for each company: kind, ticker, scopes (sorted), periods (sorted), rows with a map of values."""
    rows = facts.groupBy("kind", "ticker", "scope", "code", "description", "parent_code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period", "value")))).alias("values"), F.collect_set("period").alias("p"))
    return rows.groupBy("kind", "ticker").agg(
        F.array_sort(F.collect_set("scope")).alias("scopes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("periods"),
        F.sort_array(F.collect_list(F.struct("code", "description", "parent_code", F.map_entries("values").alias("values")))).alias("rows"),
    )


def sniff_content_type(content: Column) -> Column:
    """pdf, xls, zip, html or unknown from the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "xls").when(head.startswith("504B0304"), "zip").when(text.rlike(r"^\s*(<!doctype html|<html)"), "html").otherwise("unknown")


def markdown_cells(docs: DataFrame) -> DataFrame:
    """doc, page, title, table_no, row, col, text of pipe tables: consecutive pipe lines are a table, separator rows go.

    The title is the nearest heading above and the page the nearest ``<!-- page N -->`` marker.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    w = W.partitionBy("doc").orderBy("n")
    pipe = F.col("line").rlike(r"^\|.*\|$")
    before = lines.withColumns({"pipe": pipe, "title": F.last(F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(w), "page": F.last(F.nullif(F.regexp_extract("line", r"(?i)page[: ]+(\d+)", 1), F.lit("")), ignorenulls=True).over(w).cast("int")})
    starts = (F.col("pipe") & ~F.coalesce(F.lag("pipe").over(w), F.lit(False))).cast("int")
    t = before.withColumn("s", starts).withColumn("table_no", F.sum("s").over(w).cast("int")).filter(F.col("pipe") & ~F.col("line").rlike(r"^\|[\s:|-]+\|$"))
    t = t.withColumn("row", F.row_number().over(W.partitionBy("doc", "table_no").orderBy("n")))
    cells = F.split(F.regexp_replace(F.regexp_replace("line", r"^\|", ""), r"\|$", ""), r"\|")
    return t.select("doc", "page", "title", "table_no", "row", F.posexplode(cells).alias("col", "text")).withColumn("text", F.trim("text"))


def publish(df: DataFrame, path: str) -> None:
    """Write sector and component partitions of ``df``; every other partition of the store stays as it is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sector", "component").parquet(path)
