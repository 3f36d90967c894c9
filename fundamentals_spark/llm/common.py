"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting below the warehouse, which a cluster shares too."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key that holds a thousandth of the rows is hot; there are at most so many of them.
HOT_SHARE = 1000


def look_up(left: DataFrame, table: DataFrame, keys: list[str], values: list[str], held: str, total: int, spread: Column) -> DataFrame:
    """``left`` with ``values`` of the row of ``table`` that has the same (not null) ``keys``, null where there is none.

    ``table`` has a row for each key and in ``held`` the number of its rows in ``left``, ``total`` in all. The rows of hot
    keys, at most ``HOT_SHARE``, are broadcast by a digest of the key; the rest is joined by key, and rows of ``left`` that
    are already served are dealt out by ``spread``.
    """
    k, hit = fresh(left, "look_up_key"), fresh(left, "look_up_hit")
    digest = F.sha2(F.concat_ws("\x01", *keys), 256)
    lines = table.select(digest.alias(k), F.struct(*values).alias(hit), F.expr(f"{held} * {HOT_SHARE} >= {total}").alias("_hot"))
    hot, cold = lines.filter("_hot").drop("_hot"), lines.filter("not _hot").drop("_hot")
    out = left.withColumn(k, digest).join(F.broadcast(hot), k, "left")
    own, late = fresh(out, "look_up_own"), fresh(out, "look_up_late")
    out = out.withColumn(own, F.when(F.col(hit).isNull(), F.col(k)).otherwise(F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))))
    out = out.join(cold.select(F.col(k).alias(own), F.col(hit).alias(late)), own, "left")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.coalesce(F.col(f"{hit}.{v}"), F.col(f"{late}.{v}")).alias(v) for v in values])


def text_bytes(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, to size partitions with; one scan, two numbers to the driver."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])
