"""Partitioned Parquet stores: digests of partitions, staged replacement of those that changed, and a log of each run.

A run stages its rows in the shared folder of the cluster before the store is touched, logs what it is about to replace
(``started``), replaces those partitions in one dynamic overwrite, and logs the outcome (``done``). A run that dies in between
leaves ``started`` as the last word on a partition, so the next run writes it again whatever its digest. One run at a time
may write a store.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components that no scope selects: they are replaced only by rows delivered for them.
PROTECTED = ("manual_overrides",)

_LOG = "run bigint, phase string, sector string, component string, status string, updated boolean, n_rows bigint, digest string, last_update timestamp"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` (else the warehouse) and read back, with the folder."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders; those that do not exist are ignored."""
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is none; partition values keep the types of ``schema`` if it is given."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def digests(df: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_rows and digest of the rows of each key, the same in any order of rows and columns.

    The digest is the count with two sums of 64-bit hashes of each row as JSON, so repeated rows count, and a null differs from an
    absent or empty value. One partial aggregation; a group is never gathered.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in by]), {"ignoreNullFields": "false"}) if set(df.columns) - set(by) else F.lit("")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(28,0)")).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), total(1).alias("__a"), total(2).alias("__b")).select(*by, "n_rows", F.concat_ws(":", "n_rows", "__a", "__b").alias("digest"))


def last_of(log: DataFrame, by: list[str]) -> DataFrame:
    """``by`` with the digest in force (null where the last run did not end) and the time of the last update."""
    order = F.struct("run", F.col("phase") == "done")
    return log.groupBy(*by).agg(F.max_by("digest", order).alias("old_digest"), F.max("last_update").alias("old_update"))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``rows`` has; all others stay. Rows meet by partition, which Spark splits where one is large."""
    rows.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(rows: DataFrame, path: str, phase: str) -> None:
    """Add the rows to the log of a store in one small file."""
    rows.withColumn("phase", F.lit(phase)).coalesce(1).write.mode("append").parquet(path)


def next_run(log: DataFrame | None) -> int:
    """One more than the last run in the log."""
    return 1 if log is None else int(log.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]) + 1


def same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equal keys, null equal to null."""
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[c])
    return out


def publish_components(df: DataFrame, path: str, scope: str = "all", registered: DataFrame | None = None, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Publish sector and component partitions of ``df`` into the store at ``path``; returns the status of every component.

    ``registered`` (sector, component) lists what each sector has; by default what ``df`` and earlier runs name. ``scope`` is all or
    one component. The status is

    * ``success``: rows were delivered, are in scope and differ from what stands; the partition is replaced,
    * ``skipped_no_change``: none were delivered, or the same rows (in any order) stand already,
    * ``skipped_by_scope``: another component was asked for,
    * ``not_applicable``: the sector does not have the component asked for,
    * ``not_registered``: rows of a component that ``registered`` does not list; they are not written.

    Protected components are outside of every scope: they stay unless rows of them are delivered. A skipped component keeps its
    last_update. Null and empty sectors are one sector, null. Empty ``df``: nothing is written.
    """
    spark, by = df.sparkSession, ["sector", "component"]
    log_path = f"{path.rstrip('/')}/_publications"
    log = read_table(spark, log_path, _LOG)
    run = next_run(log)
    rows, folder = stage(df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in by}))
    folders = [folder]
    try:
        new = digests(rows, by)
        old = last_of(log, by) if log is not None else spark.createDataFrame([], "sector string, component string, old_digest string, old_update timestamp")
        known = registered.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]).distinct() if registered is not None else new.select(*by).union(old.select(*by)).distinct()
        asked = known.select("sector").distinct().withColumn("component", F.lit(scope)) if scope != "all" else known.limit(0)
        kinds = [(known, "known"), (asked, "asked"), (new, "delivered")]
        marks = [d.select(*by, *[F.lit(k == kind).alias(k) for _, k in kinds]) for d, kind in kinds]
        pairs = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy(*by).agg(*[F.max(k).alias(k) for _, k in kinds])
        j = pairs.join(new, same(pairs, new, by), "left").select(pairs["*"], "n_rows", "digest")
        j = j.join(old, same(j, old, by), "left").select(j["*"], "old_digest", "old_update")
        guarded = F.coalesce(F.col("component").isin(*protected), F.lit(False))
        inside = F.lit(scope == "all") | F.coalesce(F.col("component") == scope, F.lit(False)) | guarded
        status = (
            F.when(~F.col("known") & ~guarded, F.when(F.col("delivered"), "not_registered").otherwise("not_applicable")).when(~inside, "skipped_by_scope")
            .when(~F.col("delivered") | F.col("digest").eqNullSafe(F.col("old_digest")), "skipped_no_change").otherwise("success")
        )
        j = j.withColumn("status", status).withColumn("updated", F.col("status") == "success")
        decided, folder = stage(j.select(F.lit(run).cast("long").alias("run"), *by, "status", "updated", F.when(F.col("updated"), F.col("n_rows")).alias("n_rows"), F.when(F.col("updated"), F.col("digest")).otherwise(F.col("old_digest")).alias("digest"), F.when(F.col("updated"), F.current_timestamp()).otherwise(F.col("old_update")).alias("last_update")))
        folders.append(folder)
        changed = decided.filter("updated")
        if not changed.isEmpty():
            append_log(changed.withColumns({"status": F.lit("started"), "digest": F.lit(None).cast("string"), "last_update": F.lit(None).cast("timestamp")}), log_path, "started")
            replace_partitions(rows.join(changed, same(rows, changed, by), "left_semi"), path, by)
        append_log(decided, log_path, "done")
    finally:
        delete(spark, *folders)
    return spark.read.schema(_LOG).parquet(log_path).filter((F.col("run") == run) & (F.col("phase") == "done")).drop("phase")
