"""Derived tables rebuilt from persisted facts alone."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundamentals_spark.operators import accounts, evidence, indicators
from fundamentals_spark.sources import store as S


def _retail(obs: DataFrame) -> DataFrame:
    """Derived retail rows of the reported ones; what was derived before does not count."""
    return evidence.derive_retail(obs.filter("coalesce(origin, 'reported') = 'reported'"))


#: Derived table: scope, inputs (facts or other derived tables), and how it is made of them.
DERIVED = {
    "net_debt": ("financial", ("balances",), indicators.net_debt),
    "working_capital": ("financial", ("balances",), indicators.working_capital),
    "ebitda_ltm": ("financial", ("quarter_facts",), lambda f: indicators.ltm(indicators.margins(f), "ebitda", ["company"])),
    "enterprise_value": ("market", ("market_caps", "net_debt"), indicators.enterprise_value),
    "balance_check": ("financial", ("balances",), accounts.balance_check),
}

#: The same for operational tables, which only ``refresh`` rebuilds.
OPERATIONAL = {"retail_derived": ("retail", ("retail_observations",), _retail)}

#: Part of every fingerprint: raise it when a rule of a derived table changes, and all of them are rebuilt.
VERSION = 1

_LOG = "run bigint, phase string, derived string, sector string, digest string, n_rows bigint"
_STATUS = "derived string, sector string, status string, missing_input string, n_rows bigint"


def _order(derived: dict) -> list[str]:
    """Derived tables, each after those it is made of."""
    return [n for n in TopologicalSorter({n: d[1] for n, d in derived.items()}).static_order() if n in derived]


def recompute(spark: SparkSession, store: str, scope: str = "all") -> tuple[dict[str, DataFrame], DataFrame]:
    """(derived tables of the scope whose inputs exist as Parquet below ``store``, a table of (derived, missing input)). Nothing is fetched or written.

    A derived table that others need is made from its own inputs, even if the scope leaves it out of the result.
    """
    made: dict[str, DataFrame | None] = {}
    missing = []
    for name in _order(DERIVED):
        part, inputs, make = DERIVED[name]
        for i in inputs:
            if i not in made:
                made[i] = S.read_table(spark, f"{store}/{i}")
        lacking = [i for i in inputs if made[i] is None]
        made[name] = None if lacking else make(*[made[i] for i in inputs])
        missing += [(name, i) for i in lacking if scope in ("all", part)]
    out = {n: made[n] for n, d in DERIVED.items() if scope in ("all", d[0]) and made[n] is not None}
    return out, spark.createDataFrame(missing, "derived string, missing_input string")


def _by_sector(df: DataFrame, entity: str) -> DataFrame:
    """The company (or ticker) of a stored table becomes (sector, company), so that sectors never meet."""
    return df.withColumn(entity, F.struct(F.col("sector"), F.col(entity).alias("name"))).drop("sector")


def refresh(spark: SparkSession, store: str, scope: str = "all", derived: dict | None = None, version: int = VERSION) -> DataFrame:
    """Bring the derived tables below ``store`` up to date and return what was done: derived, sector, status, missing_input, n_rows.

    Facts and derived tables are Parquet partitioned by ``sector``. A sector of a derived table is rebuilt if the digest of its
    inputs there (their contents, in any order) or ``version`` is not the one it was last made of; a derived table that comes out
    as before leaves those made of it alone. Only rebuilt sectors are read by the rules and replaced on disk; a sector that no
    longer gives rows is removed. Status: success, unchanged, missing_inputs (one row for each input that does not exist; nothing is
    fetched, what stands stays) or skipped_by_scope. Finding out reads every input of the scope once. Runs that die are repeated.
    """
    rules = DERIVED | OPERATIONAL if derived is None else derived
    log_path = f"{store.rstrip('/')}/_recomputed"
    log = S.read_table(spark, log_path, _LOG)
    run = S.next_run(log)
    parts: dict[str, DataFrame | None] = {}
    folders: list[str] = []
    report = spark.createDataFrame([], _STATUS)

    def line(status: str, **values) -> DataFrame:
        return spark.createDataFrame([(values["derived"], None, status, values.get("missing"), None)], _STATUS)

    def contents(name: str) -> DataFrame | None:
        """Digest of each sector of a stored table, taken once."""
        if name not in parts:
            table = S.read_table(spark, f"{store}/{name}")
            if table is not None and "sector" not in table.columns:
                raise ValueError(f"{name} is not partitioned by sector")
            parts[name] = None
            if table is not None:
                parts[name], folder = S.stage(S.digests(table.withColumn("sector", F.col("sector").cast("string")), ["sector"]).coalesce(1))
                folders.append(folder)
        return parts[name]

    try:
        for name in _order(rules):
            part, inputs, make = rules[name]
            if scope not in ("all", part):
                report = report.union(line("skipped_by_scope", derived=name))
                continue
            lacking = [i for i in inputs if contents(i) is None]
            for i in lacking:
                report = report.union(line("missing_inputs", derived=name, missing=i))
            if lacking:
                continue
            known = contents(inputs[0]).select("sector", F.lit(inputs[0]).alias("i"), "digest")
            for i in inputs[1:]:
                known = known.union(contents(i).select("sector", F.lit(i), "digest"))
            marks = known.groupBy("sector").agg(F.sha2(F.concat_ws(",", F.lit(str(version)), F.array_sort(F.collect_list(F.concat_ws("=", "i", "digest")))), 256).alias("digest"))
            old = log.filter(F.col("derived") == name) if log is not None else spark.createDataFrame([], _LOG)
            old = old.groupBy("sector").agg(F.max_by("digest", F.struct("run", F.col("phase") == "done")).alias("was"))
            both = marks.withColumn("now", F.lit(True)).unionByName(old.withColumnRenamed("was", "digest").withColumn("now", F.lit(False)))
            sides = both.groupBy("sector").agg(F.max(F.when(F.col("now"), F.col("digest"))).alias("digest"), F.max(F.when(~F.col("now"), F.col("digest"))).alias("was"), F.max(~F.col("now")).alias("seen"))
            stands = S.read_table(spark, f"{store}/{name}") is not None
            sides, folder = S.stage(sides.withColumn("changed", ~F.col("digest").eqNullSafe(F.col("was")) | (F.col("digest").isNull() & F.lit(stands) & F.col("was").isNotNull())).coalesce(1))
            folders.append(folder)
            changed = sides.filter("changed").select("sector", "digest")
            written = None
            if not changed.isEmpty():
                S.append_log(changed.select(F.lit(run).cast("long").alias("run"), F.lit(name).alias("derived"), "sector", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n_rows")), log_path, "started")
                written = _rebuild(spark, store, name, inputs, make, changed, folders)
                parts.pop(name, None)
                S.append_log(changed.join(written, S.same(changed, written, ["sector"]), "left").select(F.lit(run).cast("long").alias("run"), F.lit(name).alias("derived"), changed["sector"], "digest", F.coalesce("n_rows", F.lit(0)).alias("n_rows")), log_path, "done")
            counts = written if written is not None else spark.createDataFrame([], "sector string, n_rows bigint")
            lines = sides.filter("changed or digest is not null").join(counts, S.same(sides, counts, ["sector"]), "left")
            lines = lines.select(F.lit(name).alias("derived"), sides["sector"], F.when(F.col("changed"), "success").otherwise("unchanged").alias("status"), F.lit(None).cast("string").alias("missing_input"), F.when(F.col("changed"), F.coalesce("n_rows", F.lit(0))).alias("n_rows"))
            report = report.union(lines)
        rows = report.collect()  # one row a derived table and sector
    finally:
        S.delete(spark, *folders)
    return spark.createDataFrame(rows, _STATUS)


def _rebuild(spark: SparkSession, store: str, name: str, inputs: tuple[str, ...], make, changed: DataFrame, folders: list[str]) -> DataFrame:
    """Replace the changed sectors of a derived table; returns sector and n_rows of what was written."""
    tables = []
    for i in inputs:
        t = S.read_table(spark, f"{store}/{i}")
        t = t.withColumn("sector", F.col("sector").cast("string"))
        entity = "company" if "company" in t.columns else "ticker"
        tables.append(_by_sector(t.join(changed, S.same(t, changed, ["sector"]), "left_semi"), entity))
    out = make(*tables)
    entity = "company" if "company" in out.columns else "ticker"
    out, folder = S.stage(out.withColumns({"sector": F.col(f"{entity}.sector"), entity: F.col(f"{entity}.name")}))
    folders.append(folder)
    written, folder = S.stage(out.groupBy("sector").agg(F.count(F.lit(1)).alias("n_rows")).coalesce(1))
    folders.append(folder)
    if not written.isEmpty():
        S.replace_partitions(out, f"{store}/{name}", ["sector"])
    gone = changed.join(written, S.same(changed, written, ["sector"]), "left_anti")
    folder_of = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    S.delete(spark, *[f"{store}/{name}/{folder_of('sector', r.sector)}" for r in gone.select("sector").collect()])  # sectors only
    return written
