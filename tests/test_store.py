"""Publishing by component and recomputation of derived tables: what is written, what is left alone, and recovery."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fundamentals_spark.sources import store

SCHEMA = "v int, m map<string,int>, sector string, component string"
FIRST = [(1, {"a": 1}, "retail", "financial"), (2, None, "retail", "financial"), (3, None, "retail", "operational"), (4, {}, "1", "financial"), (5, None, "retail", "manual_overrides")]


def files_below(path):
    return {(str(p), p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet") if "_publications" not in str(p) and "_recomputed" not in str(p)}


def held(spark, path):
    return sorted((r.v, r.sector, r.component) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def statuses(df):
    return {(r.sector, r.component): r.status for r in df.collect()}


def test_publish_statuses(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    registered = spark.createDataFrame([("retail", "financial"), ("retail", "operational"), ("1", "financial")], "sector string, component string")
    first = store.publish_components(make(FIRST), path, registered=registered)
    assert set(statuses(first).values()) == {"success"} and len(statuses(first)) == 4 and held(spark, path) == sorted((v, s, c) for v, _, s, c in FIRST)
    before, stamp = files_below(path), {(r.sector, r.component): r.last_update for r in first.collect()}

    again = store.publish_components(make(FIRST[::-1]), path, registered=registered)  # other order, same rows
    assert set(statuses(again).values()) == {"skipped_no_change"} and files_below(path) == before
    assert {(r.sector, r.component): r.last_update for r in again.collect()} == stamp

    new = [(1, {"a": 1}, "retail", "financial"), (2, {}, "retail", "financial"), (9, None, "retail", "operational"), (7, None, "1", "operational")]
    scoped = store.publish_components(make(new), path, "operational", registered)
    assert statuses(scoped) == {("retail", "financial"): "skipped_by_scope", ("retail", "operational"): "success", ("1", "financial"): "skipped_by_scope", ("1", "operational"): "not_registered"}
    assert held(spark, path) == sorted([(1, "retail", "financial"), (2, "retail", "financial"), (9, "retail", "operational"), (4, "1", "financial"), (5, "retail", "manual_overrides")])
    assert statuses(store.publish_components(make([]), path, "operational", registered))[("1", "operational")] == "not_applicable"

    whole = statuses(store.publish_components(make(new), path))  # null and {} differ, so the financial rows changed
    assert whole[("retail", "financial")] == "success" and whole[("retail", "operational")] == "skipped_no_change" and whole[("retail", "manual_overrides")] == "skipped_no_change" and whole[("1", "operational")] == "success"
    override = statuses(store.publish_components(make([(6, None, "retail", "manual_overrides")]), path, "financial"))
    assert override[("retail", "manual_overrides")] == "success" and (6, "retail", "manual_overrides") in held(spark, path)


def test_publish_after_a_run_that_died(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame(FIRST, SCHEMA)
    store.publish_components(df, path)
    log = f"{path}/_publications"
    half = spark.read.schema(store._LOG).parquet(log).filter("component = 'operational'").withColumns({"run": F.lit(2).cast("long"), "digest": F.lit(None).cast("string")})
    store.append_log(spark.createDataFrame(half.collect(), half.schema).drop("phase"), log, "started")
    store.replace_partitions(spark.createDataFrame([(99, None, "retail", "operational")], SCHEMA), path, ["sector", "component"])
    got = store.publish_components(df, path)
    assert {k for k, v in statuses(got).items() if v == "success"} == {("retail", "operational")}
    assert held(spark, path) == sorted((v, s, c) for v, _, s, c in FIRST)


def test_publish_nulls_and_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, None, None, "financial"), (2, None, "", "financial"), (None, None, "x", "financial")], SCHEMA)
    assert store.publish_components(df.limit(0), path).count() == 0 and not files_below(path)
    assert statuses(store.publish_components(df, path)) == {(None, "financial"): "success", ("x", "financial"): "success"}
    assert statuses(store.publish_components(df, path)) == {(None, "financial"): "skipped_no_change", ("x", "financial"): "skipped_no_change"}


def test_digests_tell_nulls_places_and_repeats_apart(spark):
    rows = [("a", None, 1), ("b", 1, None), ("c", 1, 1), ("d", 1, 1), ("d", 1, 1)]
    d = {r.k: r.digest for r in store.digests(spark.createDataFrame(rows, "k string, x int, y int"), ["k"]).collect()}
    assert len(set(d.values())) == 4
    swapped = {r.k: r.digest for r in store.digests(spark.createDataFrame(rows, "k string, x int, y int").select("y", "k", "x"), ["k"]).collect()}
    assert swapped == d
