"""Connected components of a graph given as edges, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundamentals_spark.llm.common import discard, materialize

def _with_least(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with m, the smallest v of the row's u: an aggregation that combines in the tasks, joined back by u."""
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b), comp being the smallest id of its component.

    Alternates large and small star rounds until nothing changes; each round is written to the shared folder in place of the
    one before, and the driver sees counts only. The rows of a round never exceed the edges. Null ids are left out and loops
    are kept as single nodes. The rows of one hub (two longs each) meet in one partition, which AQE splits where it is
    skewed in bytes. A graph that is not settled after ``most_rounds`` (rounds grow with the logarithm of its
    size) is an error.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropna()
    e = materialize(e.distinct())
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    links, before = materialize(e.filter("u <> v")), None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u goes to the smallest id near u
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = _with_least(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        settled = materialize(small)
        discard(links)
        links = settled
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        before = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
