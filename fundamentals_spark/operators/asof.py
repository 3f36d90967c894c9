"""The as-of join that prices, shares, market values and balances use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], max_stale: int | None = None, prefix: str = "") -> DataFrame:
    """``left`` with the values of the last right row of the same key on or before its date; null where there is none or
    it is more than ``max_stale`` days older. Also ``{prefix}{right_on}`` names the day found. One shuffle by key: both
    sides are stacked, and the last non-null right row runs along the key in order of date, right rows before left ones."""
    names = left.columns
    found = F.struct(F.col(right_on).alias("__day"), *[F.col(v) for v in values])
    kind = right.select(found.alias("r")).schema["r"].dataType
    side_l = left.select(*[F.col(b) for b in by], F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__r"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("__l"))
    side_r = right.filter(F.col(right_on).isNotNull()).select(*[F.col(b) for b in by], F.col(right_on).alias("__at"), F.lit(0).alias("__side"), found.alias("__r"), F.lit(None).cast(side_l.schema["__l"].dataType).alias("__l"))
    run = W.partitionBy(*by).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("__r", ignorenulls=True).over(run)
    out = side_l.unionByName(side_r).withColumn("__f", last).filter("__side = 1")
    if max_stale is not None:
        out = out.withColumn("__f", F.when(F.datediff("__at", F.col("__f.__day")) <= max_stale, F.col("__f")))
    return out.select(*[F.col(f"__l.`{n}`").alias(n) for n in names], F.col("__f.__day").alias(f"{prefix}{right_on}"), *[F.col(f"__f.{v}").alias(f"{prefix}{v}") for v in values])


def best_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must end in something unique."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
