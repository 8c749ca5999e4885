"""Comparison tables over the metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.plans.metrics import HIGHER_IS_BETTER, METRICS


def unpivot(metrics: DataFrame) -> DataFrame:
    """(k, variant, metric, value); an undefined metric (NaN) is null, so that it never ranks first."""
    long = metrics.unpivot(["k", "variant"], METRICS, "metric", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _signed() -> Column:
    higher = [m for m, up in HIGHER_IS_BETTER.items() if up]
    return F.when(F.col("metric").isin(higher), F.col("value")).otherwise(-F.col("value"))


def scaled(metrics: DataFrame) -> DataFrame:
    """(k, variant, metric, scaled): min-max over the variants of a k, 1 is best; a constant metric gives 0."""
    window = Window.partitionBy("k", "metric")
    low, high = F.min("_s").over(window), F.max("_s").over(window)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    long = unpivot(metrics).withColumn("_s", _signed())
    return long.select("k", "variant", "metric", ((F.col("_s") - low) / span).alias("scaled"))


def ranked(metrics: DataFrame) -> DataFrame:
    """(k, variant, metric, value, rank): rank 1 is best, equal values share a rank."""
    window = Window.partitionBy("k", "metric").orderBy(F.col("_s").desc_nulls_last())
    long = unpivot(metrics).withColumn("_s", _signed())
    return long.withColumn("rank", F.rank().over(window)).drop("_s")


def rank_table(metrics: DataFrame) -> DataFrame:
    """(k, variant, one rank column per metric)"""
    return ranked(metrics).groupBy("k", "variant").pivot("metric", METRICS).agg(F.first("rank"))


def wins(metrics: DataFrame) -> DataFrame:
    """(metric, variant, wins): number of k at which a variant is best."""
    return ranked(metrics).filter("rank = 1").groupBy("metric", "variant").agg(F.count("*").alias("wins"))


def append(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
