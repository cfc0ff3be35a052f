"""Normalisation of values by group: min-max, z-score, robust limits. Two aggregates meet by the group's key; no window holds a section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators.catalogue import is_finite


def _finite(value: str):
    return F.when(~F.isnan(value), F.col(value))


def minmax(df: DataFrame, keys: list[str], value: str, name: str, eps: float = 0.0) -> DataFrame:
    """df with (value - min) / (max - min + eps) by group, NaN left out of both; with eps 0 a constant group is an error, and so is a value that is not finite."""
    stats = df.groupBy(*keys).agg(F.min(_finite(value)).alias("__low"), F.max(_finite(value)).alias("__high"))
    if not eps:
        facts = df.groupBy(*keys).agg(F.min(_finite(value)).alias("__low"), F.max(_finite(value)).alias("__high"), F.bool_and(is_finite(F.col(value))).alias("__ok"))
        why = F.when(~F.col("__ok"), "a value that is not finite").when(F.col("__high") == F.col("__low"), "a group of one value")
        stats = facts.withColumn("__low", F.when(why.isNotNull(), F.raise_error(F.concat(why, F.lit(" can't be normalised"))).cast("double")).otherwise(F.col("__low"))).drop("__ok")
    return df.join(stats, keys).withColumn(name, (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low") + eps)).drop("__low", "__high")


def zscore(df: DataFrame, keys: list[str], value: str, name: str, eps: float = 0.0) -> DataFrame:
    """df with (value - mean) / (population deviation + eps) by group."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__dev"))
    return df.join(stats, keys).withColumn(name, (F.col(value) - F.col("__mean")) / (F.col("__dev") + eps)).drop("__mean", "__dev")


def minmax_then_zscore(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Min-max, then z-score of the result by group."""
    return zscore(minmax(df, keys, value, "__m"), keys, "__m", name).drop("__m")


def robust_limit(df: DataFrame, keys: list[str], value: str, share: float, name: str = "limit") -> DataFrame:
    """(keys, name): the exact percentile of the finite |value| by linear interpolation; 1 where it is 0. A group without a finite value is an error."""
    size = F.when(is_finite(F.col(value)), F.abs(F.col(value).cast("double")))
    limit = F.when(F.col("__l").isNull(), F.raise_error(F.lit("a group without a finite value has no limit")).cast("double")).when(F.col("__l") == 0, 1.0).otherwise(F.col("__l"))
    return df.groupBy(*keys).agg(F.percentile(size, share).alias("__l")).select(*keys, limit.alias(name))
