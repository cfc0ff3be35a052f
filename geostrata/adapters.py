"""Domain views over the driver's tables: fault points, pixels, picks, axes (FIXTURES.md, section 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC, the first day of events
PIXEL_EPOCH = 694224000  # 1992-01-01 UTC, the first ship date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fault_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sec, cluster, x, z): distinct points of one section a day and one cluster an event type."""
    seconds = F.unix_timestamp("ts")
    second = F.pmod(seconds, F.lit(86400))
    return (
        table(spark, sf_dir, "events")
        .select(
            F.floor((seconds - EPOCH) / 86400).cast("int").alias("sec"),
            F.col("event_type").alias("cluster"),
            (F.floor(second / 864) * 0.25).alias("x"),
            (F.least("value", F.lit(100.0)) * 0.1).alias("z"),
        )
        .distinct()
    )


FAULT_POINTS_SQL = """
fault_points AS (
  SELECT DISTINCT CAST(floor((floor(epoch(ts)) - 1704067200) / 86400) AS INTEGER) AS sec, event_type AS cluster,
         floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 864.0) * 0.25 AS x, least(value, 100.0) * 0.1 AS z
  FROM events)"""


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inline_number, x, z): distinct integer points, one inline a day: x the 100th of the day, z the value's whole part up to 100."""
    seconds = F.unix_timestamp("ts")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.floor((seconds - EPOCH) / 86400).cast("int").alias("inline_number"),
            F.floor(F.pmod(seconds, F.lit(86400)) / 864).cast("int").alias("x"),
            F.floor(F.least("value", F.lit(100.0))).cast("int").alias("z"),
        )
        .distinct()
    )


GRID_POINTS_SQL = """
grid_points AS (
  SELECT DISTINCT CAST(floor((floor(epoch(ts)) - 1704067200) / 86400) AS INTEGER) AS inline_number,
         CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 864.0) AS INTEGER) AS x, CAST(floor(least(value, 100.0)) AS INTEGER) AS z
  FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inline_number, x, z, p): line items by 30 days, quantity and line number, p their count over the inline's largest. Absent cells mean p = 0."""
    counts = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_linenumber").cast("int").alias("inline_number"),
            F.floor((F.unix_timestamp("l_shipdate") - PIXEL_EPOCH) / 86400 / 30).cast("int").alias("x"),
            F.floor("l_quantity").cast("int").alias("z"),
        )
        .groupBy("inline_number", "x", "z")
        .agg(F.count("*").alias("n"))
    )
    most = counts.groupBy("inline_number").agg(F.max("n").alias("most"))
    return counts.join(most, "inline_number").select("inline_number", "x", "z", (F.col("n") / F.col("most")).alias("p"))


PIXELS_SQL = """
pixel_counts AS (
  SELECT CAST(l_linenumber AS INTEGER) AS inline_number,
         CAST(floor((floor(epoch(l_shipdate)) - 694224000) / 86400 / 30) AS INTEGER) AS x,
         CAST(floor(l_quantity) AS INTEGER) AS z, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
pixels AS (SELECT inline_number, x, z, n / max(n) OVER (PARTITION BY inline_number) AS p FROM pixel_counts)"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inline_id, fault_id, x_idx, z_idx): orders as interpretation picks: inline by nation, fault by customer mod 7, x by 10 days, z by 2,500 of price."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("c_nationkey").alias("inline_id"),
        (F.col("o_custkey") % 7).cast("int").alias("fault_id"),
        F.floor((F.unix_timestamp("o_orderdate") - PIXEL_EPOCH) / 86400 / 10).cast("int").alias("x_idx"),
        F.floor(F.col("o_totalprice") / 2500).cast("int").alias("z_idx"),
    )


PICKS_SQL = """
picks AS (
  SELECT c_nationkey AS inline_id, CAST(o_custkey % 7 AS INTEGER) AS fault_id,
         CAST(floor((floor(epoch(o_orderdate)) - 694224000) / 86400 / 10) AS INTEGER) AS x_idx,
         CAST(floor(o_totalprice / 2500) AS INTEGER) AS z_idx
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
