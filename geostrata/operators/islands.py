"""Gap grouping on sorted values: islands and their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, keys: list[str], value: str, max_gap: float, name: str = "island") -> DataFrame:
    """df with the number, from 0, of each row's island: a new one begins where the step to the value before exceeds max_gap."""
    order = Window.partitionBy(*keys).orderBy(value)
    begins = F.when(F.col(value) - F.lag(value).over(order) > max_gap, 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(running).cast("long")).drop("__begins")


def representatives(points: DataFrame, keys: list[str], along: str, across: str, max_gap: float) -> DataFrame:
    """One point per island of `along` within each value of `across`: the element at half the island's size. Distinct."""
    grouped = gap_islands(points.select(*keys, along, across).distinct(), [*keys, across], along, max_gap)
    each = Window.partitionBy(*keys, across, "island")
    nth = F.row_number().over(each.orderBy(along)) - 1
    middle = F.floor(F.count("*").over(each) / 2)
    return grouped.withColumn("__n", nth).withColumn("__m", middle).where("__n = __m").select(*keys, along, across).distinct()


def group_points(points: DataFrame, max_gap: float = 10, key: str = "inline_number") -> DataFrame:
    """(key, x, z): representatives of islands along x for each z, then of islands of those along z for each x."""
    rows = representatives(points, [key], "x", "z", max_gap)
    return representatives(rows, [key], "z", "x", max_gap).select(key, "x", "z")
