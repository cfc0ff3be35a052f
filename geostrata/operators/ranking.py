"""Numbers and running totals over all rows, without a task that holds them all.

Rows are dealt by ranges of their order; a task numbers its own, and the totals of the tasks before it, one row a
task, are added. Equal rows of the order fall into one task, so the order should tell rows apart.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.storage import cut_lineage


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums, the total of that whole number over all rows before it in the order; nulls come first and count nothing."""
    named = {f"__v_{name}": F.coalesce(v.cast("long"), F.lit(0)) for name, v in sums.items()}
    ranged = cut_lineage(rows.withColumns(named).repartitionByRange(*order).withColumn("__task", F.spark_partition_id()))
    shares = ranged.groupBy("__task").agg(*[F.sum(v).alias(v) for v in named]).orderBy("__task").collect()  # one row a task
    before = [list(accumulate((x[v] for x in shares), initial=0))[:-1] for v in named]
    spark = rows.sparkSession
    offsets = spark.createDataFrame([(x["__task"], *b) for x, b in zip(shares, zip(*before, strict=True), strict=True)], "__task int, " + ", ".join(f"__o_{n} long" for n in sums))
    within = Window.partitionBy("__task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)) for n in sums}).join(F.broadcast(offsets), "__task")
    out = found.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums})
    return out.drop("__task", *named, *[f"__o_{n}" for n in sums])


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order."""
    return prefix_sums(rows, order, {name: F.lit(1)})


def dense_rank(rows: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """(column, name): the distinct values of a column, nulls left out, numbered from 0 in their order."""
    return numbered(rows.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
