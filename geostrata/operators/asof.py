"""As-of lookups: the entries of an axis before and after each row's value, without a join on ranges.

Rows and entries are dealt together by ranges of (keys, value), so that a long axis or a key with most rows is
shared by many tasks. Within a task the neighbours are the last entry so far and the next to come; at its edges they
come from the tasks before and after it, told by one row a task and key. Steps of any width cost the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.storage import cut_lineage


def neighbours(rows: DataFrame, axis: DataFrame, keys: list[str], value: str, axis_value: str, entry: list[str]) -> DataFrame:
    """rows with `before` and `after`: structs (at, *entry) of the axis entries of the same keys with the largest value up to the row's, and the smallest beyond it; null where there is none.

    Values compare as doubles, null and NaN values have no neighbours. Of entries with one value the largest by
    `entry` is before, the smallest after. Null keys equal each other.
    """
    at = F.col(value).cast("double")
    carried = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    entries = axis.where(F.col(axis_value).isNotNull() & ~F.isnan(F.col(axis_value).cast("double")))
    told = F.struct(F.col(axis_value).cast("double").alias("at"), *entry)
    kind = axis.select(told.alias("e")).schema["e"].dataType
    both = rows.select(*keys, at.alias("__v"), F.lit(1).alias("__tag"), carried.alias("__row"), F.lit(None).cast(kind).alias("__e")).unionByName(
        entries.select(*keys, F.col(axis_value).cast("double").alias("__v"), F.lit(0).alias("__tag"), told.alias("__e")), allowMissingColumns=True
    )
    dealt = cut_lineage(both.repartitionByRange(*keys, "__v").withColumn("__task", F.spark_partition_id()))
    group = ["__task", *keys]
    order = Window.partitionBy(*group).orderBy("__v", "__tag", "__e")
    back = Window.partitionBy(*group).orderBy(F.desc("__v"), F.desc("__tag"), F.desc("__e"))  # a frame that grows; one that ends at the last row is gone through anew for each row
    near = dealt.withColumns({
        "before": F.last("__e", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.last("__e", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    ends = dealt.groupBy(*group).agg(F.min("__e").alias("__first"), F.max("__e").alias("__last"))  # one row a task and key
    tasks = Window.partitionBy(*keys)
    ends = ends.withColumns({
        "__b": F.last("__last", ignorenulls=True).over(tasks.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)),
        "__a": F.last("__first", ignorenulls=True).over(tasks.orderBy(F.desc("__task")).rowsBetween(Window.unboundedPreceding, -1)),
    })
    met = near.where("__tag = 1").alias("n").join(ends.alias("e"), [F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}")) for c in group], "left")
    good = F.col("n.__v").isNotNull() & ~F.isnan("n.__v")
    pick = lambda here, edge: F.when(good, F.coalesce(here, edge))
    return met.select(*[F.col(f"n.__row.`{c}`") for c in rows.columns if c not in ("before", "after")], pick("n.before", "e.__b").alias("before"), pick("n.after", "e.__a").alias("after"))
