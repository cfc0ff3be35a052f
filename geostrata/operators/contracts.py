"""Contract checks as data: each returns the rows that break a rule, or one row per thing checked with its flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_contract(points: DataFrame, keys: list[str], nx: Column, nz: Column) -> DataFrame:
    """(keys, points, distinct_points, in_bounds, finite, whole, ok) of each cluster: at least two distinct points, finite and inside the section.

    `whole` says whether all coordinates are integers within 1e-9, so that they may be stored as such.
    """
    x, z = F.col("x").cast("double"), F.col("z").cast("double")
    finite = ~F.isnan(x) & ~F.isnan(z) & (F.abs(x) < float("inf")) & (F.abs(z) < float("inf"))
    rows = points.groupBy(*keys).agg(
        F.count("*").alias("points"), F.countDistinct("x", "z").alias("distinct_points"),
        F.bool_and(F.coalesce((x >= 0) & (z >= 0) & (x < nx) & (z < nz), F.lit(False))).alias("in_bounds"),
        F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"),
        F.bool_and(F.coalesce((F.abs(x - F.rint(x)) <= 1e-9) & (F.abs(z - F.rint(z)) <= 1e-9), F.lit(False))).alias("whole"),
    )
    return rows.withColumn("ok", (F.col("distinct_points") >= 2) & F.col("in_bounds") & F.col("finite"))


def dense_ids(points: DataFrame, section: str, cluster: str, name: str = "id") -> DataFrame:
    """points with the cluster's number, from 0, in its section: numbers first by value, then other names."""
    number = F.col(cluster).cast("string").try_cast("bigint")
    each = points.select(section, cluster).distinct()
    order = Window.partitionBy(section).orderBy(number.isNull(), number, F.col(cluster).cast("string"))
    return points.join(each.withColumn(name, (F.row_number().over(order) - 1).cast("int")), [section, cluster])


def count_mismatches(declared: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, declared, found) where a declared value is missing, differs from the one found, or was not declared."""
    a, b = declared.select(key, F.col(value).alias("declared")), found.select(key, F.col(value).alias("found"))
    return a.join(b, key, "full_outer").where(~F.col("declared").eqNullSafe(F.col("found")))


def malformed_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not line_<n> with n in canonical form."""
    return df.select(key).distinct().where(~F.coalesce(F.col(key).rlike("^line_(0|[1-9][0-9]*)$"), F.lit(False)))


def repeated_sections(df: DataFrame, checksum: str, section: str) -> DataFrame:
    """(checksum, section, n) of physical sections that are listed more than once."""
    return df.groupBy(checksum, section).agg(F.count("*").alias("n")).where("n > 1")


def select_inlines(available: DataFrame, origin: int, start: int, end: int, step: int = 1, allow_missing: bool = False, inline: str = "inline_number") -> DataFrame:
    """(inline): the available ones among start, start + step, ..., end. Ends off the origin's step, repeated inlines, no inline at all, and missing ones unless allowed, are errors."""
    for bad, why in (
        (end < start, "end must not precede start"), (step <= 0, "step must be positive"), (start < origin, "start must not precede origin"),
        (step > 0 and ((start - origin) % step != 0 or (end - origin) % step != 0), "start and end must lie on the origin's step"),
    ):
        if bad:
            raise ValueError(why)
    counts = available.groupBy(inline).agg(F.count("*").alias("n"))
    wanted = counts.where((F.col(inline) >= start) & (F.col(inline) <= end) & ((F.col(inline) - start) % step == 0))
    facts = counts.agg(F.count_if(F.col("n") > 1).alias("twice")).first(), wanted.count()
    if facts[0]["twice"]:
        raise ValueError("inlines are not unique")
    if not facts[1] or (facts[1] < (end - start) // step + 1 and not allow_missing):
        raise ValueError("no wanted inline is there" if not facts[1] else f"{(end - start) // step + 1 - facts[1]} wanted inlines are missing")
    return wanted.select(inline)


def missing_inlines(available: DataFrame, start: int, end: int, step: int = 1, inline: str = "inline_number") -> DataFrame:
    """(inline, available) of every wanted inline."""
    wanted = available.sparkSession.range(start, end + 1, step).select(F.col("id").alias(inline))
    there = available.select(F.col(inline).cast("long").alias(inline)).distinct().withColumn("__a", F.lit(True))
    return wanted.join(there, inline, "left").select(inline, F.coalesce("__a", F.lit(False)).alias("available"))


def same_axis(axis_length: int, stride: int, expected: int) -> int:
    """The stride that thins an axis of this length to the expected number of entries: the given one, or 1 if it was thinned already; else an error."""
    for s in (stride, 1):
        if -(-axis_length // s) == expected:
            return s
    raise ValueError(f"an axis of {axis_length} does not fit {expected} entries at stride {stride}")
