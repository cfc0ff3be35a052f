"""Operators on grids of pixels (key, x, z, value): thresholds, gradients, ridges, dilation, nearest distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators import blocks
from geostrata.storage import cut_lineage

KEY = "inline_number"


def candidates(pixels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pixels strictly above the threshold, compared as 32-bit floats."""
    return pixels.where(F.col("p").cast("float") > F.lit(threshold).cast("float"))


def dense_grid(pixels: DataFrame, key: str = KEY) -> DataFrame:
    """pixels with absent cells of each key's bounding box as p = 0. The box's cells come from one range per column, not from a join of all x with all z."""
    box = pixels.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    cells = box.select(key, "z0", "z1", F.explode(F.sequence("x0", "x1")).alias("x")).select(key, "x", F.explode(F.sequence("z0", "z1")).alias("z"))
    return cells.join(pixels, [key, "x", "z"], "left").select(key, "x", "z", F.coalesce("p", F.lit(0.0)).alias("p"))


def gradients(grid: DataFrame, key: str = KEY) -> DataFrame:
    """grid with gx, gz: central differences, one-sided at the edges. Both run along one line of the grid, so no task holds a section."""
    for axis, across, name in (("x", "z", "gx"), ("z", "x", "gz")):
        w = Window.partitionBy(key, across).orderBy(axis)
        before, after = F.lag("p").over(w), F.lead("p").over(w)
        inner = (after - before) / 2
        grid = grid.withColumn(name, F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("p")).when(after.isNull(), F.col("p") - before).otherwise(inner))
    return grid


def ridge_core(pixels: DataFrame, gradient_ratio: float = 0.1, step: float = 1.0, key: str = KEY) -> DataFrame:
    """Pixels (p; absent cells of a section's bounding box being 0) that are at least as high as both points a step along the gradient, where it is at least a share of the section's largest."""
    return blocks.ridge_core(pixels, gradient_ratio, step, key)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def ellipse(a: int, c: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-a, a + 1) for j in range(-c, c + 1) if (i / a) ** 2 + (j / c) ** 2 <= 1.0]


def dilate(points: DataFrame, offsets: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Distinct points at the given offsets from points."""
    return blocks.dilate(points, offsets, keys)


def preserve_around_ridges(points: DataFrame, core: DataFrame, radius: int = 8, min_keep_ratio: float = 0.999, key: str = KEY) -> DataFrame:
    """Points within the radius of a ridge, and the nearest others, in order of distance, x, z, until the share is kept.

    Sections without a core, or a ratio of 1, keep all points. Distances beyond the radius are to the
    section's nearest core point, found on rings of cells of growing width.
    """
    if min_keep_ratio >= 1:
        return points.select(key, "x", "z")
    points, core = cut_lineage(points.select(key, "x", "z")), cut_lineage(core)
    told = cut_lineage(blocks.within(points, core, disk(radius), [key]))
    near, rest = told.where("near").drop("near"), told.where("not near").drop("near")
    nearest = nearest_distance(rest, core, key, first=radius)
    total = points.groupBy(key).agg(F.ceil(F.count("*") * min_keep_ratio).alias("need"))
    have = near.groupBy(key).agg(F.count("*").alias("have"))
    missing = total.join(have, key, "left").select(key, (F.col("need") - F.coalesce("have", F.lit(0))).alias("missing"))
    ranked = nearest.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("d", "x", "z")))
    added = ranked.join(missing, key).where("n <= missing").select(key, "x", "z")
    bare = points.join(core.select(key).distinct(), key, "left_anti")
    return near.select(key, "x", "z").union(added).union(bare)


def nearest_distance(points: DataFrame, core: DataFrame, key: str = KEY, first: int = 8, rounds: int = 40) -> DataFrame:
    """(key, x, z, d): each point's distance to the nearest core point of its key; points of keys without one are left out.

    Cells double in width each round; a point is settled once its best distance is at most the width, as
    everything that near lies in the cells around its own.
    """
    left = cut_lineage(points.join(core.select(key).distinct(), key, "left_semi"))
    core = cut_lineage(core.select(key, "x", "z"))
    done, width = None, max(1, first)
    for _ in range(rounds):
        width *= 2
        cell = left.withColumns({"cx": F.floor(F.col("x") / width), "cz": F.floor(F.col("z") / width)})
        around = cell.select(key, "x", "z", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cz").select(key, "x", "z", "cx", F.explode(F.sequence(F.col("cz") - 1, F.col("cz") + 1)).alias("cz"))
        other = core.select(key, F.col("x").alias("x2"), F.col("z").alias("z2"), F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("z") / width).alias("cz"))
        best = around.join(other, [key, "cx", "cz"]).groupBy(key, "x", "z").agg(F.min(F.hypot(F.col("x") - F.col("x2"), F.col("z") - F.col("z2"))).alias("d")).where(F.col("d") <= width)
        best = cut_lineage(best)
        done = best if done is None else done.union(best)
        left = cut_lineage(left.join(best.select(key, "x", "z"), [key, "x", "z"], "left_anti"))
        if left.isEmpty():
            break
    return done
