"""Density clustering and cluster geometry on points of many sections at once: blocks find clusters (density.py), and what joins blocks is put together here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators import density
from geostrata.operators.components import components
from geostrata.operators.nearest import closest_squared
from geostrata.storage import cut_lineage

#: Points of a cluster that are searched at once for the nearest of another's.
SLAB = 1 << 14


def noise_mask(points: DataFrame, eps: float, min_samples: int, key: str = "inline_number") -> DataFrame:
    """(key, pid, core, noise): a core point has at least min_samples points within eps, itself included; noise is neither core nor next to a core point."""
    found = density.local_clusters(points, eps, min_samples, key).where("own")
    return found.select(key, "pid", "core", (F.size("roots") == 0).alias("noise"))


def dbscan(points: DataFrame, eps: float, min_samples: int, key: str = "inline_number") -> DataFrame:
    """(key, pid, label): clusters by density, -1 for noise. pid, a whole number, orders a section's points.

    Clusters are components of core points, numbered within a section by their smallest core pid; a border point
    takes the lowest-numbered cluster of its core neighbours.
    """
    found = density.local_clusters(points, eps, min_samples, key)
    joined = cut_lineage(density.joined_roots(found, key))
    number = joined.select(key, "cluster").distinct().withColumn("number", F.dense_rank().over(Window.partitionBy(key).orderBy("cluster")) - 1)
    named = joined.join(number, [key, "cluster"]).select(key, "root", "number")
    own = found.where("own").select(key, "pid", F.explode_outer("roots").alias("root"))
    out = own.join(named, [key, "root"], "left").groupBy(key, "pid").agg(F.min("number").alias("number"))
    return out.select(key, "pid", F.coalesce("number", F.lit(-1)).cast("int").alias("label"))


def large_clusters(points: DataFrame, min_points: int = 30, min_range: float = 30, key: str = "inline_number") -> DataFrame:
    """Points of clusters with at least min_points points and a depth range above min_range, labels renumbered by first pid."""
    stats = points.groupBy(key, "label").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("range"), F.min("pid").alias("first"))
    kept = stats.where((F.col("n") >= min_points) & (F.col("range") > min_range))
    kept = kept.withColumn("new", F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).select(key, "label", "new")
    return points.join(kept, [key, "label"]).drop("label").withColumnRenamed("new", "label")


def cluster_geometry(points: DataFrame, key: str = "inline_number") -> DataFrame:
    """(key, label, n, mx, mz, theta): centroid and axis direction of each cluster."""
    return points.groupBy(key, "label").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("z").alias("mz"),
        (F.atan2(2 * F.covar_pop("x", "z"), F.var_pop("x") - F.var_pop("z")) * 0.5).alias("theta"),
    )


def near_boxes(points: DataFrame, reach: float, key: str = "inline_number") -> DataFrame:
    """(key, i, j): clusters i < j of a section whose bounding boxes are nearer than reach, found on the cells of that width that the boxes cover."""
    box = points.groupBy(key, "label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    span = lambda low, high, more: F.explode(F.sequence(F.floor(F.col(low) / reach) - more, F.floor(F.col(high) / reach) + more))
    a = box.select(key, F.col("label").alias("i"), *[F.col(c).alias(f"a{c}") for c in ("x0", "x1", "z0", "z1")])
    a = a.withColumn("cx", span("ax0", "ax1", 1)).withColumn("cz", span("az0", "az1", 1))
    b = box.withColumnRenamed("label", "j").withColumn("cx", span("x0", "x1", 0)).withColumn("cz", span("z0", "z1", 0))
    dx = F.greatest(F.lit(0.0), F.col("ax0") - F.col("x1"), F.col("x0") - F.col("ax1"))
    dz = F.greatest(F.lit(0.0), F.col("az0") - F.col("z1"), F.col("z0") - F.col("az1"))
    return a.join(b, [key, "cx", "cz"]).where("i < j").where(dx * dx + dz * dz < reach * reach).select(key, "i", "j").distinct()


def _angle(a: str, b: str):
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.cos(F.col(a) - F.col(b))))))


def pair_angles(pairs: DataFrame, points: DataFrame, key: str = "inline_number") -> DataFrame:
    """pairs with the axial angle, in degrees, and the axes of both clusters."""
    axis = cluster_geometry(points, key)
    for side in ("i", "j"):
        pairs = pairs.join(axis.select(key, F.col("label").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("theta", "mx", "mz")]), [key, side])
    return pairs.withColumn("angle", _angle("theta_i", "theta_j"))


def pair_extrapolation(pairs: DataFrame, points: DataFrame, key: str = "inline_number") -> DataFrame:
    """pairs of pair_angles with extrapolation: the smaller of the mean distances of one cluster's points to the other's axis."""
    own = points.select(key, "label", "x", "z")

    def off(side: str, to: str) -> DataFrame:
        line = pairs.select(key, "i", "j", F.col(side).alias("label"), F.col(f"theta_{to}").alias("t"), F.col(f"mx_{to}").alias("mx"), F.col(f"mz_{to}").alias("mz"))
        away = F.abs(-F.sin("t") * (F.col("x") - F.col("mx")) + F.cos("t") * (F.col("z") - F.col("mz")))
        return line.join(own, [key, "label"]).groupBy(key, "i", "j").agg(F.avg(away).alias(f"off_{side}"))

    both = off("i", "j").join(off("j", "i"), [key, "i", "j"]).select(key, "i", "j", F.least("off_i", "off_j").alias("extrapolation"))
    return pairs.join(both, [key, "i", "j"])


def pair_distances(pairs: DataFrame, points: DataFrame, reach: float | None = None, key: str = "inline_number") -> DataFrame:
    """(key, i, j, distance) between the nearest points of each pair; with reach, for pairs nearer than it alone, on cells of that width.

    A cluster's points in a cell are dealt in their order to slabs of at most SLAB. Slabs meet by pair and cell as boxes
    with one point each; only those whose boxes are no further apart than the nearest of these points fetch
    their points, and a search in two slabs takes few steps a point.
    """
    cell = {c: F.floor(F.col(x) / reach) if reach else F.lit(0).cast("long") for c, x in (("cx", "x"), ("cz", "z"))}
    used = pairs.select(key, F.explode(F.array("i", "j")).alias("label")).distinct()
    own = points.where("x is not null and z is not null").join(used, [key, "label"], "left_semi").select(key, "label", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")).withColumns(cell)
    order = Window.partitionBy(key, "label", "cx", "cz").orderBy("x", "z")
    dealt = own.withColumn("slab", F.floor((F.row_number().over(order) - 1) / SLAB)).groupBy(key, "label", "cx", "cz", "slab")
    slabs = cut_lineage(dealt.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min(F.struct("x", "z")).alias("one"), F.collect_list(F.struct("x", "z")).alias("points")))
    name = lambda side: F.struct(F.col("label").alias(side), "cx", "cz", "slab").alias(f"slab_{side}")
    box = lambda side: slabs.select(key, F.col("label").alias(side), "cx", "cz", name(side), F.struct("x0", "x1", "z0", "z1", "one").alias(f"box_{side}"))
    a = pairs.select(key, "i", "j").join(box("i"), [key, "i"])
    if reach:
        around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
        a = a.select(key, "i", "j", "slab_i", "box_i", around("cx"), "cz").select(key, "i", "j", "slab_i", "box_i", "cx", around("cz"))
    met = a.join(box("j"), [key, "j", "cx", "cz"])
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"box_i.{c}0") - F.col(f"box_j.{c}1"), F.col(f"box_j.{c}0") - F.col(f"box_i.{c}1"))
    step = lambda c: F.col(f"box_i.one.{c}") - F.col(f"box_j.one.{c}")
    met = met.select(key, "i", "j", "slab_i", "slab_j", (gap("x") * gap("x") + gap("z") * gap("z")).alias("least"), (step("x") * step("x") + step("z") * step("z")).alias("most"))
    if reach:
        met = met.where(F.col("least") < reach * reach)
    met = cut_lineage(met)
    near = met.join(met.groupBy(key, "i", "j").agg(F.min("most").alias("bound")), [key, "i", "j"]).where("least <= bound").select(key, "i", "j", "slab_i", "slab_j")
    for side in ("i", "j"):
        held = slabs.select(key, name(side), F.col("points.x").alias(f"x_{side}"), F.col("points.z").alias(f"z_{side}"))
        near = near.join(held.hint("merge"), [key, f"slab_{side}"])
    found = near.withColumn("d", _closest("x_i", "z_i", "x_j", "z_j")).groupBy(key, "i", "j").agg(F.min("d").alias("distance"))
    return found.where(F.col("distance") < reach) if reach else found


def _closest(*columns: str) -> Column:
    """The distance of the closest points of two slabs."""

    @F.pandas_udf("double")
    def closest(x: pd.Series, z: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([closest_squared(*each) for each in zip(x, z, u, v, strict=True)], dtype=float) ** 0.5

    return closest(*columns)


def pair_metrics(points: DataFrame, key: str = "inline_number", max_distance: float | None = None) -> DataFrame:
    """(key, i, j, angle, distance, extrapolation) of cluster pairs i < j of a section.

    angle: axial, in degrees; distance: between the nearest points; extrapolation: the smaller of the mean
    distances of one cluster's points to the other's axis. With max_distance only pairs nearer than that are
    given, and boxes rule the others out before any point is met; without, all pairs of a section's clusters are.
    """
    each = points.select(key, "label").distinct()
    every = each.select(key, F.col("label").alias("i")).join(each.select(key, F.col("label").alias("j")), key).where("i < j")
    pairs = pair_angles(near_boxes(points, max_distance, key) if max_distance else every, points, key)
    distances = pair_distances(pairs, points, max_distance, key)
    return pair_extrapolation(pairs, points, key).join(distances, [key, "i", "j"]).select(key, "i", "j", "angle", "distance", "extrapolation")


def merge_clusters(points: DataFrame, theta: float = 17, distance: float = 75, extrapolation: float = 8, key: str = "inline_number", max_rounds: int | None = None) -> DataFrame:
    """points with labels merged: pairs whose angle, distance and extrapolation are all strictly below the limits join, transitively.

    Geometry is recomputed on merged clusters until nothing changes, which takes at most as many rounds as there
    are clusters; max_rounds stops earlier. Boxes and angles rule pairs out before points are met. Final labels
    are dense by the smallest original member.
    """
    now, rounds = cut_lineage(points), 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        pairs = cut_lineage(pair_angles(near_boxes(now, distance, key), now, key).where(F.col("angle") < theta))
        pairs = cut_lineage(pair_extrapolation(pairs, now, key).where(F.col("extrapolation") < extrapolation))
        pairs = cut_lineage(pair_distances(pairs, now, distance, key))
        if pairs.isEmpty():
            break
        root = components(pairs, key, "i", "j").select(key, F.col("node").alias("label"), "component")
        now = cut_lineage(now.join(root, [key, "label"], "left").withColumn("label", F.coalesce("component", "label")).drop("component"))
    dense = now.select(key, "label").distinct().withColumn("new", F.dense_rank().over(Window.partitionBy(key).orderBy("label")) - 1)
    return now.join(dense, [key, "label"]).drop("label").withColumnRenamed("new", "label")
