"""Probability pixels to fault lines, all sections at once: every stage is a DataFrame keyed by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.config import DetectionConfig
from geostrata.operators import cluster, curve, grid, islands
from geostrata.storage import cut_lineage

KEY = "inline_number"


def detect_lines(pixels: DataFrame, config: DetectionConfig = DetectionConfig()) -> dict[str, DataFrame]:
    """The stages by name, from `candidates` to `interpolated`. pixels: (inline_number, x, z, p), absent cells being 0.

    The first clustering gives the labels; the second only takes noise away. Points carry pid, their order
    within the section, which settles ties; it is renewed after the angle filter by label and former pid.
    """
    c = config
    out: dict[str, DataFrame] = {"candidates": grid.candidates(pixels, c.threshold).select(KEY, "x", "z")}
    out["ridge_core"] = grid.ridge_core(pixels, c.gradient_ratio, c.normal_step).join(out["candidates"], [KEY, "x", "z"], "left_semi")
    out["preserved"] = cut_lineage(grid.preserve_around_ridges(out["candidates"], out["ridge_core"], c.support_radius, c.min_keep_ratio))
    grouped = islands.group_points(out["preserved"], c.max_gap)
    order = Window.partitionBy(KEY).orderBy("x", "z")
    points = cut_lineage(grouped.withColumn("pid", (F.row_number().over(order) - 1).cast("long")).withColumns({"x": F.col("x").cast("double"), "z": F.col("z").cast("double")}))
    out["grouped"] = points
    labelled = points.join(cluster.dbscan(points, c.eps, c.min_samples), [KEY, "pid"]).where("label >= 0")
    out["clustered"] = cut_lineage(labelled)
    out["smoothed"] = curve.weak_smoothing(out["clustered"], c.local_window, c.smoothing_window, c.tau, c.delta, c.blend, c.max_shift, edge_margin=c.edge_margin).drop("anomaly")
    kept = curve.angle_filter(out["smoothed"], c.angle_threshold, c.max_rounds)
    renewed = kept.withColumn("pid", (F.row_number().over(Window.partitionBy(KEY).orderBy("label", "pid")) - 1).cast("long"))
    out["angles"] = cut_lineage(renewed)
    noise = cluster.noise_mask(out["angles"], c.second_eps, c.second_min_samples).where("noise").select(KEY, "pid")
    out["dense"] = cut_lineage(out["angles"].join(noise, [KEY, "pid"], "left_anti"))
    out["merged"] = cut_lineage(cluster.merge_clusters(out["dense"], c.merge_theta, c.merge_distance, c.merge_extrapolation))
    out["large"] = cut_lineage(cluster.large_clusters(out["merged"], c.min_cluster_points, c.min_vertical_range))
    again = curve.weak_smoothing(out["large"], c.local_window, c.smoothing_window, c.tau, c.delta, c.blend, c.max_shift, edge_margin=c.edge_margin).drop("anomaly")
    out["cleaned"] = cut_lineage(curve.angle_filter(again, c.angle_threshold, c.max_rounds))
    out["interpolated"] = curve.interpolate_lines(out["cleaned"])
    return out


# Published counts of the reference section, inline 600, at the default parameters: points and, once there are any, clusters.
GOLDEN_COUNTS = {
    "candidates": (32195, 0), "ridge_core": (836, 0), "preserved": (32163, 0), "grouped": (2253, 0), "clustered": (2031, 114), "angles": (1968, None), "dense": (1967, None),
    "merged": (None, 81), "large": (1254, 15), "cleaned": (1202, None), "interpolated": (1927, 15),
}


def golden_mismatches(counts: DataFrame, inline: int, expected: dict[str, tuple[int | None, int | None]] = GOLDEN_COUNTS) -> DataFrame:
    """(stage, points, clusters, expected_points, expected_clusters) of the inline's stages that differ from the expected counts; a count of None is not compared. Empty if all agree."""
    wanted = counts.sparkSession.createDataFrame([(k, *v) for k, v in expected.items()], "stage string, expected_points long, expected_clusters long")
    found = counts.where(F.col(KEY) == inline).select("stage", "points", "clusters")
    off = lambda c: F.col(f"expected_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"expected_{c}"))
    return wanted.join(found, "stage", "left").where(off("points") | off("clusters")).select("stage", "points", "clusters", "expected_points", "expected_clusters")


def tagged_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """(inline_number, stage, label) of all points of all stages; label is null in stages without clusters."""
    parts = [df.select(KEY, F.lit(name).alias("stage"), (F.col("label") if "label" in df.columns else F.lit(None)).cast("string").alias("label")) for name, df in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(inline_number, stage, points, clusters) of every stage."""
    return stage_report(tagged_stages(stages)).where("level = 0").drop("level")


def stage_report(tagged: DataFrame) -> DataFrame:
    """(inline_number, stage, level, points, clusters): counts by inline and stage (level 0), by stage over all inlines (1) and over all (3), in one pass over tagged stages.

    A cluster is a label within an inline and stage; points are added up by it first, so the rollup sees one row a cluster.
    """
    cluster = tagged.groupBy(KEY, "stage", "label").agg(F.count("*").alias("points"))
    rolled = cluster.rollup("stage", KEY).agg(F.grouping_id("stage", KEY).alias("level"), F.sum("points").alias("points"), F.count("label").alias("clusters"))
    return rolled.select(KEY, "stage", "level", "points", "clusters").where("points is not null")
