"""Linking fault lines across sections: line statistics, band join with pruning, scores, best matches, tracks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.config import LinkConfig
from geostrata.operators import ranking
from geostrata.operators.nearest import mutual_squared, nearest_squared  # noqa: F401  (the latter is part of this module's interface)
from geostrata.storage import cut_lineage


def fault_lines(points: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """One row per (sec, cluster) with at least two distinct points: scaled extent, axis angle, means and the points.

    points: (sec, cluster, x, z). line_id is line_<sec>_c<cluster>. A single aggregate by line; the points
    travel as two arrays for the exact distances.
    """
    x, z = F.col("x") * config.profile_scale, F.col("z") * config.depth_scale
    scaled = points.distinct().select("sec", "cluster", F.col("x").alias("px"), F.col("z").alias("pz"), x.alias("x"), z.alias("z"))
    lines = scaled.groupBy("sec", "cluster").agg(
        F.count("*").alias("n"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"),
        (F.atan2(2 * F.covar_pop("x", "z"), F.var_pop("x") - F.var_pop("z")) * 0.5).alias("theta"),
        F.avg("px").alias("mean_x"), F.avg("pz").alias("mean_z"),
        F.array_sort(F.collect_list(F.struct("x", "z"))).alias("points"),
    )
    return lines.where("n >= 2").withColumn("line_id", F.format_string("line_%d_c%s", "sec", "cluster"))


def bbox_gap(a: str = "a", b: str = "b") -> Column:
    """Distance between the bounding boxes of two lines in their sections' plane."""
    dx = F.greatest(F.lit(0.0), F.col(f"{a}.x0") - F.col(f"{b}.x1"), F.col(f"{b}.x0") - F.col(f"{a}.x1"))
    dz = F.greatest(F.lit(0.0), F.col(f"{a}.z0") - F.col(f"{b}.z1"), F.col(f"{b}.z0") - F.col(f"{a}.z1"))
    return F.sqrt(dx * dx + dz * dz)


def orientation_difference(a: Column, b: Column) -> Column:
    """1 - |cos| of two axial directions, in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.abs(F.cos(a - b))))


def _bounded(source: DataFrame, target: DataFrame, on: list[str], config: LinkConfig) -> DataFrame:
    """Pairs (a, b) that meet by `on`, with gap, orientation, the lower bound of their energy and whether it prunes them."""
    pairs = source.join(target, on).withColumn("gap", F.col("b.sec") - F.col("a.sec"))
    step = F.col("gap") * config.section_scale
    apart = F.sqrt(bbox_gap() * bbox_gap() + step * step)
    pairs = pairs.withColumn("orientation", orientation_difference(F.col("a.theta"), F.col("b.theta")))
    bound = 2 * config.distance_weight * apart + config.orientation_weight * F.col("orientation")
    return pairs.withColumn("bound", bound).withColumn("pruned", F.col("bound") >= -math.log(config.tau))


def _ends(lines: DataFrame, config: LinkConfig) -> tuple[DataFrame, DataFrame]:
    """Lines as sources `a`, sent to the sections that they may link to, and as targets `b`. Line-level columns alone; points are fetched by line for pairs that are left."""
    whole = F.struct("line_id", "sec", "theta", "x0", "x1", "z0", "z1")
    return lines.select(whole.alias("a"), F.explode(F.sequence(F.col("sec") + 1, F.col("sec") + config.max_gap)).alias("at")), lines.select(whole.alias("b"), F.col("sec").alias("at"))


def candidate_pairs(lines: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """All forward pairs (a, b) up to max_gap sections apart, with the lower bound of their energy and whether it prunes them: a report on every pair, by an equi-join on sections."""
    return _bounded(*_ends(lines, config), ["at"], config)


def near_pairs(lines: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """The candidate pairs that are not pruned, without meeting all the others.

    Boxes further apart than -ln(tau) / (2 distance_weight) are always pruned, so lines meet by section and by cells
    along x, which the source's box reaches with that margin. A pair counts in the first cell that both have.
    """
    reach = -math.log(config.tau) / (2 * config.distance_weight) if config.distance_weight else math.inf
    if not 0 < reach < math.inf:
        return candidate_pairs(lines, config).where("not pruned")
    source, target = _ends(lines, config)
    width = 4 * reach
    cell = lambda c: F.floor(c / width)
    source = source.withColumns({"low": cell(F.col("a.x0") - reach), "cell": F.explode(F.sequence(cell(F.col("a.x0") - reach), cell(F.col("a.x1") + reach)))})
    target = target.withColumns({"low2": cell(F.col("b.x0")), "cell": F.explode(F.sequence(cell(F.col("b.x0")), cell(F.col("b.x1"))))})
    met = _bounded(source, target, ["at", "cell"], config)
    return met.where((F.col("cell") == F.greatest("low", "low2")) & ~F.col("pruned"))


def chamfer_parts(*columns: Column) -> Column:
    """(ab, ba): the two directed mean nearest-neighbour distances of lines x, z and u, v at a distance of `step` along the section axis.

    Marked as not deterministic, so that no filter on the result is moved before it and runs it a second time.
    """

    @F.pandas_udf("ab double, ba double")
    def parts(ax: pd.Series, az: pd.Series, bx: pd.Series, bz: pd.Series, step: pd.Series) -> pd.DataFrame:
        rows = [_nearest_with_step(x, z, u, v, float(s)) for x, z, u, v, s in zip(ax, az, bx, bz, step, strict=True)]
        return pd.DataFrame(rows, columns=["ab", "ba"])

    return parts.asNondeterministic()(*columns)


def _nearest_with_step(x: np.ndarray, z: np.ndarray, u: np.ndarray, v: np.ndarray, step: float) -> tuple[float, float]:
    """Mean distances of each line's points to the nearest of the other's, `step` apart along the section axis."""
    there, back = mutual_squared(x, z, u, v)
    return float(np.sqrt(there + step * step).mean()), float(np.sqrt(back + step * step).mean())


def score_candidates(lines: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Exact scores of the pairs that pruning leaves: chamfer both ways, orientation, similarity, above_threshold. A line's points meet each of its pairs once.

    Pairs are dealt by line and gap, so that a line's pairs are not all one task's, and are searched by a number of tasks
    that is not lowered by their bytes: a pair takes far more time than its bytes tell. Lines are read more than once:
    give them with their lineage cut.
    """
    session = lines.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    left = near_pairs(lines, config).select("a", "b", "gap", "orientation", F.col("a.line_id").alias("ia"), F.col("b.line_id").alias("ib"))
    gaps = F.explode(F.sequence(F.lit(1), F.lit(config.max_gap))).alias("gap")
    for side in ("ia", "ib"):
        points = lines.select(F.col("line_id").alias(side), F.col("points.x").alias(f"{side}x"), F.col("points.z").alias(f"{side}z"), gaps)
        dealt = left.repartition(tasks, side, "gap") if side == "ib" else left
        left = dealt.join(points.hint("merge"), [side, "gap"])  # whole lines are not to be broadcast
    step = F.col("gap") * F.lit(config.section_scale)
    scored = left.withColumn("c", chamfer_parts(F.col("iax"), F.col("iaz"), F.col("ibx"), F.col("ibz"), step))
    scored = scored.withColumn("chamfer", F.col("c.ab") + F.col("c.ba"))
    similarity = F.exp(-(config.distance_weight * F.col("chamfer") + config.orientation_weight * F.col("orientation")))
    inline = lambda sec: config.inline_origin + F.col(sec) * config.inline_step
    return scored.select(
        F.col("ia").alias("source_id"), F.col("ib").alias("target_id"), F.col("a.sec").alias("source_sec"), F.col("b.sec").alias("target_sec"),
        inline("a.sec").alias("source_inline"), inline("b.sec").alias("target_inline"), "gap",
        F.col("c.ab").alias("chamfer_ab"), F.col("c.ba").alias("chamfer_ba"), "chamfer", "orientation", similarity.alias("similarity"),
    ).withColumn("above_threshold", F.col("similarity") > config.tau)


def best_matches(scored: DataFrame) -> DataFrame:
    """Pairs above the threshold with source_best and selected: each source's best target, then each target's best of those sources."""
    by_source = Window.partitionBy("source_id").orderBy(F.desc("similarity"), "gap", "target_id")
    by_target = Window.partitionBy("target_id").orderBy(F.desc("source_best"), F.desc("similarity"), "gap", "source_id")
    ranked = scored.where("above_threshold").withColumn("source_best", F.row_number().over(by_source) == 1)
    return ranked.withColumn("selected", F.col("source_best") & (F.row_number().over(by_target) == 1))


def chains(edges: DataFrame, max_doublings: int = 32) -> DataFrame:
    """(line_id, start, position) of one-to-one edges (source_id, target_id): pointer doubling from each line to its chain's first.

    Each round joins a line's pointer with its pointer's pointer, so a chain of n lines takes log2(n) rounds.
    """
    nodes = edges.select(F.col("source_id").alias("line_id")).union(edges.select("target_id")).distinct()
    back = edges.select(F.col("target_id").alias("line_id"), F.col("source_id").alias("up"))
    now = nodes.join(back, "line_id", "left").select("line_id", F.coalesce("up", "line_id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("far"))
    for _ in range(max_doublings):
        now = cut_lineage(now)
        over = now.select(F.col("line_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        then = now.join(over, "up").select("line_id", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("up2") != F.col("up")).alias("moved"))
        then = cut_lineage(then)
        moved = not then.where("moved").isEmpty()
        now = then.drop("moved")
        if not moved:
            break
    return now.select("line_id", F.col("up").alias("start"), F.col("far").alias("position"))


def build_tracks(matches: DataFrame, lines: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Track membership (track_id, member_order, line_id, sec): chains of selected gap-1 edges with at least min_lines lines.

    A selected edge over a larger gap uses up its ends and splits the path, so only gap-1 edges chain. Tracks
    are numbered by first section, mean of line means in x, then z, then first line.
    """
    edges = matches.where("selected and gap = 1").select("source_id", "target_id")
    member = chains(edges).join(lines.select("line_id", "sec", "mean_x", "mean_z"), "line_id")
    tracks = member.groupBy("start").agg(F.count("*").alias("lines"), F.min("sec").alias("first"), F.avg("mean_x").alias("mx"), F.avg("mean_z").alias("mz")).where(F.col("lines") >= config.min_lines)
    tracks = tracks.withColumns({"mx": F.round("mx", 9), "mz": F.round("mz", 9)})
    tracks = ranking.numbered(tracks, ["first", "mx", "mz", "start"]).withColumn("track_id", F.format_string("fault_%04d", F.col("place") + 1))
    return member.join(tracks.select("start", "track_id"), "start").select("track_id", F.col("position").cast("int").alias("member_order"), "line_id", "sec")


def consecutive_runs(sections: DataFrame, k: int) -> DataFrame:
    """(track, longest, valid): the longest run of consecutive section numbers of each track, and whether it has k members."""
    each = sections.select("track", "sec").distinct()
    run = each.withColumn("island", F.col("sec") - F.row_number().over(Window.partitionBy("track").orderBy("sec")))
    sizes = run.groupBy("track", "island").agg(F.count("*").alias("n"))
    return sizes.groupBy("track").agg(F.max("n").alias("longest")).withColumn("valid", F.col("longest") >= k)


def neighbouring_sections(sections: DataFrame, reach: int = 5) -> DataFrame:
    """(sec, neighbour): available sections at most reach away on either side, a section itself excluded."""
    each = sections.select("sec").distinct()
    near = each.select("sec", F.explode(F.sequence(F.col("sec") - reach, F.col("sec") + reach)).alias("neighbour")).where("sec <> neighbour")
    return near.join(each.select(F.col("sec").alias("neighbour")), "neighbour", "left_semi").select("sec", "neighbour")
