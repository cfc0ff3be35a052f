"""Ordered-sequence operators on clusters: principal order, curvature, weak smoothing, angle filter, interpolation, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.storage import cut_lineage

KEYS = ["inline_number", "label"]


def principal_order(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """points with pos, from 0, along the cluster's principal axis; ties by pid. The axis points to larger x."""
    geometry = points.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("z").alias("__mz"), (F.atan2(2 * F.covar_pop("x", "z"), F.var_pop("x") - F.var_pop("z")) * 0.5).alias("__t"))
    along = F.round(F.cos("__t") * (F.col("x") - F.col("__mx")) + F.sin("__t") * (F.col("z") - F.col("__mz")), 9)
    placed = points.join(geometry, keys).withColumn("__along", along)
    order = Window.partitionBy(*keys).orderBy("__along", "pid")
    return placed.withColumn("pos", F.row_number().over(order) - 1).drop("__mx", "__mz", "__t", "__along")


def arc_length(ordered: DataFrame, keys: list[str] = KEYS, least: float = 1e-6) -> DataFrame:
    """ordered with s: the length along the points in order of pos, each step at least `least`."""
    order = Window.partitionBy(*keys).orderBy("pos")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("z") - F.lag("z").over(order))
    with_step = ordered.withColumn("__step", F.when(F.col("pos") == 0, 0.0).otherwise(F.greatest(step, F.lit(least))))
    return with_step.withColumn("s", F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def gradient(df: DataFrame, value: str, name: str, keys: list[str] = KEYS) -> DataFrame:
    """df with the second-order derivative of value by s on uneven spacing, one-sided at both ends. Needs three rows a key."""
    w = Window.partitionBy(*keys).orderBy("pos")

    f = {k: (F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w) if k else F.col(value)) for k in range(-2, 3)}
    s = {k: (F.lag("s", -k).over(w) if k < 0 else F.lead("s", k).over(w) if k else F.col("s")) for k in range(-2, 3)}
    h1, h2 = s[0] - s[-1], s[1] - s[0]
    inner = -h2 / (h1 * (h1 + h2)) * f[-1] + (h2 - h1) / (h1 * h2) * f[0] + h1 / (h2 * (h1 + h2)) * f[1]
    a, b = s[1] - s[0], s[2] - s[1]
    left = -(2 * a + b) / (a * (a + b)) * f[0] + (a + b) / (a * b) * f[1] - a / (b * (a + b)) * f[2]
    c, d = s[-1] - s[-2], s[0] - s[-1]
    right = d / (c * (c + d)) * f[-2] - (c + d) / (c * d) * f[-1] + (2 * d + c) / (d * (c + d)) * f[0]
    return df.withColumn(name, F.when(f[-1].isNull(), left).when(f[1].isNull(), right).otherwise(inner))


def odd_window(window: int, minimum: int = 3) -> int:
    """The window raised to the minimum and to an odd number."""
    return max(minimum, window) | 1


def moving_mean(df: DataFrame, value: str, window: int, name: str, keys: list[str] = KEYS) -> DataFrame:
    """df with the centred mean of value over an odd window, end values repeated beyond the ends; in a cluster shorter than it, over the largest odd number of rows there are.

    With fewer than three rows the value itself. Each row sums a bounded frame and adds the end values that it lacks.
    """
    half = odd_window(window) // 2
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("pos")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"__n": F.count("*").over(whole), "__first": F.first(value).over(ends), "__last": F.last(value).over(ends)})
    own = F.least(F.lit(half), F.floor((F.col("__n") - 1) / 2))
    mean = F.col(value)
    for h in range(1, half + 1):
        before, after = F.greatest(F.lit(0), h - F.col("pos")), F.greatest(F.lit(0), h - (F.col("__n") - 1 - F.col("pos")))
        total = F.sum(value).over(order.rowsBetween(-h, h)) + before * F.col("__first") + after * F.col("__last")
        mean = F.when(own == h, total / (2 * h + 1)).otherwise(mean)
    return df.withColumn(name, mean).drop("__n", "__first", "__last")


def curvature(points: DataFrame, local_window: int = 7, tau: float = 0.5, delta: float = 0.001, edge_margin: int = 2, keys: list[str] = KEYS) -> DataFrame:
    """points with pos, kappa, eta and anomaly. Clusters of fewer than five points have curvature 0 and no anomaly."""
    n = F.count("*").over(Window.partitionBy(*keys))
    df = arc_length(principal_order(points, keys), keys).withColumn("__size", n)
    for value, name in (("x", "__dx"), ("z", "__dz"), ("__dx", "__ddx"), ("__dz", "__ddz")):
        df = gradient(df, value, name, keys)
    speed = F.pow(F.col("__dx") * F.col("__dx") + F.col("__dz") * F.col("__dz"), 1.5)
    kappa = F.when((F.col("__size") < 5) | (speed <= 1e-12), 0.0).otherwise(F.abs(F.col("__dx") * F.col("__ddz") - F.col("__dz") * F.col("__ddx")) / speed)
    df = moving_mean(df.withColumn("kappa", kappa), "kappa", local_window, "__mean", keys)
    eta = F.abs(F.col("kappa") - F.col("__mean")) / (F.col("__mean") + delta)
    inside = (F.col("pos") >= edge_margin) & (F.col("pos") < F.col("__size") - edge_margin) & (F.col("__size") >= 5)
    return df.withColumn("eta", eta).withColumn("anomaly", inside & (F.col("eta") > tau)).drop("s", "__size", "__dx", "__dz", "__ddx", "__ddz", "__mean")


def weak_smoothing(points: DataFrame, local_window: int = 7, smoothing_window: int = 5, tau: float = 0.5, delta: float = 0.001, blend: float = 0.01, max_shift: float = 0.05, keys: list[str] = KEYS, edge_margin: int = 2) -> DataFrame:
    """points with anomalous ones moved a little towards their moving mean, by at most max_shift; no point goes. Adds anomaly."""
    df = curvature(points, local_window, tau, delta, edge_margin, keys)
    df = moving_mean(moving_mean(df, "x", smoothing_window, "__sx", keys), "z", smoothing_window, "__sz", keys)
    dx, dz = blend * (F.col("__sx") - F.col("x")), blend * (F.col("__sz") - F.col("z"))
    length = F.hypot(dx, dz)
    scale = F.when(length > max_shift, max_shift / length).otherwise(1.0)
    new_x, new_z = F.when(F.col("anomaly"), F.col("x") + scale * dx).otherwise(F.col("x")), F.when(F.col("anomaly"), F.col("z") + scale * dz).otherwise(F.col("z"))
    return df.withColumns({"x": new_x, "z": new_z}).drop("__sx", "__sz", "kappa", "eta", "pos")


def turning_angle(x0: Column, z0: Column, x1: Column, z1: Column, x2: Column, z2: Column) -> Column:
    """Angle at the middle point in degrees; 180 where an arm has no length, null where there is none."""
    ax, az, bx, bz = x0 - x1, z0 - z1, x2 - x1, z2 - z1
    size = F.hypot(ax, az) * F.hypot(bx, bz)
    return F.when(size == 0, 180.0).when(size.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + az * bz) / size)))))


def sharp_points(points: DataFrame, threshold: float = 90, keys: list[str] = KEYS) -> DataFrame:
    """points with bad: interior ones with an angle below the threshold in order of x or of z. Reversed orders mirror these."""
    bad = F.lit(False)
    for axis in ("x", "z"):
        w = Window.partitionBy(*keys).orderBy(axis, "pid")
        angle = turning_angle(F.lag("x").over(w), F.lag("z").over(w), F.col("x"), F.col("z"), F.lead("x").over(w), F.lead("z").over(w))
        bad = bad | F.coalesce(angle < threshold, F.lit(False))
    return points.withColumn("bad", bad)


def angle_filter(points: DataFrame, threshold: float = 90, max_rounds: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """points without those at sharp angles: up to max_rounds rounds, each removing all bad points of a cluster at once; clusters with fewer than three left stop."""
    now = points
    for _ in range(max_rounds):
        size = F.count("*").over(Window.partitionBy(*keys))
        flagged = cut_lineage(sharp_points(now, threshold, keys).withColumn("bad", F.col("bad") & (size >= 3)))
        now = flagged.where("not bad").drop("bad")
        if flagged.where("bad").isEmpty():
            break
    return now


def interpolate_lines(points: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, x, z): z at the whole parts of min x, min x + 1, ... below max x + 1, linear between knots, half-even rounding; points of equal x count by the first pid.

    Clusters with fewer than two distinct x are left out. An x beyond the first or last knot extends that segment.
    """
    knots = points.groupBy(*keys, "x").agg(F.min_by("z", "pid").alias("z"))
    w = Window.partitionBy(*keys).orderBy("x")
    low, high = F.min("x").over(Window.partitionBy(*keys)), F.max("x").over(Window.partitionBy(*keys))
    final = F.floor(low + F.ceil(high + 1 - low) - 1).cast("int")
    segments = knots.withColumns({"x2": F.lead("x").over(w), "z2": F.lead("z").over(w), "__first": F.lag("x").over(w).isNull(), "__last": F.lead("x", 2).over(w).isNull(), "__final": final}).where(F.col("x2").isNotNull())
    begin = F.when(F.col("__first"), F.floor("x").cast("int")).otherwise(F.ceil("x").cast("int"))
    end = F.when(F.col("__last"), F.col("__final")).otherwise((F.ceil("x2") - 1).cast("int"))
    filled = segments.withColumn("__b", begin).withColumn("__e", end).where("__e >= __b").withColumn("xi", F.explode(F.sequence("__b", "__e")))
    value = F.col("z") + (F.col("xi") - F.col("x")) * (F.col("z2") - F.col("z")) / (F.col("x2") - F.col("x"))
    return filled.select(*keys, F.col("xi").alias("x"), F.rint(value).cast("int").alias("z"))


def resample(ordered: DataFrame, samples: int, keys: list[str]) -> DataFrame:
    """(keys, i, x, z): samples points at even arc length along the rows in order of pos, the ends included."""
    df = arc_length(ordered, keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    total = F.max("s").over(Window.partitionBy(*keys))
    seg = df.withColumn("__u", F.col("s") / total * (samples - 1)).withColumn("__u2", F.lead("__u").over(w)).withColumn("__x2", F.lead("x").over(w)).withColumn("__z2", F.lead("z").over(w))
    seg = seg.withColumn("__last", F.lead("__u", 2).over(w).isNull()).where(F.col("__u2").isNotNull())
    end = F.when(F.col("__last"), F.lit(samples - 1)).otherwise((F.ceil("__u2") - 1).cast("int"))
    at = seg.withColumn("__b", F.ceil("__u").cast("int")).withColumn("__e", end).where("__e >= __b").withColumn("i", F.explode(F.sequence("__b", "__e")))
    share = F.least(F.lit(1.0), (F.col("i") - F.col("__u")) / (F.col("__u2") - F.col("__u")))
    return at.select(*keys, "i", (F.col("x") + share * (F.col("__x2") - F.col("x"))).alias("x"), (F.col("z") + share * (F.col("__z2") - F.col("z"))).alias("z"))
