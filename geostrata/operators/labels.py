"""Label patches: picks, rasters, dilation, downsampling, patches, weights and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators.grid import dilate, ellipse


def picks_to_indices(raw: DataFrame, x: str, z: str, x_offset: float, x_scale: float, z_offset: float, z_scale: float) -> DataFrame:
    """raw with x_idx, z_idx: offset, scaled and rounded half to even; rows that are null, NaN or infinite are dropped."""
    a, b = (F.col(x).cast("double") - x_offset) / x_scale, (F.col(z).cast("double") - z_offset) / z_scale
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in (a, b)]
    return raw.where(finite[0] & finite[1]).withColumns({"x_idx": F.rint(a).cast("int"), "z_idx": F.rint(b).cast("int")})


def inside(points: DataFrame, nx: int, nz: int, x: str = "x", z: str = "z") -> DataFrame:
    """Points with 0 <= x < nx and 0 <= z < nz."""
    return points.where((F.col(x) >= 0) & (F.col(x) < nx) & (F.col(z) >= 0) & (F.col(z) < nz))


def polyline_segments(picks: DataFrame, keys: list[str], x: str = "x_idx", z: str = "z_idx") -> DataFrame:
    """(keys, x0, z0, x1, z1): consecutive distinct picks of each line in order of x, z; a lone pick is a segment of itself."""
    w = Window.partitionBy(*keys).orderBy(x, z)
    rows = picks.select(*keys, x, z).distinct()
    rows = rows.select(*keys, F.col(x).alias("x0"), F.col(z).alias("z0"), F.lead(x).over(w).alias("x1"), F.lead(z).over(w).alias("z1"), F.lag(x).over(w).isNull().alias("first"))
    return rows.where("x1 is not null or first").select(*keys, "x0", "z0", F.coalesce("x1", "x0").alias("x1"), F.coalesce("z1", "z0").alias("z1"))


def raster(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pixels of integer segments: along the longer axis one by one, along the other by the nearest whole step."""
    dx, dz = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("z1") - F.col("z0"))
    sx, sz = F.when(F.col("x0") < F.col("x1"), 1).otherwise(-1), F.when(F.col("z0") < F.col("z1"), 1).otherwise(-1)
    rows = segments.withColumns({"dx": dx, "dz": dz, "sx": sx, "sz": sz}).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest("dx", "dz"))))
    along_x = F.col("dx") > F.col("dz")
    minor_z = F.greatest(F.lit(0), F.floor((2 * F.col("k") * F.col("dz") + F.col("dx") - 1) / F.greatest(2 * F.col("dx"), F.lit(1)))).cast("int")
    minor_x = F.greatest(F.lit(0), F.floor((2 * F.col("k") * F.col("dx") + F.col("dz") - 1) / F.greatest(2 * F.col("dz"), F.lit(1)))).cast("int")
    x = F.col("x0") + F.col("sx") * F.when(along_x, F.col("k")).otherwise(minor_x)
    z = F.col("z0") + F.col("sz") * F.when(along_x, minor_z).otherwise(F.col("k"))
    return rows.select(*keys, x.alias("x"), z.alias("z")).distinct()


def label_map(picks: DataFrame, nx: int, nz: int, keys: list[str], fault: str | None = "fault_id", a: int = 8, c: int = 4, down_x: int = 1, down_z: int = 1) -> DataFrame:
    """Label pixels: picks in bounds, rasterised by fault (points alone without one), dilated by an ellipse, clipped, then every down-th row and column."""
    points = inside(picks, nx, nz, "x_idx", "z_idx")
    drawn = raster(polyline_segments(points, [*keys, fault]), keys) if fault else points.select(*keys, F.col("x_idx").alias("x"), F.col("z_idx").alias("z")).distinct()
    wide = inside(dilate(drawn, ellipse(a, c), keys), nx, nz)
    return wide.where((F.col("x") % down_x == 0) & (F.col("z") % down_z == 0)).select(*keys, F.floor(F.col("x") / down_x).cast("int").alias("x"), F.floor(F.col("z") / down_z).cast("int").alias("z"))


def patches(labels: DataFrame, nx: int | Column, nz: int | Column, patch: int, stride: int, keys: list[str], min_label_pixels: int = 1) -> DataFrame:
    """(keys, x0, z0, label_pixels): full patches on a stride grid that hold at least min_label_pixels label pixels.

    nx, nz: the sections' size, or columns of labels that tell it. A pixel is sent to the patches that hold it, by
    arithmetic on the grid; nothing is joined. A section smaller than a patch has none.
    """
    last_x, last_z = F.lit(nx) - patch, F.lit(nz) - patch

    def origins(c: str, last: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - patch + 1) / stride)).cast("int")
        high = F.least(F.floor(last / stride), F.floor(F.col(c) / stride)).cast("int")
        return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))

    large = labels.where((last_x >= 0) & (last_z >= 0))
    sent = large.select(*keys, F.explode(origins("x", last_x)).alias("x0"), origins("z", last_z).alias("__z0")).select(*keys, "x0", F.explode("__z0").alias("z0"))
    return sent.groupBy(*keys, "x0", "z0").agg(F.count("*").alias("label_pixels")).where(F.col("label_pixels") >= min_label_pixels)


def shuffle_and_cap(records: DataFrame, target: int, seed: int, key: str) -> DataFrame:
    """The first target records by a seeded hash of the key, with their rank."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    top = records.withColumn("__h", order).orderBy("__h", key).limit(target)
    return top.withColumn("nth", F.row_number().over(Window.orderBy("__h", key))).drop("__h")


def overlapping_pairs(train: DataFrame, val: DataFrame, patch: int, source: str = "source_id") -> DataFrame:
    """Train and val patches of one source whose half-open boxes overlap; touching is allowed. Patches meet on cells of their own size."""
    cx, cz = F.floor(F.col("x0") / patch), F.floor(F.col("z0") / patch)
    a = train.select(source, F.col("x0").alias("ax"), F.col("z0").alias("az"), F.explode(F.sequence(cx - 1, cx + 1)).alias("cx"), cz.alias("cz0"))
    a = a.select(source, "ax", "az", "cx", F.explode(F.sequence(F.col("cz0") - 1, F.col("cz0") + 1)).alias("cz"))
    b = val.select(source, F.col("x0").alias("bx"), F.col("z0").alias("bz"), cx.alias("cx"), cz.alias("cz"))
    met = a.join(b, [source, "cx", "cz"])
    return met.where((F.abs(F.col("ax") - F.col("bx")) < patch) & (F.abs(F.col("az") - F.col("bz")) < patch)).select(source, "ax", "az", "bx", "bz")


def grid_origins(spark, nx: int, nz: int, patch: int, stride: int) -> DataFrame:
    """(x0, z0) of all full patches of a section, counted off on the stride grid."""
    x = spark.range(0, max(0, (nx - patch) // stride + 1)).select((F.col("id") * stride).cast("int").alias("x0"))
    rows = max(0, (nz - patch) // stride + 1)
    return x.select("x0", F.explode(F.sequence(F.lit(0), F.lit(max(rows - 1, 0)))).alias("z0")).where(F.lit(rows > 0)).select("x0", (F.col("z0") * stride).alias("z0"))


def flip_x(values: Column, side: int) -> Column:
    """A square patch, an array in (x, z) order, with x reversed."""
    return F.flatten(F.transform(F.sequence(F.lit(side - 1), F.lit(0)), lambda x: F.slice(values, x * side + 1, side)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(w_pos, w_neg): the share of the other class, or (1, 1) if one class is empty."""
    counts = df.agg(F.count_if(F.col(label) > 0.5).alias("pos"), F.count_if(F.col(label) <= 0.5).alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    total = F.col("pos") + F.col("neg")
    return counts.select(F.when(both, F.col("neg") / total).otherwise(1.0).alias("w_pos"), F.when(both, F.col("pos") / total).otherwise(1.0).alias("w_neg"))


def stem_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right) of every key on either side, for exact pairing and its report of what is missing."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def source_id(inline: Column, section: Column, sha256: Column) -> Column:
    """A section's name by the checksum of its file: inline_<n>_section_<k>_<first 12 digits>."""
    return F.format_string("inline_%d_section_%d_%s", inline, section, F.substring(sha256, 1, 12))


def sample_id(source: Column, x0: Column, z0: Column, patch: int) -> Column:
    return F.format_string(f"%s_x%06d_z%06d_p{patch}", source, x0, z0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def losses(df: DataFrame, sample: str, logit: str, target: str, w_pos: float, w_neg: float, bce_share: float = 0.9, eps: float = 1e-7) -> DataFrame:
    """(wbce, dice, loss) over all pixels: class-weighted cross-entropy, mean soft Dice loss of the samples, and their mix."""
    z, t = F.col(logit), F.col(target)
    softplus = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    p = 1 / (1 + F.exp(-z))
    each = df.groupBy(sample).agg(F.sum(w_pos * t * softplus(-z) + w_neg * (1 - t) * softplus(z)).alias("ce"), F.count("*").alias("n"), F.sum(p * t).alias("both"), (F.sum(p) + F.sum(t)).alias("all"))
    dice = 1 - (2 * F.col("both") + eps) / (F.col("all") + eps)
    total = each.agg((F.sum("ce") / F.sum("n")).alias("wbce"), F.avg(dice).alias("dice"))
    return total.withColumn("loss", bce_share * F.col("wbce") + (1 - bce_share) * F.col("dice"))

