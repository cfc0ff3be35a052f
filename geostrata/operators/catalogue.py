"""Surface catalogue: axes, lookups on axes, mesh faces, intersections, inventories, thinning, checks of grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators import asof


def axis_steps(axis: DataFrame, keys: list[str], idx: str = "idx", value: str = "value", tolerance: float = 1e-9) -> DataFrame:
    """(keys, n, first, last, regular, step, increasing) of each axis: step is null unless all steps are equal."""
    w = Window.partitionBy(*keys).orderBy(idx)
    d = axis.withColumn("__d", F.col(value) - F.lag(value).over(w))
    rows = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(value, idx).alias("first"), F.max_by(value, idx).alias("last"), F.min("__d").alias("low"), F.max("__d").alias("high"))
    regular = F.coalesce(F.col("high") - F.col("low") <= tolerance, F.lit(False))
    return rows.select(*keys, "n", "first", "last", regular.alias("regular"), F.when(regular, F.col("low")).alias("step"), F.coalesce(F.col("low") > 0, F.lit(True)).alias("increasing"))


def index_to_value(rows: DataFrame, axis: DataFrame, index: str, name: str, idx: str = "idx", value: str = "value") -> DataFrame:
    """rows with the axis value at a fractional index, linear between neighbours; NaN stays NaN, beyond the axis is null. Entries meet the next, and rows theirs, by equi-joins on whole indices."""
    here = axis.select(F.col(idx).cast("long").alias("__i"), F.col(value).alias("__a"))
    low = here.join(axis.select((F.col(idx).cast("long") - 1).alias("__i"), F.col(value).alias("__b")), "__i", "left")
    out = rows.withColumn("__i", F.when(~F.isnan(F.col(index).cast("double")), F.floor(index))).join(low, "__i", "left")
    share = F.col(index) - F.col("__i")
    lerp = F.when(share == 0, F.col("__a")).otherwise(F.col("__a") + share * (F.col("__b") - F.col("__a")))
    return out.withColumn(name, F.when(F.isnan(F.col(index).cast("double")), F.lit(float("nan"))).otherwise(lerp)).drop("__i", "__a", "__b")


def value_to_index(rows: DataFrame, axis: DataFrame, value: str, name: str, keys: list[str], idx: str = "idx", axis_value: str = "value") -> DataFrame:
    """rows with the fractional index of a value on an increasing axis, linear between the entries before and after it; rows beyond its ends, null and NaN are left out."""
    met = asof.neighbours(rows, axis, keys, value, axis_value, [idx])
    a, b, i, j = F.col("before.at"), F.col("after.at"), F.col(f"before.`{idx}`"), F.col(f"after.`{idx}`")
    v = F.col(value).cast("double")
    inside = met.where(F.col("before").isNotNull() & (F.col("after").isNotNull() | (v == a)))
    return inside.withColumn(name, F.when(v == a, i.cast("double")).otherwise(i + (v - a) / (b - a) * (j - i))).drop("before", "after")


def structured_faces(grids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, c): two triangles per cell of each (rows, columns) grid, vertices numbered row by row."""
    cells = grids.select(*keys, "columns", F.explode(F.sequence(F.lit(0), F.col("rows") - 2)).alias("r"), (F.col("columns") - 2).alias("__l")).where("__l >= 0").select(*keys, "columns", "r", F.explode(F.sequence(F.lit(0), F.col("__l"))).alias("q"))
    at = F.col("r") * F.col("columns") + F.col("q")
    down = at + F.col("columns")
    both = F.explode(F.array(F.struct(at.alias("a"), down.alias("b"), (at + 1).alias("c")), F.struct((at + 1).alias("a"), down.alias("b"), (down + 1).alias("c"))))
    return cells.select(*keys, both.alias("t")).select(*keys, "t.a", "t.b", "t.c")


def finite_faces(faces: DataFrame, vertices: DataFrame, keys: list[str], vertex: str = "vertex", z: str = "z") -> DataFrame:
    """Faces all of whose vertices have a finite z: each face meets its three corners by an equi-join, sorted on both sides, as vertices made from shapes look few enough to be broadcast and are not."""
    corner = faces.withColumn("__v", F.explode(F.array("a", "b", "c")))
    good = vertices.where(is_finite(F.col(z))).select(*keys, F.col(vertex).alias("__v"))
    return corner.join(good.hint("merge"), [*keys, "__v"]).groupBy(*keys, "a", "b", "c").agg(F.count("*").alias("n")).where("n = 3").drop("n")


def is_finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    x = value.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def inventory(vertices: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row per surface: vertices, those without data (null, NaN or infinite), and the range of each value's finite ones, null without any."""
    aggregates = [F.count("*").alias("vertices")]
    for v in values:
        x = F.col(v).cast("double")
        good = F.when(is_finite(x), x)
        aggregates += [(F.count("*") - F.count(good)).alias(f"{v}_missing"), F.min(good).alias(f"{v}_min"), F.max(good).alias(f"{v}_max")]
    return vertices.groupBy(key).agg(*aggregates)


def intersections(vertices: DataFrame, slices: list[float], tolerance: float = 1e-6, key: str = "surface_id", inline: str = "inline_index", profile: str = "profile", z: str = "z") -> DataFrame:
    """Rows of surfaces on the given inlines with point_order by profile, counted before rows without data (null, NaN or infinite) are left out."""
    at = F.explode(F.array(*[F.lit(float(s)) for s in slices]))
    rows = vertices.withColumn("slice", at).where(F.abs(F.col(inline) - F.col("slice")) <= tolerance)
    w = Window.partitionBy(key, "slice").orderBy(profile, z)
    return rows.withColumn("point_order", F.row_number().over(w) - 1).where(is_finite(F.col(z)))


def kept_positions(position: Column, last: Column, stride: int) -> Column:
    """Whether a position stays when an axis is thinned: every stride-th and the last; all of them for a stride of 1 or up to two positions."""
    return F.lit(stride <= 1) | (position % stride == 0) | (position == last) | (last <= 1)


def subsample(df: DataFrame, position: str, last: Column, stride: int) -> DataFrame:
    """The rows of df whose position stays."""
    return df.where(kept_positions(F.col(position), last, stride))


def plot_stride(vertices: int, most: int) -> int:
    """One stride for all meshes, so that about `most` of their vertices are shown."""
    if most < 100:
        raise ValueError("at least 100 vertices are to be shown")
    return 1 if vertices <= most else max(2, math.ceil(math.sqrt(vertices / most)))


def decimate(vertices: DataFrame, shapes: DataFrame, stride: int, key: str = "surface_id") -> DataFrame:
    """Vertices (key, row, col, ...) thinned along both axes, edges kept. shapes: (key, rows, columns)."""
    met = vertices.join(shapes.select(key, "rows", "columns").hint("merge"), key)
    return subsample(subsample(met, "row", F.col("rows") - 1, stride), "col", F.col("columns") - 1, stride).drop("rows", "columns")


def boundary(vertices: DataFrame, shapes: DataFrame, key: str = "surface_id") -> DataFrame:
    """Vertices on the outer boundary of each grid with boundary_order, from 0: the first row, the last column, the last row backwards, the first column upwards; no corner twice."""
    met = vertices.join(shapes.select(key, "rows", "columns").hint("merge"), key)
    r, c, last_r, last_c = F.col("row"), F.col("col"), F.col("rows") - 1, F.col("columns") - 1
    order = F.when(r == 0, c).when(c == last_c, last_c + r).when(r == last_r, last_c + last_r + (last_c - c)).when(c == 0, 2 * last_c + last_r + (last_r - r))
    return met.withColumn("boundary_order", order.cast("int")).where(F.col("boundary_order").isNotNull()).drop("rows", "columns")


def header_to_index(axis: DataFrame, header: int, idx: str = "idx", value: str = "value") -> int:
    """The place of a header on an axis; an error unless it occurs once."""
    found = axis.where(F.col(value) == header).select(idx).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{header} is not on the axis exactly once")
    return found[0][0]


def face_counts(shapes: DataFrame, key: str = "surface_id") -> DataFrame:
    """(key, faces): two triangles a cell."""
    return shapes.select(key, (2 * F.greatest(F.lit(0), F.col("rows") - 1) * F.greatest(F.lit(0), F.col("columns") - 1)).alias("faces"))


def grid_problems(vertices: DataFrame, shapes: DataFrame, exact: list[str], sparse: list[str], key: str = "surface_id") -> DataFrame:
    """(key, problem): grids smaller than 2 x 2 or with missing vertices, values of `exact` that are not finite, and of `sparse`, where NaN means no data, that are infinite or never finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    facts = vertices.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(bad(c)).alias(f"bad_{c}") for c in exact + sparse], *[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"infinite_{c}") for c in sparse])
    met = shapes.select(key, "rows", "columns").join(facts, key, "full_outer")
    rules = [(F.least("rows", "columns") < 2, "smaller than 2 x 2"), (~F.coalesce(F.col("n") == F.col("rows") * F.col("columns"), F.lit(False)), "not as many vertices as its shape has")]
    rules += [(F.col(f"bad_{c}") > 0, f"{c} is not finite") for c in exact]
    rules += [(F.col(f"infinite_{c}") > 0, f"{c} is infinite") for c in sparse] + [(F.col(f"bad_{c}") == F.col("n"), f"{c} has no finite value") for c in sparse]
    return met.select(key, F.explode(F.array_compact(F.array(*[F.when(rule, what) for rule, what in rules]))).alias("problem"))


def same_faces(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Faces that one side has more often than the other, corners in any order; empty if the sets are equal."""
    norm = lambda df: df.select(*keys, F.array_sort(F.array("a", "b", "c")).alias("face"))
    return norm(a).exceptAll(norm(b)).unionAll(norm(b).exceptAll(norm(a)))
