"""Stencils on sections of pixels, block by block: pixels are dealt to square blocks with a border of their neighbours', once, and each block is one array.

A block is bounded by its side, whatever the size of a section, and one shuffle takes the place of a join for each
neighbour that a stencil reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.storage import cut_lineage

SIDE = 256


def dealt(points: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """points with bx, bz: once for each block that holds them or has them within `halo` pixels of its edge."""

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))

    return points.withColumn("bx", reach("x")).withColumn("bz", reach("z"))


def _mask(x: np.ndarray, z: np.ndarray, bx: int, bz: int, halo: int, side: int) -> np.ndarray:
    """A block and its border, true at the points."""
    out = np.zeros((side + 2 * halo,) * 2, bool)
    out[x - bx * side + halo, z - bz * side + halo] = True
    return out


def _spread(mask: np.ndarray, offsets: list[tuple[int, int]], halo: int, side: int) -> np.ndarray:
    """The block, without border, true where an offset leads from a point."""
    out = np.zeros((side, side), bool)
    for i, j in offsets:
        out |= mask[halo - i : halo - i + side, halo - j : halo - j + side]
    return out


def dilate(points: DataFrame, offsets: list[tuple[int, int]], keys: list[str], side: int = SIDE) -> DataFrame:
    """(keys, x, z): distinct points at the given offsets from points."""
    halo = max(abs(v) for o in offsets for v in o)

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bx, bz = int(group[-2]), int(group[-1])
        x, z = np.nonzero(_spread(_mask(part["x"].to_numpy(), part["z"].to_numpy(), bx, bz, halo, side), offsets, halo, side))
        return pd.DataFrame({**{k: [v] * len(x) for k, v in zip(keys, group[:-2], strict=True)}, "x": x + bx * side, "z": z + bz * side})

    rows = points.select(*keys, "x", "z")
    return dealt(rows, halo, side).groupBy(*keys, "bx", "bz").applyInPandas(run, rows.schema)


def within(points: DataFrame, core: DataFrame, offsets: list[tuple[int, int]], keys: list[str], side: int = SIDE) -> DataFrame:
    """(keys, x, z, near): whether an offset leads from a core point to each point. Both sides share one exchange, the core alone with a border."""
    halo = max(abs(v) for o in offsets for v in o)
    rows = points.select(*keys, F.col("x").cast("int").alias("x"), F.col("z").cast("int").alias("z"))
    both = dealt(rows, 0, side).withColumn("core", F.lit(False)).unionByName(dealt(core.select(*keys, F.col("x").cast("int").alias("x"), F.col("z").cast("int").alias("z")), halo, side).withColumn("core", F.lit(True)))

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bx, bz, is_core = int(group[-2]), int(group[-1]), part["core"].to_numpy()
        own = part[~is_core]
        mask = _mask(part["x"].to_numpy()[is_core], part["z"].to_numpy()[is_core], bx, bz, halo, side)
        near = _spread(mask, offsets, halo, side) if is_core.any() and len(own) else np.zeros((side, side), bool)
        return own[[*keys, "x", "z"]].assign(near=near[own["x"].to_numpy() - bx * side, own["z"].to_numpy() - bz * side])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return both.groupBy(*keys, "bx", "bz").applyInPandas(run, f"{types}, near boolean")


def _gradient(p: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the edges; 0 along an axis of one pixel."""
    return np.gradient(p, axis=axis) if p.shape[axis] > 1 else np.zeros_like(p)


def _bilinear(p: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    fx, fz = np.floor(x).astype(int), np.floor(z).astype(int)
    ax, az = x - fx, z - fz
    gx, gz = np.minimum(fx + 1, p.shape[0] - 1), np.minimum(fz + 1, p.shape[1] - 1)
    return (1 - ax) * (1 - az) * p[fx, fz] + ax * (1 - az) * p[gx, fz] + (1 - ax) * az * p[fx, gz] + ax * az * p[gx, gz]


def gradient_blocks(pixels: DataFrame, halo: int, key: str, side: int = SIDE) -> DataFrame:
    """(key, bx, bz, left, top, width, values, most): each block of a section's bounding box with its border, cut off at the box, as one array of doubles from (left, top), absent pixels 0; and the largest gradient of its own pixels.

    Blocks without a pixel are there too: each block of a box has a row of its own in the exchange.
    """
    box = pixels.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    along = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
    marks = box.withColumn("bx", along("x0", "x1")).withColumn("bz", along("z0", "z1"))
    rows = dealt(pixels.select(key, F.col("x").cast("int").alias("x"), F.col("z").cast("int").alias("z"), F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("p")), halo, side)
    both = rows.unionByName(marks, allowMissingColumns=True)

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, is_mark = [int(v) * side for v in group[1:]], part["x"].isna().to_numpy()
        if not is_mark.any():  # pixels near a block that is beyond the box
            return pd.DataFrame(columns=[key, "bx", "bz", "left", "top", "width", "values", "most"], dtype=object)
        x0, x1, z0, z1 = (int(part[c].to_numpy()[is_mark][0]) for c in ("x0", "x1", "z0", "z1"))
        left, right = max(x0, at[0] - halo), min(x1, at[0] + side - 1 + halo)
        top, bottom = max(z0, at[1] - halo), min(z1, at[1] + side - 1 + halo)
        p = np.zeros((right - left + 1, bottom - top + 1))
        cells = part[~is_mark]
        p[cells["x"].to_numpy(int) - left, cells["z"].to_numpy(int) - top] = cells["p"].to_numpy()
        size = np.hypot(_gradient(p, 0), _gradient(p, 1))[max(at[0] - left, 0) : at[0] + side - left, max(at[1] - top, 0) : at[1] + side - top]
        return pd.DataFrame({key: [group[0]], "bx": [group[1]], "bz": [group[2]], "left": [left], "top": [top], "width": [p.shape[1]], "values": [p.ravel()], "most": [size.max()]})

    kind = pixels.schema[key].dataType.simpleString()
    return both.groupBy(key, "bx", "bz").applyInPandas(run, f"{key} {kind}, bx long, bz long, left int, top int, width int, values array<double>, most double")


def ridge_core(pixels: DataFrame, gradient_ratio: float, step: float, key: str, side: int = SIDE) -> DataFrame:
    """(key, x, z): pixels at least as high as both points a step along the gradient, where it is at least a share of the section's largest.

    The points are read by bilinear interpolation with the edge repeated; "at least as high" allows for 1e-12, the
    rounding of the interpolation on a plateau. Blocks are kept once, as the largest gradient of all must be known.
    """
    blocks = cut_lineage(gradient_blocks(pixels, int(np.ceil(step)) + 1, key, side))
    most = blocks.groupBy(key).agg(F.max("most").alias("all"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                p = np.asarray(row.values).reshape(-1, row.width)
                gx, gz = _gradient(p, 0), _gradient(p, 1)
                size = np.hypot(gx, gz)
                steep = size >= gradient_ratio * row.all
                own = np.zeros_like(steep)
                at = row.bx * side - row.left, row.bz * side - row.top
                own[max(at[0], 0) : at[0] + side, max(at[1], 0) : at[1] + side] = True
                x, z = np.nonzero(steep & own)
                norm = size[x, z] + 1.1920929e-07
                nx, nz = step * gx[x, z] / norm, step * gz[x, z] / norm
                ends = [s - 1 for s in p.shape]
                sides = [_bilinear(p, np.clip(x + t * nx, 0, ends[0]), np.clip(z + t * nz, 0, ends[1])) for t in (1, -1)]
                top = np.maximum(*sides) <= p[x, z] + 1e-12
                yield pd.DataFrame({key: getattr(row, key), "x": x[top] + row.left, "z": z[top] + row.top})

    kind = pixels.schema[key].dataType.simpleString()
    return blocks.drop("most").join(most.where(F.col("all") > 0), key).mapInPandas(run, f"{key} {kind}, x int, z int")
