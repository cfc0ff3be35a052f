"""Sections cut into overlapping tiles, scored by a given model, and blended: all sections at once, a task holding some tiles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from geostrata.config import TileConfig
from geostrata.sources import segy

KEY = "inline_number"


def scaled_traces(traces: DataFrame, values: str = "amplitudes", key: str = KEY) -> DataFrame:
    """(key, x, values, nx, nz): each section scaled to [0, 1]. A section that is not finite, of one value, or of traces of several lengths is an error."""
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    facts = traces.groupBy(key).agg(
        (F.max("xl_pos") + 1).alias("nx"), F.min(F.size(values)).alias("nz"), F.max(F.size(values)).alias("__most"),
        F.min(F.array_min(values)).alias("__low"), F.max(F.array_max(values)).alias("__high"), F.bool_and(finite).alias("__finite"),
    )
    good = F.col("__finite") & (F.col("__high") > F.col("__low")) & (F.col("nz") == F.col("__most"))
    checked = facts.withColumn("__low", F.when(good, F.col("__low")).otherwise(F.raise_error(F.concat(F.lit("not a finite section of several values: "), F.col(key).cast("string"))).cast("double")))
    met = traces.join(checked, key)
    unit = F.transform(values, lambda v: ((v - F.col("__low")) / (F.col("__high") - F.col("__low"))).cast("float"))
    return met.select(key, F.col("xl_pos").alias("x"), unit.alias("values"), "nx", "nz")


def tile_count(n: Column, patch: int, overlap: int) -> Column:
    """Tiles along an axis of n pixels, half to even; those that would hold padding alone are not counted."""
    step = patch - overlap
    return F.least(F.greatest(F.lit(1), F.rint((n + overlap) / step + 0.5).cast("int")), F.ceil(n / step).cast("int"))


def cut_tiles(scaled: DataFrame, config: TileConfig = TileConfig(), key: str = KEY) -> DataFrame:
    """(key, tx, tz, nx, nz, values): tiles in C order, zeros beyond the section. A trace is cut to the tiles that hold it, so a tile gathers its own pixels and no more."""
    (px, pz), overlap = config.patch, config.overlap
    sx, sz = px - overlap, pz - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - px + 1) / sx)).cast("int")
    last = F.least(tile_count(F.col("nx"), px, overlap) - 1, F.floor(F.col("x") / sx).cast("int"))
    rows = scaled.withColumn("tx", F.explode(F.transform(F.sequence(first, last), lambda i: i * sx)))
    rows = rows.withColumn("tz", F.explode(F.transform(F.sequence(F.lit(0), tile_count(F.col("nz"), pz, overlap) - 1), lambda j: j * sz)))
    part = F.slice("values", F.col("tz") + 1, pz)
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    rows = rows.select(key, "tx", "tz", "nx", "nz", "x", F.concat(part, zeros(F.lit(pz) - F.size(part))).alias("part"))
    held = rows.groupBy(key, "tx", "tz", "nx", "nz").agg(F.array_sort(F.collect_list(F.struct("x", "part"))).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: r["part"]))
    return held.select(key, "tx", "tz", "nx", "nz", F.concat(flat, zeros((F.lit(px) - F.size("rows")) * pz)).alias("values"))


Scorer = Callable[[np.ndarray], np.ndarray]


def _probabilities(x: np.ndarray, scorer: Scorer, shape: tuple[int, int], name: Callable[[int], str]) -> np.ndarray:
    """Scores of tiles (n, px * pz), each brought to mean 0 and deviation 1; name tells tile k in an error."""
    x = x.astype(np.float64)
    spread = x.std(1)
    if not (spread > 0).all():
        raise ValueError(f"a tile of one value{name(int(np.argmin(spread > 0)))}")
    p = np.asarray(scorer(((x - x.mean(1)[:, None]) / spread[:, None]).astype(np.float32).reshape(-1, *shape)))
    if p.shape != (len(x), *shape) or not np.isfinite(p).all() or p.min() < 0 or p.max() > 1:
        raise ValueError("the scorer gave no probabilities")
    return p.astype(np.float32).reshape(len(x), -1)


def score_tiles(tiles: DataFrame, scorer: Scorer, config: TileConfig = TileConfig(), key: str = KEY, batch: int = 16) -> DataFrame:
    """(key, tx, tz, nx, nz, p): scorer maps tiles (n, px, pz), each of mean 0 and deviation 1, to probabilities of the same shape. What the scorer holds is sent with each task; a model in a file is better given as a ModelFile.

    A tile of one value, and scores that are not finite or outside [0, 1], are errors.
    """
    shape = config.patch

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                told = lambda k, some=some: f": section {some[key].iloc[k]}, tile {some['tx'].iloc[k]}, {some['tz'].iloc[k]}"
                p = _probabilities(np.stack(list(some["values"])), scorer, shape, told)
                yield some[[key, "tx", "tz", "nx", "nz"]].assign(p=list(p))

    return tiles.mapInPandas(run, f"{key} int, tx int, tz int, nx int, nz int, p array<float>")


@dataclass(frozen=True)
class ModelFile:
    """A model in a file that all workers can read: its path, the SHA-256 that it must have, and what makes a scorer of its bytes."""

    path: str
    sha256: str
    load: Callable[[bytes], Scorer]

    def scorer(self) -> Scorer:
        """Reads and checks the file; another checksum is an error."""
        with segy.opened(self.path) as f:
            body = f.read()
        found = hashlib.sha256(body).hexdigest()
        if found != self.sha256.lower():
            raise ValueError(f"the model {self.path} has SHA-256 {found}, not {self.sha256}")
        return self.load(body)


def score_with_model(tiles: DataFrame, model: ModelFile, config: TileConfig = TileConfig(), key: str = KEY, batch: int = 16) -> DataFrame:
    """score_tiles by a model that each Python worker reads, checks and loads once, for all its tasks; only the path and the checksum are sent."""
    shape = config.patch

    def predictor() -> Scorer:
        scorer = model.scorer()
        return lambda values: _probabilities(values.reshape(len(values), -1), scorer, shape, lambda k: "")

    score = predict_batch_udf(predictor, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[list(shape)])
    return tiles.select(key, "tx", "tz", "nx", "nz", score("values").alias("p"))


def edge_weights(patch: tuple[int, int], overlap: int) -> np.ndarray:
    """Blending weights of a tile's pixels: exp(-(i - overlap + 1)^2 / (2 (overlap / 4)^2)) at i pixels from an edge within the overlap, 1 inside; columns' edges go before rows'."""

    def inward(n: int) -> np.ndarray:
        near, far = np.minimum(np.arange(n), np.arange(n)[::-1]), np.maximum(np.arange(n), np.arange(n)[::-1])
        return np.where(far < overlap, far, near)

    def taper(i: np.ndarray) -> np.ndarray:
        return np.where(i < overlap, np.exp(-((i - overlap + 1.0) ** 2) * 0.5 / (overlap / 4.0) ** 2), 1.0)

    r, c = (inward(n) for n in patch)
    return np.where(c[None, :] < overlap, taper(c)[None, :], taper(r)[:, None])


def blend_tiles(scored: DataFrame, config: TileConfig = TileConfig(), key: str = KEY) -> DataFrame:
    """(key, x, z, p): at each pixel of a section the weighted mean of its tiles' scores.

    Tiles are cut along the grid of their strides, and the pieces, still arrays, meet by cell: a tile's own cell, and
    strips as wide as the overlap for the cells after it. Only what a cell gives is laid out in pixels.
    """
    (px, pz), overlap = config.patch, config.overlap
    sx, sz = px - overlap, pz - overlap
    weights = edge_weights(config.patch, overlap)
    cuts = [(i, j) for i in range(-(-px // sx)) for j in range(-(-pz // sz))]
    part = lambda a, i, j: a[i * sx : (i + 1) * sx, j * sz : (j + 1) * sz]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                p = np.asarray(row.p, np.float32).reshape(px, pz)
                held = [(row.tx // sx + i, row.tz // sz + j, i, j) for i, j in cuts if row.tx + i * sx < row.nx and row.tz + j * sz < row.nz]
                pieces = pd.DataFrame(held, columns=["cx", "cz", "i", "j"]).assign(nx=row.nx, nz=row.nz, p=[part(p, i, j).ravel() for _, _, i, j in held])
                pieces.insert(0, key, getattr(row, key))
                yield pieces

    def meet(group: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        total, weight = np.zeros((sx, sz)), np.zeros((sx, sz))
        for row in pieces.sort_values(["i", "j"]).itertuples(index=False):
            w = part(weights, row.i, row.j)
            total[: w.shape[0], : w.shape[1]] += w * np.asarray(row.p, np.float64).reshape(w.shape)
            weight[: w.shape[0], : w.shape[1]] += w
        x0, z0 = int(group[1]) * sx, int(group[2]) * sz
        rows, columns = min(sx, int(pieces["nx"].iloc[0]) - x0), min(sz, int(pieces["nz"].iloc[0]) - z0)
        x, z = np.divmod(np.arange(rows * columns), columns)
        covered = weight[x, z] > 0
        x, z = x[covered], z[covered]
        return pd.DataFrame({key: group[0], "x": x + x0, "z": z + z0, "p": total[x, z] / weight[x, z]})

    kind = scored.schema[key].dataType.simpleString()
    pieces = scored.mapInPandas(cut, f"{key} {kind}, cx int, cz int, i int, j int, nx int, nz int, p array<float>")
    return pieces.groupBy(key, "cx", "cz").applyInPandas(meet, f"{key} {kind}, x int, z int, p double")


def probability_map(traces: DataFrame, scorer: Scorer | ModelFile, config: TileConfig = TileConfig(), key: str = KEY) -> DataFrame:
    """(key, x, z, p) of all sections. traces: (key, xl_pos, amplitudes)."""
    score = score_with_model if isinstance(scorer, ModelFile) else score_tiles
    return blend_tiles(score(cut_tiles(scaled_traces(traces, key=key), config, key), scorer, config, key), config, key)
