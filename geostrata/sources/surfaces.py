"""Surface files: the flat arrays of an .npz read into rows, catalogues written as Parquet, and the strides that a run used."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.operators import catalogue
from geostrata.sources import files, segy

VERTEX = "surface_id string, row int, col int, inline double, profile double, sample double, rmse double"
ROWS = 65_536


def read_flat_npz(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Vertices (surface_id, row, col, inline, profile, sample, rmse) of flat surface archives, one task a file.

    Offsets must span their arrays, shapes must fit them, vertices must be finite and faces be those of the grid;
    anything else is an error. Arrays of objects are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with segy.opened(path) as f:
                    held = np.load(io.BytesIO(f.read()), allow_pickle=False)
                    a = {k: held[k] for k in ("surface_ids", "vertices", "vertex_offsets", "faces", "face_offsets", "grid_shapes")}
                    rmse = held["observation_rmse"] if "observation_rmse" in held else np.full(len(a["surface_ids"]), np.nan)
                check_flat(a)
                for k, name in enumerate(a["surface_ids"].tolist()):
                    rows, columns = a["grid_shapes"][k].tolist()
                    v = a["vertices"][a["vertex_offsets"][k] : a["vertex_offsets"][k + 1]]
                    at = np.arange(rows * columns)
                    out = pd.DataFrame({"surface_id": name, "row": at // columns, "col": at % columns, "inline": v[:, 0], "profile": v[:, 1], "sample": v[:, 2], "rmse": float(rmse[k])})
                    for begin in range(0, len(out), ROWS):
                        yield out.iloc[begin : begin + ROWS]

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, VERTEX)


def grid_faces(rows: int, columns: int) -> np.ndarray:
    """Two triangles a cell, corners sorted, in order: for comparison as a set."""
    at = np.arange(rows * columns).reshape(rows, columns)
    upper = np.stack([at[:-1, :-1], at[1:, :-1], at[:-1, 1:]], 2).reshape(-1, 3)
    lower = np.stack([at[:-1, 1:], at[1:, :-1], at[1:, 1:]], 2).reshape(-1, 3)
    return in_order(np.concatenate([upper, lower]))


def in_order(faces: np.ndarray) -> np.ndarray:
    faces = np.sort(faces, axis=1)
    return faces[np.lexsort(faces.T[::-1])]


def check_flat(a: dict[str, np.ndarray]) -> None:
    n, v, f = len(a["surface_ids"]), a["vertex_offsets"], a["face_offsets"]
    rules = [
        (a["surface_ids"].ndim == 1 and a["surface_ids"].dtype.kind in "US", "surface_ids are not texts"),
        (a["vertices"].ndim == 2 and a["vertices"].shape[1] == 3 and np.isfinite(a["vertices"]).all(), "vertices are not finite triples"),
        (a["faces"].ndim == 2 and a["faces"].shape[1] == 3 and a["faces"].dtype.kind in "iu", "faces are not triples of numbers"),
        (a["grid_shapes"].shape == (n, 2) and v.shape == f.shape == (n + 1,), "offsets and shapes don't fit the surfaces"),
        (v[0] == f[0] == 0 and v[-1] == len(a["vertices"]) and f[-1] == len(a["faces"]) and (np.diff(v) >= 0).all() and (np.diff(f) >= 0).all(), "offsets don't span their arrays"),
    ]
    for good, why in rules:
        if not good:
            raise ValueError(why)
    for k, name in enumerate(a["surface_ids"].tolist()):
        rows, columns = a["grid_shapes"][k].tolist()
        if min(rows, columns) < 2 or rows * columns != v[k + 1] - v[k]:
            raise ValueError(f"the shape of {name} does not fit its vertices")
        if not np.array_equal(in_order(a["faces"][f[k] : f[k + 1]].astype(np.int64) - v[k]), grid_faces(rows, columns)):
            raise ValueError(f"the faces of {name} are not those of its grid")


def input_format(path: str) -> str:
    """flat-npz or parquet, by the suffix; anything else is an error."""
    if path.lower().endswith(".npz"):
        return "flat-npz"
    if path.lower().rstrip("/").endswith(".parquet"):
        return "parquet"
    raise ValueError(f"no format is known for {path}")


def run_metadata(spark: SparkSession, folder: str, wanted: bool = False) -> dict | None:
    """The run's metadata record in the folder, None if there is none unless it is wanted."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{folder}/run_metadata", wholetext=True).collect()  # one record
    except AnalysisException:
        if wanted:
            raise
        return None
    found = json.loads("\n".join(x["value"] for x in rows))
    if not isinstance(found, dict):
        raise ValueError("run metadata is not an object")
    return found


def metadata_strides(record: dict | None) -> tuple[int | None, int | None]:
    """The strides of crosslines and samples that a run's record names; None twice where it names no valid pair of places on thinned axes."""
    c = ((record or {}).get("input") or {}).get("coordinates") or {}
    pair = c.get("crossline_stride"), c.get("sample_stride")
    usable = c.get("coordinate_mode") == "downsampled_array_index" and all(type(s) is int and s >= 1 for s in pair)
    return pair if usable else (None, None)


def resolve_strides(record: dict | None, crossline: int | None = None, sample: int | None = None) -> tuple[int, int]:
    """The strides of crosslines and samples. The run's record and the caller must name one stride of each between them, no more."""
    out = []
    for axis, named in zip(("crosslines", "samples"), zip(metadata_strides(record), (crossline, sample), strict=True), strict=True):
        found = sorted(set(named) - {None})
        if len(found) != 1:
            raise ValueError(f"{axis} need one stride, not {found}")
        out += found
    return tuple(out)


def mapped(vertices: DataFrame, inlines: DataFrame, crosslines: DataFrame, samples: DataFrame) -> DataFrame:
    """vertices with inline_header, crossline_header and sample_coordinate: places on axes (idx, value), thinned out already, by linear interpolation."""
    out = vertices
    for place, axis, name in (("inline", inlines, "inline_header"), ("profile", crosslines, "crossline_header"), ("sample", samples, "sample_coordinate")):
        out = catalogue.index_to_value(out, axis, place, name)
    return out


def inventory_table(vertices: DataFrame, source_format: str, z_field: str = "sample", key: str = "surface_id") -> DataFrame:
    """One row per surface: shape, vertices, those with and without data, triangles, and the finite range of every value."""
    values = [c for c, kind in vertices.dtypes if kind in ("double", "float") and c != "rmse"]
    shapes = vertices.groupBy(key).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"))
    facts = catalogue.inventory(vertices, key, values)
    faces = catalogue.finite_faces(catalogue.structured_faces(shapes, [key]), vertices.join(shapes.select(key, "columns").hint("merge"), key).select(key, (F.col("row") * F.col("columns") + F.col("col")).alias("vertex"), F.col(z_field).alias("z")), [key])
    triangles = faces.groupBy(key).agg(F.count("*").alias("triangles"))
    out = shapes.join(facts, key).join(triangles, key, "left")
    return out.select(
        key, F.lit(source_format).alias("input_format"), F.lit(z_field).alias("z_field"), "rows", "columns", "vertices", (F.col("vertices") - F.col(f"{z_field}_missing")).alias("valid_vertices"),
        F.col(f"{z_field}_missing").alias("no_data_vertices"), F.coalesce("triangles", F.lit(0)).alias("triangles"), *[F.col(f"{v}_{end}") for v in values for end in ("min", "max")],
    )


def save_catalogue(vertices: DataFrame, folder: str, source_format: str, record: dict, z_field: str = "sample", slices: list[float] | None = None) -> None:
    """Writes vertices, inventory, the wanted inlines' intersections and a metadata record under a folder that must be new."""
    spark = vertices.sparkSession
    files.need_empty(spark, folder)
    problem = catalogue.grid_problems(vertices, vertices.groupBy("surface_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns")), ["inline", "profile"], [z_field]).first()
    if problem:
        raise ValueError(f"surface {problem['surface_id']}: {problem['problem']}")
    vertices.write.parquet(f"{folder}/vertices.parquet")
    saved = spark.read.parquet(f"{folder}/vertices.parquet")
    inventory_table(saved, source_format, z_field).write.option("header", True).csv(f"{folder}/inventory")
    if slices:
        catalogue.intersections(saved, slices, inline="inline", z=z_field).write.option("header", True).csv(f"{folder}/intersections")
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/run_metadata")
