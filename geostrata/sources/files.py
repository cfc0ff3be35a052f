"""Patch files, picks, line configurations, checksums and manifests."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.config import LabelConfig, LineConfig
from geostrata.operators import labels
from geostrata.sources import segy

#: The fields of a line configuration.
LINE_CONFIG = (
    "inline_id int, segy_path string, csv_path string, split string, section_index int, x_col int, z_col int, fault_id_col int, "
    "x_offset double, z_offset double, x_scale double, z_scale double, label_shape_before_downsample array<int>, downsample_x int, downsample_z int"
)
# The columns of a patch manifest, in order.
MANIFEST = [
    "sample_id", "split", "source_id", "inline_id", "section_index", "x0", "z0", "x1", "z1", "patch_size", "label_pixels", "array_axis_order",
    "source_segy", "source_csv", "source_segy_sha256", "source_csv_sha256", "seismic_file", "label_file", "metadata_file",
    "seismic_sha256", "label_sha256", "metadata_sha256", "seismic_dat_file", "label_dat_file", "seismic_dat_sha256", "label_dat_sha256",
]


def plain_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def store(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_line_configs(spark: SparkSession, path: str) -> DataFrame:
    """Line configurations of a JSON object or list, with split in lower case; absent fields are null."""
    return spark.read.schema(LINE_CONFIG).option("multiLine", True).json(path).withColumn("split", F.lower("split"))


def load_lines(spark: SparkSession, path: str) -> list[LineConfig]:
    """The lines of a JSON object or non-empty list, with defaults filled in; unknown and missing fields are errors. A run has few lines."""
    raw = json.loads("\n".join(x["value"] for x in spark.read.text(path, wholetext=True).collect()))
    items = [raw] if isinstance(raw, dict) else raw
    if not isinstance(items, list) or not items or not all(isinstance(x, dict) for x in items):
        raise ValueError("line inputs are one object or a list of objects that is not empty")
    return [LineConfig.of(x) for x in items]


def check_lines(lines: list[LineConfig], config: LabelConfig = LabelConfig()) -> None:
    """Raises where whole-line assignments can't hold: wanted inlines, declared splits."""
    known, wanted, given = {x.inline_id for x in lines}, set(config.val_inlines), [x.split for x in lines if x.split is not None]
    sides = {side: {x.inline_id for x in lines if x.split == side} for side in ("train", "val")}
    rules = [
        (not lines, "there is no line"),
        (bool(wanted - known), f"val_inlines names unknown inlines {sorted(wanted - known)}"),
        (bool(wanted) and wanted == known, "val_inlines must leave an inline to train on"),
        (bool(set(given) - {"train", "val"}), "a declared split is neither train nor val"),
        (0 < len(given) < len(lines), "splits are declared for some lines only"),
        (bool(given) and set(given) != {"train", "val"}, "one declared side has no line"),
        (bool(given) and (config.strategy != "inline" or bool(wanted)), "declared splits go with the inline strategy alone, without val_inlines"),
        (bool(sides["train"] & sides["val"]), f"inlines {sorted(sides['train'] & sides['val'])} are on both sides"),
    ]
    for bad, why in rules:
        if bad:
            raise ValueError(why)


def split_problems(configs: DataFrame) -> DataFrame:
    """(problem) rows: splits given for some lines only, one side missing, or an inline on both sides. Empty if all is well."""
    totals = configs.agg(F.count("*").alias("n"), F.count("split").alias("given"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    partial = totals.where("given > 0 and given < n").select(F.lit("split is given for some lines only").alias("problem"))
    missing = totals.where("given = n and n > 0 and (train = 0 or val = 0)").select(F.lit("one side of the split has no line").alias("problem"))
    both = configs.where("split is not null").groupBy("inline_id").agg(F.countDistinct("split").alias("k")).where("k > 1").select(F.format_string("inline %d is on both sides", "inline_id").alias("problem"))
    return partial.union(missing).union(both)


def read_picks(spark: SparkSession, line: LineConfig) -> DataFrame:
    """(x_idx, z_idx) and fault_id, if the line has such a column: picks of a CSV with a header, columns by position. Rows without all of these are left out."""
    raw = spark.read.option("header", True).csv(line.csv_path)
    need = max(line.x_col, line.z_col, -1 if line.fault_id_col is None else line.fault_id_col)
    if len(raw.columns) <= need:
        raise ValueError(f"the picks have {len(raw.columns)} columns, not {need + 1}")
    places = {"px": line.x_col, "pz": line.z_col} | ({} if line.fault_id_col is None else {"fault_id": line.fault_id_col})
    named = raw.toDF(*[f"c{k}" for k in range(len(raw.columns))]).select(*[F.col(f"c{k}").alias(name) for name, k in places.items()])
    out = labels.picks_to_indices(named, "px", "pz", line.x_offset, line.x_scale, line.z_offset, line.z_scale)
    return out.drop("px", "pz") if line.fault_id_col is None else out.where("fault_id is not null").drop("px", "pz")


def read_section(spark: SparkSession, line: LineConfig) -> DataFrame:
    """(x, amplitudes) of the line's section, thinned out."""
    spark.dataSource.register(segy.SegyDataSource)
    rows = spark.read.format("segy").option("path", line.segy_path).option("section", line.section_index).option("xlineStride", line.downsample_x).option("sampleStride", line.downsample_z)
    return rows.load().select(F.col("xl_pos").alias("x"), "amplitudes")


def read_sections(spark: SparkSession, lines: list[LineConfig], numbers: list[int]) -> DataFrame:
    """(line, x, amplitudes) of several sections of one cube, thinned out alike, by one scan; numbers name the lines. A section that the file lacks is an error."""
    spark.dataSource.register(segy.SegyDataSource)
    first, inlines = lines[0], segy.geometry(lines[0].segy_path)["inlines"]
    wanted = [(inlines[line.section_index], k) for line, k in zip(lines, numbers, strict=True) if 0 <= line.section_index < len(inlines)]
    if len(wanted) < len(lines):
        raise ValueError(f"{first.segy_path} has {len(inlines)} sections, and lines name others")
    rows = spark.read.format("segy").option("path", first.segy_path).option("xlineStride", first.downsample_x).option("sampleStride", first.downsample_z).load()
    named = spark.createDataFrame(wanted, "inline_number int, line int")  # one row a line
    return rows.join(F.broadcast(named), "inline_number").select("line", F.col("xl_pos").alias("x"), "amplitudes")


def read_patches(spark: SparkSession, path: str, side: int, dtype: str = "<f4") -> DataFrame:
    """(stem, values) of square patches in C order: .npy files, or headerless ones; a file of another size is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("path").endswith(".npy").alias("npy"), "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            held = [np.load(io.BytesIO(b), allow_pickle=False) if npy else np.frombuffer(b, np.uint8) for npy, b in zip(x["npy"], x["content"], strict=True)]
            for stem, npy, v in zip(x["stem"], x["npy"], held, strict=True):
                if (v.shape != (side, side)) if npy else (v.nbytes != side * side * np.dtype(dtype).itemsize):
                    raise ValueError(f"a patch has another length: {stem}")
            yield pd.DataFrame({"stem": x["stem"], "values": [(v if npy else v.view(dtype)).astype(np.float32).ravel() for npy, v in zip(x["npy"], held, strict=True)]})

    return files.mapInPandas(decode, "stem string, values array<float>")


def checksums(spark: SparkSession, paths: list[str], hashed: bool = True) -> DataFrame:
    """(path, size, sha256) of files, each read in pieces by one task; sha256 is null unless hashed. No file is held whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for path in x["path"]:
                with segy.opened(path) as f:
                    size, digest = f.size(), hashlib.sha256()
                    while hashed and (part := f.read(1 << 20)):
                        digest.update(part)
                rows.append((plain_path(path), size, digest.hexdigest() if hashed else None))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInPandas(run, "path string, size long, sha256 string")


def check_axis_order(spark: SparkSession, folder: str) -> None:
    """Raises where a synthetic dataset's config.json does not declare the axes (x, z): older ones were stored as (z, x). Other folders pass."""
    from pyarrow import fs

    place, at = store(folder)
    if place.get_file_info(f"{at}/config.json").type != fs.FileType.File:
        return
    found = json.loads("\n".join(x["value"] for x in spark.read.text(f"{folder}/config.json", wholetext=True).collect()))
    if isinstance(found, dict) and {"height", "width", "num_train", "num_val"} <= set(found) and found.get("array_axis_order") != ["x", "z"]:
        raise ValueError(f"{folder} declares the axes {found.get('array_axis_order')}, not x, z")


def need_empty(spark: SparkSession, folder: str, allowed: tuple[str, ...] = (".gitignore",)) -> None:
    """An error unless a run may write to folder: it does not exist, or holds no more than the allowed files."""
    from pyarrow import fs

    place, at = store(folder)
    kind = place.get_file_info(at).type
    if kind == fs.FileType.File:
        raise ValueError(f"a run needs a folder, and {folder} is a file")
    held = place.get_file_info(fs.FileSelector(at)) if kind == fs.FileType.Directory else []
    count = len([x for x in held if x.type != fs.FileType.File or x.base_name not in allowed])
    if count:
        raise ValueError(f"{folder} is not empty: {count} entries are none of this run")


def write_patches(rows: DataFrame, folder: str, side: int, npy: bool = True, dat: bool = False) -> DataFrame:
    """Writes each row's image and label as .npy or headerless files with a JSON record, and gives the manifest rows.

    rows: (sample_id, split, nth, image, label, ...), nth from 1 within a split. Files are named by split and nth,
    so a task that runs again writes the same files.
    """
    if not npy and not dat:
        raise ValueError("patches are written as .npy, .dat or both")
    kinds = {"inline_id": "int", "section_index": "int", "x0": "int", "z0": "int", "x1": "int", "z1": "int", "patch_size": "int", "label_pixels": "long"}
    keep = ["sample_id", "split", "source_id", "inline_id", "section_index", "x0", "z0", "label_pixels", "source_nx", "source_nz", "requested_split", "source_segy", "source_csv", "source_segy_sha256", "source_csv_sha256"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at = store(folder)

        def put(name: str, body: bytes) -> tuple[str, str]:
            place.create_dir(f"{at}/{name.rpartition('/')[0]}", recursive=True)
            with place.open_output_stream(f"{at}/{name}") as out:
                out.write(body)
            return name, hashlib.sha256(body).hexdigest()

        for x in frames:
            made = []
            for row in x.to_dict("records"):
                stem = f"{row['split']}_{row['nth'] - 1:06d}"
                out = {k: row[k] for k in keep if k in MANIFEST} | {"x1": row["x0"] + side, "z1": row["z0"] + side, "patch_size": side, "array_axis_order": "x,z"}
                arrays = {"seismic": np.asarray(row["image"], "<f4").reshape(side, side), "label": np.asarray(row["label"], np.uint8).reshape(side, side)}
                for name, array in arrays.items():
                    stem_at = f"{row['split']}/{name}{'s' if name == 'label' else ''}/{stem}"
                    body = io.BytesIO()
                    np.save(body, array)
                    numpy_file = put(f"{stem_at}.npy", body.getvalue()) if npy else ("", "")
                    plain_file = put(f"{stem_at}.dat", array.tobytes()) if dat else ("", "")
                    out[f"{name}_file"], out[f"{name}_sha256"] = numpy_file if npy else plain_file
                    out[f"{name}_dat_file"], out[f"{name}_dat_sha256"] = plain_file
                record = {k: row[k] for k in keep} | {"array_axis_order": ["x", "z"], "image_shape": [side, side], "patch_size": side}
                out["metadata_file"], out["metadata_sha256"] = put(f"{row['split']}/metadata/{stem}.json", json.dumps(record, indent=2, sort_keys=True, default=int).encode())
                made.append(out)
            if made:
                yield pd.DataFrame(made)[MANIFEST]

    return rows.select(*keep, "nth", "image", "label").mapInPandas(write, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in MANIFEST))


def write_manifest(rows: DataFrame, path: str, key: str = "sample_id") -> None:
    """Writes rows as CSV with a header; a repeated key is an error, and so is a folder that exists."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{key} {twice[key]} occurs {twice['n']} times")
    rows.write.mode("errorifexists").option("header", True).csv(path)
