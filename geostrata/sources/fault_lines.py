"""The artefact between detection and reconstruction: fault points in Parquet, and a sidecar of metadata and one row per section."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.config import LinkConfig
from geostrata.functions import scalars
from geostrata.operators import contracts
from geostrata.sources import files, segy
from geostrata.storage import current_version, publish

# What a sidecar says of itself.
SCHEMA_VERSION, ARTIFACT_TYPE, COORDINATE_MODE, POINT_COLUMNS = "1.0", "fault_lines_2d", "downsampled_array_index", ["processed_profile_index", "processed_sample_index"]
MAPPING = ("inline_origin", "inline_step", "inline_start", "inline_end")


def normalised(lines: DataFrame, nx: int, nz: int, key: str = "inline_number", label: str = "label") -> DataFrame:
    """lines with dense cluster ids from 0, after checks: at least two distinct finite points a cluster, inside the section. Breaking clusters are an error that names one."""
    facts = contracts.cluster_contract(lines, [key, label], F.lit(nx), F.lit(nz))
    bad = facts.where("not ok").orderBy(key, label).first()
    if bad:
        raise ValueError(f"a cluster breaks the contract: {bad.asDict()}")
    return contracts.dense_ids(lines, key, label, "cluster_id")


def section_rows(points: DataFrame, sections: DataFrame, config: LinkConfig, key: str = "inline_number") -> DataFrame:
    """(inline_number, line_key, fault_line_count, point_count): one row per section, those without points included."""
    counts = points.groupBy(key).agg(F.countDistinct("cluster_id").alias("fault_line_count"), F.count("*").alias("point_count"))
    rows = sections.select(key).distinct().join(counts, key, "left").fillna(0)
    return rows.select(F.col(key).alias("inline_number"), scalars.inline_to_line_key(F.col(key), config.inline_origin, config.inline_step).alias("line_key"), "fault_line_count", "point_count")


def totals(rows: DataFrame) -> dict:
    """Sections, sections with lines, lines and points: one row comes to the driver."""
    t = rows.agg(F.count("*").alias("sections"), F.count_if(F.col("fault_line_count") > 0).alias("nonempty_sections"), F.coalesce(F.sum("fault_line_count"), F.lit(0)).alias("fault_lines"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"))
    return t.first().asDict()


def write_section_npz(points: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes points (inline_number, cluster_id, x, z) as one flat .npz a section and gives (inline_number, path, clusters, points).

    A file holds points, cluster_ids, point_offsets and point_columns, without pickled objects. A section is one
    group: its size is bounded by its pixels. A file that exists is an error unless overwrite.
    """

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cluster_id", "x", "z"])
        ids, first = np.unique(part["cluster_id"].to_numpy(np.int32), return_index=True)
        held, body = part[["x", "z"]].to_numpy(np.int32), io.BytesIO()
        np.savez_compressed(body, points=held, cluster_ids=ids, point_offsets=np.append(first, len(part)).astype(np.int64), point_columns=np.array(["profile_index", "sample_index"]))
        name = f"section_{int(part['inline_number'].iloc[0]):06d}.npz"
        store, at = files.store(folder)
        store.create_dir(at, recursive=True)
        if not overwrite and store.get_file_info(f"{at}/{name}").is_file:
            raise ValueError(f"{name} exists")
        with store.open_output_stream(f"{at}/{name}") as out:
            out.write(body.getvalue())
        return pd.DataFrame({"inline_number": [part["inline_number"].iloc[0]], "path": [f"{folder}/{name}"], "clusters": [len(ids)], "points": [len(part)]})

    return points.select("inline_number", "cluster_id", "x", "z").groupBy("inline_number").applyInPandas(write, "inline_number int, path string, clusters long, points long")


def read_section_npz(files_of: DataFrame) -> DataFrame:
    """(inline_number, cluster_id, x, z) of the archives that (inline_number, path) names, one task a file. Offsets that don't span the points, and arrays of objects, are errors."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for inline, path in zip(frame["inline_number"], frame["path"], strict=True):
                with segy.opened(path) as f:
                    held = np.load(io.BytesIO(f.read()), allow_pickle=False)
                    points, ids, offsets = (held[k] for k in ("points", "cluster_ids", "point_offsets"))
                if len(offsets) != len(ids) + 1 or offsets[0] or offsets[-1] != len(points) or (np.diff(offsets) < 1).any():
                    raise ValueError(f"the offsets of {path} don't span its points")
                yield pd.DataFrame({"inline_number": inline, "cluster_id": np.repeat(ids, np.diff(offsets)), "x": points[:, 0], "z": points[:, 1]})

    return files_of.select("inline_number", "path").repartition("path").mapInPandas(read, "inline_number int, cluster_id int, x int, z int")


def write_fault_lines(points: DataFrame, sections: DataFrame, folder: str, config: LinkConfig, metadata: dict | None = None, overwrite: bool = False, allow_empty: bool = False, more: dict[str, DataFrame] | None = None) -> dict:
    """Publishes points (inline_number, cluster_id, x, z), their sidecar and the tables in more, and gives the metadata.

    A new version is written beside the one before, checked, and then takes its place in one step (storage.publish), so an error
    leaves what was there. An existing artefact is an error unless overwrite; so are sections off the declared
    inlines, counts that disagree, and no lines at all unless allow_empty.
    """
    spark, record = points.sparkSession, {}

    def write(version: str) -> None:
        keyed = points.withColumn("line_key", scalars.inline_to_line_key(F.col("inline_number"), config.inline_origin, config.inline_step))
        keyed.select("inline_number", "line_key", "cluster_id", "x", "z").write.parquet(f"{version}/points")
        section_rows(spark.read.parquet(f"{version}/points"), sections, config).write.parquet(f"{version}/sections")
        for name, table in (more or {}).items():
            table.write.parquet(f"{version}/{name}")

    def check(version: str) -> None:
        rows = spark.read.parquet(f"{version}/sections")
        odd = rows.where(F.col("line_key").isNull() | ~F.col("inline_number").between(config.inline_start, config.inline_end)).first()
        counts = totals(rows)
        if odd or (not counts["fault_lines"] and not allow_empty):
            raise ValueError(f"section {odd['inline_number']} is off the declared inlines" if odd else "no section has a fault line")
        record.update((metadata or {}) | {
            "schema_version": SCHEMA_VERSION, "artifact_type": ARTIFACT_TYPE, "line_mapping": {k: getattr(config, k) for k in MAPPING},
            "coordinates": {"point_columns": POINT_COLUMNS, "coordinate_mode": COORDINATE_MODE} | (metadata or {}).get("coordinates", {}), "counts": counts,
        })
        problem = reconcile(spark.read.parquet(f"{version}/points"), rows, record).first()
        if problem:
            raise ValueError(problem["problem"])
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{version}/metadata")

    publish(spark, folder, write, check, overwrite)
    return record


def read_metadata(spark: SparkSession, version: str) -> dict:
    """The record of a version's sidecar, checked: version, type, a valid inline mapping, coordinate mode and columns."""
    record = json.loads("\n".join(x["value"] for x in spark.read.text(f"{version}/metadata", wholetext=True).collect()))  # one record
    mapping, coordinates = record.get("line_mapping") or {}, record.get("coordinates") or {}
    rules = [
        (record.get("schema_version") != SCHEMA_VERSION, f"schema_version is not {SCHEMA_VERSION}"),
        (record.get("artifact_type") != ARTIFACT_TYPE, f"artifact_type is not {ARTIFACT_TYPE}"),
        (not all(isinstance(mapping.get(k), int) for k in MAPPING), "line_mapping lacks integers"),
        (coordinates.get("point_columns") != POINT_COLUMNS, "point_columns differ"),
        (coordinates.get("coordinate_mode") != COORDINATE_MODE, "coordinate_mode is not supported"),
    ]
    for bad, why in rules:
        if bad:
            raise ValueError(why)
    if mapping["inline_step"] <= 0 or mapping["inline_end"] < mapping["inline_start"]:
        raise ValueError("line_mapping has an invalid range or step")
    return record


def reconcile(points: DataFrame, sections: DataFrame, record: dict) -> DataFrame:
    """(problem): sections whose key, inline or counts disagree with the points, and totals that disagree with the record. Empty if all is well."""
    m = record["line_mapping"]
    inline = scalars.line_key_to_inline(F.col("line_key"), m["inline_origin"], m["inline_step"])
    wrong = sections.where(~F.coalesce(inline == F.col("inline_number"), F.lit(False)) | ~F.col("inline_number").between(m["inline_start"], m["inline_end"]))
    found = points.groupBy("line_key").agg(F.countDistinct("cluster_id").alias("lines"), F.count("*").alias("points"))
    met = sections.join(found, "line_key", "full_outer")
    differ = met.where(F.col("inline_number").isNull() | (F.coalesce("lines", F.lit(0)) != F.col("fault_line_count")) | (F.coalesce("points", F.lit(0)) != F.col("point_count")))
    declared = record.get("counts", {})
    off = [k for k, v in totals(sections).items() if declared.get(k) != v]
    spark = points.sparkSession
    said = spark.createDataFrame([(f"counts.{k} is inconsistent",) for k in off], "problem string")
    name = lambda df, what: df.select(F.concat(F.coalesce("line_key", F.lit("a section without key")), F.lit(what)).alias("problem"))
    return name(wrong, " is not where the mapping has it").union(name(differ, " has other counts than its points")).union(said)


def resolve_mapping(record: dict | None, config: LinkConfig = LinkConfig(), **wanted: int) -> LinkConfig:
    """config with the artefact's inline mapping. Wanted origin and step must agree with it; start and end may narrow it. Without a record the configuration's own mapping counts."""
    unknown = set(wanted) - set(MAPPING)
    if unknown:
        raise ValueError(f"not part of a mapping: {sorted(unknown)}")
    if record is None:
        return replace(config, **wanted)
    m = {k: record["line_mapping"][k] for k in MAPPING}
    for k in ("inline_origin", "inline_step"):
        if wanted.get(k, m[k]) != m[k]:
            raise ValueError(f"{k} conflicts with the artefact")
    out = m | wanted
    if out["inline_start"] < m["inline_start"] or out["inline_end"] > m["inline_end"]:
        raise ValueError("the wanted inlines reach beyond the artefact")
    return replace(config, **out)


def read_fault_lines(spark: SparkSession, folder: str, config: LinkConfig = LinkConfig(), **wanted: int) -> tuple[DataFrame, LinkConfig]:
    """((sec, cluster, x, z) for reconstruction, the resolved configuration) of the published version: reconciled with the sidecar, inlines outside the wanted range left out."""
    version = current_version(spark, folder)
    record = read_metadata(spark, version)
    points, sections = spark.read.parquet(f"{version}/points"), spark.read.parquet(f"{version}/sections")
    problem = reconcile(points, sections, record).first()
    if problem:
        raise ValueError(problem["problem"])
    c = resolve_mapping(record, config, **wanted)
    kept = points.where(F.col("inline_number").between(c.inline_start, c.inline_end))
    sec = ((F.col("inline_number") - c.inline_origin) / c.inline_step).cast("int")
    return kept.select(sec.alias("sec"), F.col("cluster_id").cast("string").alias("cluster"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")), c
