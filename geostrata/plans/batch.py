"""A SEG-Y cube to fault lines of many inlines: read, scale, tile, score, blend, detect, check and write, as one plan over all sections."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from geostrata.config import DetectionConfig, LinkConfig, TileConfig, as_json
from geostrata.operators import contracts, tiles
from geostrata.plans import detection
from geostrata.sources import fault_lines, files, segy_index
from geostrata.storage import cut_lineage, is_published

KEY = "inline_number"


def detect_sections(traces: DataFrame, scorer: tiles.Scorer | tiles.ModelFile, tile: TileConfig = TileConfig(), config: DetectionConfig = DetectionConfig()) -> dict[str, DataFrame]:
    """The stages of detection on the sections' probability maps; `probabilities` among them."""
    pixels = cut_lineage(tiles.probability_map(traces, scorer, tile))
    return {"probabilities": pixels} | detection.detect_lines(pixels, config)


def run_batch(spark: SparkSession, path: str, scorer: tiles.Scorer | tiles.ModelFile, folder: str, link: LinkConfig, xline_stride: int = 2, sample_stride: int = 2, tile: TileConfig = TileConfig(), config: DetectionConfig = DetectionConfig(), allow_missing: bool = False, fail_on_empty: bool = False, hash_input: bool = True, overwrite: bool = False) -> dict:
    """Processes the inlines of link's range and publishes the fault-line artefact; gives its metadata.

    The cube may be one file or several (a folder or pattern), its traces in any order. Its axes come to the
    driver, one row an inline and a crossline; headers, pixels, tiles and points stay in Spark.
    """
    if not overwrite and is_published(spark, folder):
        raise FileExistsError(f"{folder} exists")
    index = cut_lineage(segy_index.scan_headers(spark, path))
    facts = segy_index.layout_facts(index).first()
    available = segy_index.inline_facts(index)
    chosen = [x[KEY] for x in contracts.select_inlines(available.select(KEY), link.inline_origin, link.inline_start, link.inline_end, link.inline_step, allow_missing).orderBy(KEY).collect()]  # at most one row an inline
    xlines = [x["crossline"] for x in index.select("crossline").distinct().orderBy("crossline").collect()]  # one row a crossline
    traces = segy_index.read_sections(index, chosen, xline_stride, sample_stride)
    stages = detect_sections(traces, scorer, tile, config)
    samples, interval = facts["layout"]["samples"], facts["layout"]["interval"]
    nx, nz = -(-len(xlines) // xline_stride), -(-samples // sample_stride)
    lines = fault_lines.normalised(cut_lineage(stages["interpolated"]), nx, nz)
    sections = spark.createDataFrame([(i,) for i in chosen], f"{KEY} int")
    if fail_on_empty:
        bare = sections.join(lines, KEY, "left_anti").first()
        if bare:
            raise ValueError(f"no fault line on inline {bare[KEY]}")
    parts = [x["path"] for x in index.select("path").distinct().collect()]  # one row a file
    sums = {x["path"].rpartition("/")[2]: x["sha256"] for x in files.checksums(spark, parts, hash_input).orderBy("path").collect()}
    whole = (next(iter(sums.values())) if len(sums) == 1 else hashlib.sha256("".join(sums.values()).encode()).hexdigest()) if hash_input else None
    axes = {"crossline": (xlines, xline_stride), "sample": ([k * interval / 1000 for k in range(samples)], sample_stride)}
    records = {f"{kind}_{name}_axis": axis_record(values[:: stride if kind == "processed" else 1], stride if kind == "processed" else 1) for name, (values, stride) in axes.items() for kind in ("native", "processed")}
    model = {"model_file": scorer.path.rpartition("/")[2], "model_sha256": scorer.sha256} if isinstance(scorer, tiles.ModelFile) else {}
    metadata = {
        "input": {"segy_file": path.rpartition("/")[2], "segy_sha256": whole, "segy_files": sums},
        "coordinates": {"processed_section_shape": [nx, nz], "crossline_stride": xline_stride, "sample_stride": sample_stride} | records,
        "model": {"file": scorer.path.rpartition("/")[2], "sha256": scorer.sha256} if isinstance(scorer, tiles.ModelFile) else None,
        "parameters": {"tiles": as_json(tile), "detection": as_json(config)},
        "selected_inline_numbers": chosen,
    }
    return fault_lines.write_fault_lines(lines, sections, folder, link, metadata, overwrite, more={"stage_counts": detection.stage_counts(stages)})


def axis_record(values: list, stride: int) -> dict:
    """What the metadata says of an axis: ends, count, stride, and its step if it is regular, else its values."""
    if not values:
        raise ValueError("an axis must not be empty")
    steps = np.diff(np.asarray(values, float))
    regular = bool(len(steps) == 0 or np.allclose(steps, steps[0], rtol=0, atol=1e-9))
    record = {"count": len(values), "start": values[0], "end": values[-1], "stride_from_native_axis": stride, "regular": regular}
    return record | ({"step": float(steps[0]) if len(steps) else None} if regular else {"values": list(values)})
