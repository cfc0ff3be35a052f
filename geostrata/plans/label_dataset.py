"""Interpreted lines to a dataset of patches: sections and picks, label maps, patches with pixels, a safe split, files and manifest."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.config import LabelConfig, LineConfig
from geostrata.operators import labels, splits
from geostrata.sources import files
from geostrata.storage import cut_lineage

EPS = 1e-8


def unit_range(values: Column, low: Column, high: Column) -> Column:
    """An array scaled to [0, 1] in single precision; NaN stays. The ends are worked out once an array, not once an element, whatever they are made of."""
    ends = F.array(F.struct(values.alias("v"), low.alias("low"), (high - low + EPS).alias("width")))
    return F.transform(ends, lambda e: F.transform(e["v"], lambda v: ((v - e["low"]) / e["width"]).cast("float")))[0]


def _finite(values: Column) -> Column:
    return F.filter(values, lambda v: ~F.isnan(v))


def bits_of(places: Column, n: int | Column) -> Column:
    """n zeros with a one at each of the places, an ascending array; null has none. Zeros between neighbours are laid out at once, so the work follows n."""
    held = F.coalesce(places.cast("array<int>"), F.array().cast("array<int>"))
    zeros = lambda k: F.array_repeat(F.lit(0), k)
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), held), held, lambda a, b: F.when(b.isNotNull(), F.concat(zeros(b - a - 1), F.array(F.lit(1)))).otherwise(zeros(F.lit(n) - 1 - a)))
    return F.flatten(gaps)


def patch_pixels(traces: DataFrame, label_map: DataFrame, origins: DataFrame, patch: int) -> DataFrame:
    """origins with image and label, arrays in (x, z) order. traces: (line, x, amplitudes, nx, nz); label_map: (line, x, z); origins: (line, x0, z0, ...).

    Each trace is cut to the patches that hold it, so a patch gathers its own pixels and no more; images are
    scaled to [0, 1] each for itself.
    """
    marked = label_map.groupBy("line", "x").agg(F.array_sort(F.collect_set("z")).alias("zs"))
    rows = traces.where(F.col("x") < F.col("nx")).join(marked, ["line", "x"], "left").select("line", "x", "amplitudes", bits_of(F.col("zs"), F.col("nz")).alias("bits"))
    columns = origins.groupBy("line", "x0").agg(F.collect_list("z0").alias("z0s")).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x0") + patch - 1)))
    cut = rows.join(columns, ["line", "x"]).withColumn("z0", F.explode("z0s"))
    part = lambda c: F.slice(c, F.col("z0") + 1, patch)
    held = cut.groupBy("line", "x0", "z0").agg(F.array_sort(F.collect_list(F.struct("x", part("amplitudes").alias("a"), part("bits").alias("b")))).alias("rows"))
    flat = held.select("line", "x0", "z0", F.flatten(F.transform("rows", lambda r: r["a"])).alias("a"), F.flatten(F.transform("rows", lambda r: r["b"])).alias("label"))
    image = unit_range(F.col("a"), F.array_min(_finite(F.col("a"))), F.array_max(_finite(F.col("a"))))
    return origins.join(flat.select("line", "x0", "z0", image.alias("image"), "label"), ["line", "x0", "z0"])


def line_table(spark: SparkSession, lines: list[LineConfig], checksums: list[tuple[str, str]]) -> DataFrame:
    """One row a line, by its place in the list: what its patches say of their source, and how it is thinned out."""
    rows = []
    for k, (line, (segy_sum, csv_sum)) in enumerate(zip(lines, checksums, strict=True)):
        tall = line.label_shape_before_downsample or (None, None)
        rows.append((k, line.inline_id, line.section_index, line.segy_path, line.csv_path, segy_sum, csv_sum, line.split, line.fault_id_col is not None, line.downsample_x, line.downsample_z, *tall))
    kinds = "line int, inline_id int, section_index int, source_segy string, source_csv string, source_segy_sha256 string, source_csv_sha256 string, requested_split string, faults boolean, down_x int, down_z int, tall_x int, tall_z int"
    return spark.createDataFrame(rows, kinds)


def sized_lines(traces: DataFrame, table: DataFrame) -> DataFrame:
    """table with each section's finite range, the label map's size before thinning and, as nx and nz, the pixels that both share. A line without traces is an error."""
    low, high = F.array_min(_finite(F.col("amplitudes"))), F.array_max(_finite(F.col("amplitudes")))
    facts = traces.groupBy("line").agg((F.max("x") + 1).alias("sx"), F.min(F.size("amplitudes")).alias("sz"), F.min(low).alias("low"), F.max(high).alias("high"))
    found = table.join(facts, "line", "left")
    tall = {f"tall_{c}": F.coalesce(f"tall_{c}", F.col(f"s{c}") * F.col(f"down_{c}")) for c in "xz"}
    shared = {f"n{c}": F.least(F.col(f"s{c}"), F.ceil(F.col(f"tall_{c}") / F.col(f"down_{c}")).cast("int")) for c in "xz"}
    out = cut_lineage(found.withColumns(tall).withColumns(shared))
    bare = out.where("sx is null").first()
    if bare:
        raise ValueError(f"the section has no traces: {bare['source_segy']}")
    return out


def label_maps(picks: DataFrame, sized: DataFrame, ellipse: tuple[int, int]) -> DataFrame:
    """(line, x, z): the label pixels of every line: picks in bounds, drawn by fault where the line has faults, dilated, thinned out and cut to the shared pixels. picks: (line, x_idx, z_idx, fault_id)."""
    shape = sized.select("line", "faults", "tall_x", "tall_z", "down_x", "down_z", "nx", "nz")
    points = picks.join(shape, "line").where(F.col("x_idx").between(0, F.col("tall_x") - 1) & F.col("z_idx").between(0, F.col("tall_z") - 1))
    drawn = labels.raster(labels.polyline_segments(points.where("faults"), ["line", "fault_id"]), ["line"])
    alone = points.where("not faults").select("line", F.col("x_idx").alias("x"), F.col("z_idx").alias("z"))
    wide = labels.dilate(drawn.unionByName(alone).distinct(), labels.ellipse(*ellipse), ["line"]).join(shape, "line")
    kept = wide.where(F.col("x").between(0, F.col("tall_x") - 1) & F.col("z").between(0, F.col("tall_z") - 1) & (F.col("x") % F.col("down_x") == 0) & (F.col("z") % F.col("down_z") == 0))
    thin = kept.select("line", F.floor(F.col("x") / F.col("down_x")).cast("int").alias("x"), F.floor(F.col("z") / F.col("down_z")).cast("int").alias("z"), "nx", "nz")
    return thin.where("x < nx and z < nz").select("line", "x", "z")


def line_records(traces: DataFrame, picks: DataFrame, table: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """One row per patch of all lines: (x0, z0, label_pixels, image, label) and its source's columns, in one plan keyed by line.

    traces: (line, x, amplitudes), thinned out already; picks: (line, x_idx, z_idx, fault_id), in pixels before
    thinning; table: line_table. A section is scaled to [0, 1], then each patch.
    """
    sized = sized_lines(traces, table)
    size = sized.select("line", "nx", "nz")
    scaled = traces.join(sized.select("line", "low", "high", "nx", "nz"), "line").select("line", "x", unit_range(F.col("amplitudes"), F.col("low"), F.col("high")).alias("amplitudes"), "nx", "nz")
    label = cut_lineage(label_maps(picks, sized, config.ellipse))
    found = labels.patches(label.join(size, "line"), F.col("nx"), F.col("nz"), config.patch_size, config.stride, ["line"], config.min_label_pixels if config.positive_only else 1)
    if not config.positive_only:
        along = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col(c) - config.patch_size) / config.stride).cast("int")), lambda k: k * config.stride))
        every = size.where(F.least("nx", "nz") >= config.patch_size).withColumn("x0", along("nx")).withColumn("z0", along("nz")).select("line", "x0", "z0")
        found = every.join(found, ["line", "x0", "z0"], "left").fillna(0, ["label_pixels"])
    out = patch_pixels(scaled, label, cut_lineage(found), config.patch_size)
    source = labels.source_id(F.col("inline_id"), F.col("section_index"), F.col("source_segy_sha256"))
    told = sized.select("line", source.alias("source_id"), "inline_id", "section_index", F.col("nx").alias("source_nx"), F.col("nz").alias("source_nz"), "source_segy", "source_csv", "source_segy_sha256", "source_csv_sha256", "requested_split")
    return out.join(told, "line").drop("line")


def read_lines(spark: SparkSession, lines: list[LineConfig]) -> tuple[DataFrame, DataFrame]:
    """(line, x, amplitudes) and (line, x_idx, z_idx, fault_id) of all lines. A section file is scanned once for all its lines that are thinned out alike, a file of picks once a line."""
    scans: dict[tuple, list[int]] = {}
    for k, line in enumerate(lines):
        scans.setdefault((line.segy_path, line.downsample_x, line.downsample_z), []).append(k)
    traces, picks = [], []
    for held in scans.values():
        if len(held) == 1:
            traces.append(files.read_section(spark, lines[held[0]]).select(F.lit(held[0]).alias("line"), "x", "amplitudes"))
        else:
            traces.append(files.read_sections(spark, [lines[k] for k in held], held))
    for k, line in enumerate(lines):
        some = files.read_picks(spark, line)
        picks.append(some.select(F.lit(k).alias("line"), "x_idx", "z_idx", (F.col("fault_id") if "fault_id" in some.columns else F.lit(None)).cast("string").alias("fault_id")))
    together = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return together(traces), together(picks)


def build_label_dataset(spark: SparkSession, lines: list[LineConfig], folder: str, config: LabelConfig = LabelConfig(), npy: bool = True, dat: bool = False) -> dict[str, DataFrame]:
    """Reads all lines, splits their patches and writes them with their manifest under folder; gives summary, assigned and manifest.

    The folder must be new or empty. A line is a key of the plan, so lines are worked on side by side.
    """
    files.need_empty(spark, folder)
    files.check_lines(lines, config)
    found = {x["path"]: x["sha256"] for x in files.checksums(spark, sorted({p for x in lines for p in (x.segy_path, x.csv_path)})).collect()}  # one row per input file
    table = line_table(spark, lines, [tuple(found[files.plain_path(p)] for p in (x.segy_path, x.csv_path)) for x in lines])
    records = cut_lineage(line_records(*read_lines(spark, lines), table, config))
    twice = labels.duplicates(records.select("source_segy_sha256", "section_index", "x0", "z0"), ["source_segy_sha256", "section_index", "x0", "z0"]).first()
    if twice:
        raise ValueError(f"a physical section is listed twice: {twice}")
    split = splits.split_records(records, config)
    rows = split["train"].withColumn("split", F.lit("train")).unionByName(split["val"].withColumn("split", F.lit("val")))
    files.write_manifest(cut_lineage(files.write_patches(rows, folder, config.patch_size, npy, dat)), f"{folder}/manifest")
    split["summary"].write.json(f"{folder}/summary")
    return {"summary": split["summary"], "assigned": split["assigned"], "manifest": spark.read.option("header", True).csv(f"{folder}/manifest")}
