"""An index of SEG-Y trace headers, and sections read by it: traces may lie in any order, in one file or many.

Files are scanned for headers as ranges of bytes, each a row of a plan, so a survey of any size is one Spark job; the
driver lists no traces. The index is a table (path, trace, inline_number, crossline, and the layout of its file).
What a cube must be (one trace at each crossing, one layout) is told by aggregates over it. Readers choose their
traces from the index and deal them by place in the files, so that tasks read ranges one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.operators import ranking
from geostrata.sources import segy

SCHEMA = "path string, trace long, inline_number int, crossline int, samples int, interval int, format int"
#: Bytes of files that one task scans for headers.
RANGE_BYTES = 1 << 26


def scan_headers(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index of files: one row a trace. paths may be files, folders or patterns; a file that does not hold whole traces is an error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", begins.alias("begin")).repartition("path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, begin in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                yield from _headers(path, length, begin, begin + range_bytes)

    return ranges.mapInArrow(run, SCHEMA)


def _headers(path: str, length: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Headers of the traces that begin in a range of bytes."""
    with segy.opened(path) as f:
        head = segy.file_layout(f, length)
        size = segy.TRACE + 4 * head["samples"]
        first, last = (max(0, -(-(at - segy.TEXT - segy.BINARY) // size)) for at in (begin, end))
        for at, raw in segy.trace_ranges(f, head, [(first, min(last, head["traces"]))]):
            n = len(raw)
            same = [np.full(n, head[k], np.int32) for k in ("samples", "interval", "format")]
            columns = [pa.array([path] * n), np.arange(at, at + n), raw["inline"].astype(np.int32), raw["crossline"].astype(np.int32), *same]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "trace", "inline_number", "crossline", "samples", "interval", "format"])


def inline_facts(index: DataFrame) -> DataFrame:
    """(inline_number, traces, crosslines, first, last): one row an inline."""
    return index.groupBy("inline_number").agg(F.count("*").alias("traces"), F.countDistinct("crossline").alias("crosslines"), F.min("crossline").alias("first"), F.max("crossline").alias("last"))


def layout_facts(index: DataFrame) -> DataFrame:
    """One row: traces, layouts (distinct samples, interval and format), the layout, inlines and crosslines. An empty index has no traces."""
    layout = F.struct("samples", "interval", "format")
    return index.agg(F.count("*").alias("traces"), F.countDistinct(layout).alias("layouts"), F.min(layout).alias("layout"), F.countDistinct("inline_number").alias("inlines"), F.countDistinct("crossline").alias("crosslines"))


def cube_problems(index: DataFrame) -> DataFrame:
    """(problem): what keeps the traces from being a regular cube; empty if they are one."""
    rules = [(F.col("traces") == 0, "no traces"), (F.col("layouts") > 1, "files differ in samples, interval or format"), (F.col("traces") != F.col("inlines") * F.col("crosslines"), "not one trace at each crossing of inlines and crosslines")]
    wide = layout_facts(index).select(F.explode(F.array_compact(F.array(*[F.when(bad, what) for bad, what in rules]))).alias("problem"))
    twice = inline_facts(index).where("traces > crosslines").select(F.format_string("inline %d has a crossline twice", "inline_number").alias("problem"))
    return wide.unionAll(twice)


def sorting(index: DataFrame) -> DataFrame:
    """(path, sorting): inline, crossline, both (a single line) or none, by whether traces ascend by (inline, crossline) or by (crossline, inline) within each file.

    Neighbours are compared by an equi-join on trace numbers, so a file of any length is shared by many tasks.
    """
    key = F.struct("inline_number", "crossline").alias("k")
    other = F.struct("crossline", "inline_number").alias("o")
    here = index.select("path", "trace", key, other)
    after = index.select("path", (F.col("trace") - 1).alias("trace"), key.alias("k2"), other.alias("o2"))
    met = here.join(after, ["path", "trace"], "left").groupBy("path").agg(F.coalesce(F.bool_and(F.col("k") < F.col("k2")), F.lit(True)).alias("i"), F.coalesce(F.bool_and(F.col("o") < F.col("o2")), F.lit(True)).alias("x"))
    return met.select("path", F.when(F.col("i") & F.col("x"), "both").when(F.col("i"), "inline").when(F.col("x"), "crossline").otherwise("none").alias("sorting"))


def write_index(index: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes the index by ranges of (inline, crossline), so that a reader of some inlines opens only their files."""
    ordered = index.repartitionByRange("inline_number", "crossline").sortWithinPartitions("inline_number", "crossline")
    ordered.write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def axes(index: DataFrame) -> dict[str, DataFrame]:
    """inline and crossline: (value, idx) of the axis, ascending and without repeats, idx from 0."""
    return {name: ranking.dense_rank(index, column, "idx").withColumnRenamed(column, "value") for name, column in (("inline", "inline_number"), ("crossline", "crossline"))}


def read_sections(index: DataFrame, inlines: list[int] | None = None, xline_stride: int = 1, sample_stride: int = 1) -> DataFrame:
    """(inline_number, xl_pos, crossline, amplitudes) of a cube's inlines, thinned out by strides; an inline that is not indexed is an error.

    xl_pos is the crossline's place on the cube's axis, divided by the stride. Rows come in the order of the files.
    """
    if min(xline_stride, sample_stride) < 1:
        raise ValueError("strides must be positive")
    problem = cube_problems(index).first()
    if problem:
        raise ValueError(f"not a regular cube: {problem['problem']}")
    axis = axes(index)["crossline"].where(F.col("idx") % xline_stride == 0)
    chosen = index
    if inlines is not None:
        chosen = index.where(F.col("inline_number").isin(*inlines))
        absent = set(inlines) - {x[0] for x in chosen.select("inline_number").distinct().collect()}  # at most one row a wanted inline
        if absent:
            raise ValueError(f"inlines {sorted(absent)} are not in the files")
    placed = chosen.join(axis.select(F.col("value").alias("crossline"), (F.col("idx") / xline_stride).cast("int").alias("xl_pos")), "crossline")
    dealt = placed.select("path", "trace", "inline_number", "crossline", "xl_pos").repartitionByRange("path", "trace").sortWithinPartitions("path", "trace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for path, part in rows.groupby("path", sort=False):
                yield from _sections(path, part, sample_stride)

    return dealt.mapInArrow(run, "inline_number int, xl_pos int, crossline int, amplitudes array<float>")


def _sections(path: str, part, stride: int) -> Iterator[pa.RecordBatch]:
    wanted = part["trace"].to_numpy()
    breaks = np.flatnonzero(np.diff(wanted) != 1) + 1
    runs = [(int(x[0]), int(x[-1]) + 1) for x in np.split(wanted, breaks)]
    done = 0
    with segy.opened(path) as f:
        for _, raw in segy.trace_ranges(f, segy.file_layout(f), runs):
            rows = part.iloc[done : done + len(raw)]
            done += len(raw)
            if (raw["inline"] != rows["inline_number"]).any() or (raw["crossline"] != rows["crossline"]).any():
                raise ValueError(f"{path} is not the file that was indexed")
            yield segy.trace_batch(rows["inline_number"].to_numpy(np.int32), rows["xl_pos"].to_numpy(np.int32), raw, stride)
