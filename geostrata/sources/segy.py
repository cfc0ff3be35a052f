"""A data source for SEG-Y files, by the published byte layout: regular cubes by inline, other files as one line of traces.

spark.dataSource.register(SegyDataSource); spark.read.format("segy").option("path", ...).load()
Options: xlineStride and sampleStride (1) thin a section out; inline reads one inline only, section one by its
place from 0; layout is auto, cube or line; pushFilters (false) takes `inline_number = n` from a query's filters,
for which Spark wants spark.sql.python.filterPushdown.enabled. Planning reads the headers of the first inline and one header an
inline; tasks read ranges of traces and check that these are where a regular cube has them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# Fixed values of the format: header sizes and, from 0, the places of the fields used.
TEXT, BINARY, TRACE = 3200, 400, 240
AT_INTERVAL, AT_SAMPLES, AT_FORMAT = 3216, 3220, 3224
AT_INLINE, AT_XLINE = 188, 192
#: Bytes read at once.
READ_BYTES = 1 << 23


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """32-bit hexadecimal floating point to doubles: sign, exponent of 16 excess 64, fraction of 24 bits."""
    sign = np.where(raw >> np.uint32(31), -1.0, 1.0)
    exponent = ((raw >> np.uint32(24)) & np.uint32(0x7F)).astype(np.int64) - 64
    return sign * (raw & np.uint32(0xFFFFFF)) / float(1 << 24) * np.power(16.0, exponent)


def opened(path: str):
    """A file that can be sought, by URI or local path."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _key(f, at: int) -> tuple[int, int]:
    f.seek(at + AT_INLINE)
    return struct.unpack(">ii", f.read(8))


def file_layout(f, length: int | None = None) -> dict:
    """Samples, interval, format code and number of traces that a file's head and size tell."""
    f.seek(0)
    head = f.read(TEXT + BINARY)
    if len(head) < TEXT + BINARY:
        raise ValueError("the file does not hold a whole number of traces")
    interval, samples, code = (struct.unpack(">H", head[at : at + 2])[0] for at in (AT_INTERVAL, AT_SAMPLES, AT_FORMAT))
    if code not in (1, 5):
        raise ValueError(f"format code {code} is not supported")
    count, rest = divmod((f.size() if length is None else length) - TEXT - BINARY, TRACE + 4 * samples)
    if rest or not count:
        raise ValueError("the file does not hold a whole number of traces")
    return {"samples": samples, "interval": interval, "format": code, "traces": count}


def trace_ranges(f, layout: dict, runs: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(first trace, traces as a structured array) of ranges of traces, in their order, READ_BYTES at most at once."""
    kind = np.dtype([("head", f"V{AT_INLINE}"), ("inline", ">i4"), ("crossline", ">i4"), ("tail", f"V{TRACE - AT_XLINE - 4}"), ("data", ">f4" if layout["format"] == 5 else ">u4", (layout["samples"],))])
    most = max(1, READ_BYTES // kind.itemsize)
    for begin, end in runs:
        f.seek(TEXT + BINARY + begin * kind.itemsize)
        for at in range(begin, end, most):
            n = min(most, end - at)
            yield at, np.frombuffer(f.read(n * kind.itemsize), kind, n)


def trace_batch(inlines: np.ndarray | None, places: np.ndarray, raw: np.ndarray, stride: int) -> pa.RecordBatch:
    """Traces as a batch of (inline_number, xl_pos, crossline, amplitudes), every stride-th sample; no inlines make a null column."""
    data = raw["data"][:, ::stride]
    values = (data if data.dtype.kind == "f" else ibm_to_float(data.astype(np.uint32))).astype(np.float32)
    n, width = values.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
    columns = [pa.nulls(n, pa.int32()) if inlines is None else pa.array(inlines), pa.array(places), pa.array(raw["crossline"].astype(np.int32)), lists]
    return pa.RecordBatch.from_arrays(columns, names=["inline_number", "xl_pos", "crossline", "amplitudes"])


def geometry(path: str, layout: str = "auto") -> dict:
    """Samples, interval, format code, traces, and the inlines and crosslines of a regular cube sorted by inline and crossline; no inlines for a line.

    With layout auto, traces that are not where a cube has them make the file a line; with cube they are an error.
    """
    with opened(path) as f:
        out = file_layout(f) | {"inlines": [], "xlines": []}
        size, count = TRACE + 4 * out["samples"], out["traces"]
        if layout == "line":
            return out
        first, xlines = _key(f, TEXT + BINARY), []
        for k in range(count):
            inline, xline = _key(f, TEXT + BINARY + k * size)
            if inline != first[0]:
                break
            xlines.append(xline)
        inlines = [_key(f, TEXT + BINARY + k * size) for k in range(0, count, len(xlines))]
    regular = count % len(xlines) == 0 and len(set(xlines)) == len(xlines) and len({i for i, _ in inlines}) == len(inlines) and all(x == xlines[0] for _, x in inlines)
    if regular:
        return out | {"inlines": [i for i, _ in inlines], "xlines": xlines}
    if layout == "cube":
        raise ValueError("not a regular cube sorted by inline and crossline")
    return out


def steps(values: list[int]) -> int | None:
    """The common difference of an axis, None if there is none."""
    found = {b - a for a, b in zip(values, values[1:], strict=False)}
    return found.pop() if len(found) == 1 else None


def geometry_record(shape: dict) -> dict:
    """What a metadata record says of a file: traces, format and the extent and step of each axis."""
    axes = {"inline": shape["inlines"], "crossline": shape["xlines"], "sample_coordinate": [k * shape["interval"] / 1000 for k in range(shape["samples"])]}
    ends = {name: {"count": len(v), "minimum": v[0] if v else None, "maximum": v[-1] if v else None} for name, v in axes.items()}
    ends["inline"]["regular_step"], ends["crossline"]["regular_step"], ends["sample_coordinate"]["regular_step"] = steps(shape["inlines"]), steps(shape["xlines"]), shape["interval"] / 1000
    return {"trace_count": shape["traces"], "format_code": shape["format"], **ends}


class TraceRange(InputPartition):
    """Traces from begin up to end, of an inline unless the file is a line."""

    def __init__(self, begin: int, end: int, inline: int | None):
        self.begin, self.end, self.inline = begin, end, inline


class SegyReader(DataSourceReader):
    LINE_TRACES = 4096

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.path = given["path"]
        self.strides = int(given.get("xlinestride", 1)), int(given.get("samplestride", 1))
        if min(self.strides) < 1:
            raise ValueError("strides must be positive")
        self.inline = int(given["inline"]) if "inline" in given else None
        self.section = int(given["section"]) if "section" in given else None
        self.shape = geometry(self.path, given.get("layout", "auto"))
        self.none = False

    def partitions(self) -> list[InputPartition]:
        inlines, n = self.shape["inlines"], len(self.shape["xlines"])
        if not inlines:
            if self.section not in (None, 0) or self.inline is not None:
                raise ValueError("the file is one line of traces: it has section 0 alone")
            return [TraceRange(a, min(a + self.LINE_TRACES, self.shape["traces"]), None) for a in range(0, self.shape["traces"], self.LINE_TRACES)]
        if self.none:
            return [TraceRange(0, 0, inlines[0])]
        if self.section is not None and not 0 <= self.section < len(inlines):
            raise ValueError(f"section {self.section} is not in the file")
        found = [TraceRange(k * n, (k + 1) * n, i) for k, i in enumerate(inlines) if self.inline in (None, i) and self.section in (None, k)]
        if not found:
            raise ValueError(f"inline {self.inline} is not in the file")
        return found

    def read(self, partition: TraceRange) -> Iterator[pa.RecordBatch]:
        g, (xs, ss) = self.shape, self.strides
        xlines, cube = np.asarray(g["xlines"]), partition.inline is not None
        base = partition.begin if cube else 0
        with opened(self.path) as f:
            for at, raw in trace_ranges(f, g, [(partition.begin, partition.end)]):
                place = np.arange(at - base, at - base + len(raw), dtype=np.int32)
                kept = np.flatnonzero(place % xs == 0)
                place, raw = place[kept], raw[kept]
                if cube and ((raw["inline"] != partition.inline).any() or (raw["crossline"] != xlines[place]).any()):
                    raise ValueError("traces are not where a regular cube has them; read the file with layout line, or by an index")
                yield trace_batch(np.full(len(raw), partition.inline, np.int32) if cube else None, place // xs, raw, ss)


class FilteredSegyReader(SegyReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("inline_number",) and self.shape["inlines"]:
                self.none = self.none or f.value not in self.shape["inlines"] or self.inline not in (None, f.value)
                self.inline = f.value if not self.none else self.inline
            else:
                yield f


class SegyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return "inline_number int, xl_pos int, crossline int, amplitudes array<float>"

    def reader(self, schema) -> SegyReader:
        options = dict(self.options)
        kind = FilteredSegyReader if {k.lower(): v for k, v in options.items()}.get("pushfilters", "false").lower() == "true" else SegyReader
        return kind(options)


def write_segy(traces: DataFrame, folder: str, interval: int = 1000) -> DataFrame:
    """Writes (inline_number, crossline, amplitudes), in the order and the partitions they come in, one file a partition, and gives (path, traces).

    All traces of a file must have as many samples. A task writes a file of its own name and then gives it its
    place, so one that runs again or twice replaces it whole.
    """
    out_folder = folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(out_folder) if "://" in out_folder or out_folder.startswith("file:") else (fs.LocalFileSystem(), out_folder)
        store.create_dir(at, recursive=True)
        name, own, count, samples = f"part-{TaskContext.get().partitionId():05d}.sgy", f"{at}/.{uuid.uuid4().hex}", 0, None
        with store.open_output_stream(own) as f:
            for batch in batches:
                for inline, crossline, values in zip(*[batch.column(k) for k in range(3)], strict=True):
                    data = np.asarray(values.values, ">f4")
                    if samples is None:
                        samples, head = len(data), bytearray(TEXT + BINARY)
                        for place, value in ((AT_INTERVAL, interval), (AT_SAMPLES, samples), (AT_FORMAT, 5)):
                            head[place : place + 2] = struct.pack(">H", value)
                        f.write(bytes(head))
                    if len(data) != samples:
                        raise ValueError("traces of one file differ in samples")
                    header = bytearray(TRACE)
                    header[AT_INLINE : AT_INLINE + 8] = struct.pack(">ii", inline.as_py(), crossline.as_py())
                    f.write(bytes(header) + data.tobytes())
                    count += 1
        if count:
            store.move(own, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{out_folder}/{name}"]), pa.array([count], pa.int64())], names=["path", "traces"])
        else:
            store.delete_file(own)

    return traces.select("inline_number", "crossline", "amplitudes").mapInArrow(run, "path string, traces long")
