"""Surfaces as one flat .npz archive, written by many tasks: offsets first, then each task its own bytes of the file.

An .npz is a zip of arrays. Stored without compression, every array's place in the file follows from the numbers of
surfaces, vertices and faces, so tasks write their rows straight to their places, at most CHUNK rows at once; a
surface of any size is shared by tasks. The checksum of an array is put together from those of its chunks. A task
that runs again writes the same bytes. The file must lie where all workers can write within a file: a mounted
shared folder, not an object store.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators import catalogue, ranking, surface
from geostrata.sources.files import plain_path
from geostrata.storage import cut_lineage

CHUNK = 1 << 16
# Fixed values of the zip and .npy formats, and the polynomial of CRC-32, lowest power first.
LOCAL, CENTRAL, END64, LOCATOR, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
VERSION, LARGE, DAY = 45, 0xFFFFFFFF, 0x21  # zip64, sizes that are told elsewhere, 1 January 1980
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials, as CRC-32 holds them, modulo its own."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one after another, from their own and the length of the second."""
    shift, power = 1 << 31, 1 << 23  # the polynomials 1 and x to the 8th: one byte
    while length:
        if length & 1:
            shift = _times(shift, power)
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


@dataclass
class Member:
    """One array of the archive: where its local header begins, and how long that and the array's own header are."""

    name: str
    kind: str
    shape: tuple[int, ...]
    at: int = 0

    def head(self) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.kind).str, "fortran_order": False, "shape": self.shape})
        return out.getvalue()

    @property
    def row(self) -> int:
        return np.dtype(self.kind).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def size(self) -> int:
        return len(self.head()) + self.row * self.shape[0]

    def _names(self) -> bytes:
        return f"{self.name}.npy".encode()

    @property
    def data(self) -> int:
        """Where the rows begin."""
        return self.at + 30 + len(self._names()) + 20 + len(self.head())

    @property
    def end(self) -> int:
        return self.data + self.row * self.shape[0]

    def local(self, crc: int) -> bytes:
        sizes = struct.pack("<HHQQ", 1, 16, self.size, self.size)
        return LOCAL + struct.pack("<5H3L2H", VERSION, 0, 0, 0, DAY, crc, LARGE, LARGE, len(self._names()), len(sizes)) + self._names() + sizes + self.head()

    def central(self, crc: int) -> bytes:
        sizes = struct.pack("<HHQQQ", 1, 24, self.size, self.size, self.at)
        return CENTRAL + struct.pack("<6H3L5H2L", VERSION, VERSION, 0, 0, 0, DAY, crc, LARGE, LARGE, len(self._names()), len(sizes), 0, 0, 0, 0, LARGE) + self._names() + sizes


def planned(members: list[Member]) -> list[Member]:
    """Members one after another."""
    at = 0
    for m in members:
        m.at = at
        at = m.end
    return members


def write_rows(rows: DataFrame, columns: list[str], member: Member, path: str, chunk: int = CHUNK) -> DataFrame:
    """Writes rows (number, columns), numbered from 0 without a gap, as the member's array; gives (chunk, crc, length) of each chunk. A missing or repeated number is an error."""
    total, kind, name, start, width = member.shape[0], member.kind, member.name, member.data, member.row
    if not total:
        return rows.sparkSession.createDataFrame([], "chunk long, crc long, length long")

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number")
        begin = int(group[0]) * chunk
        if part["number"].tolist() != list(range(begin, min(total, begin + chunk))):
            raise ValueError(f"the rows of {name} are not numbered from 0 without a gap")
        body = np.ascontiguousarray(np.stack([part[c].to_numpy() for c in columns], axis=1).astype(kind)).tobytes()
        out = os.open(path, os.O_WRONLY)
        try:
            os.pwrite(out, body, start + begin * width)
        finally:
            os.close(out)
        return pd.DataFrame({"chunk": [int(group[0])], "crc": [zlib.crc32(body)], "length": [len(body)]})

    held = rows.select("number", *columns).withColumn("chunk", F.floor(F.col("number") / chunk))
    return held.groupBy("chunk").applyInPandas(run, "chunk long, crc long, length long")


def _faces(shapes: DataFrame, key: str) -> DataFrame:
    """(number, a, b, c): faces by their place in the archive, corners by the vertices'; two triangles a cell, cell by cell."""
    width = shapes.select(key, F.col("columns").alias("__width"), "vertex_offset", "face_offset")
    each = catalogue.structured_faces(shapes.select(key, "rows", "columns"), [key]).join(width, key)
    second = (F.col("b") - F.col("a") != F.col("__width")).cast("int")  # the lower triangle begins one vertex on
    cell = F.col("a") - second
    place = F.floor(cell / F.col("__width")) * (F.col("__width") - 1) + cell % F.col("__width")
    return each.select((F.col("face_offset") + 2 * place + second).alias("number"), *[(F.col(c) + F.col("vertex_offset")).alias(c) for c in "abc"])


def write_flat_npz(vertices: DataFrame, path: str, key: str = "track_id", depth: str = "depth", chunk: int = CHUNK) -> dict:
    """Writes grids of vertices (key, row, col, inline, profile, depth, rmse) as one archive, surfaces in order of key, and gives its counts. A file that exists is an error.

    The archive is written beside its name and takes it when it is whole.
    """
    path = plain_path(path)
    if "://" in path:
        raise ValueError("an archive needs a folder in which tasks can write within a file")
    if os.path.exists(path):
        raise FileExistsError(path)
    flat = surface.flat_offsets(vertices, key)
    shapes = cut_lineage(ranking.numbered(flat, [key], "number"))
    facts = shapes.agg(F.count("*").alias("n"), F.coalesce(F.sum("vertices"), F.lit(0)).alias("v"), F.coalesce(F.sum("faces"), F.lit(0)).alias("f"), F.coalesce(F.max(F.length(key)), F.lit(1)).alias("w")).first()
    n, v, f = facts["n"], facts["v"], facts["f"]
    kinds = [("surface_ids", f"<U{max(1, facts['w'])}", (n,)), ("vertices", "<f8", (v, 3)), ("vertex_offsets", "<i8", (n + 1,)), ("faces", "<i8", (f, 3)), ("face_offsets", "<i8", (n + 1,)), ("grid_shapes", "<i8", (n, 2)), ("observation_rmse", "<f8", (n,))]
    members = {m.name: m for m in planned([Member(*k) for k in kinds])}
    placed = vertices.join(shapes.select(key, "columns", "vertex_offset"), key)
    last = shapes.sparkSession.createDataFrame([(n, v, f)], "number long, vertex_offset long, face_offset long")
    offsets = shapes.select("number", "vertex_offset", "face_offset").unionAll(last)
    rows = {
        "surface_ids": (shapes, [key]), "vertices": (placed.select((F.col("vertex_offset") + F.col("row") * F.col("columns") + F.col("col")).alias("number"), "inline", "profile", depth), ["inline", "profile", depth]),
        "vertex_offsets": (offsets, ["vertex_offset"]), "faces": (_faces(shapes, key), ["a", "b", "c"]), "face_offsets": (offsets, ["face_offset"]),
        "grid_shapes": (shapes, ["rows", "columns"]), "observation_rmse": (shapes, ["rmse"]),
    }
    staged = f"{path}.writing"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(staged, "wb") as out:
        out.truncate(members["observation_rmse"].end)
    crcs = {}
    for name, m in members.items():
        crc = zlib.crc32(m.head())
        for part in write_rows(*rows[name], m, staged, chunk).orderBy("chunk").collect():  # one row a chunk
            crc = joined_crc(crc, part["crc"], part["length"])
        crcs[name] = crc
    with open(staged, "r+b") as out:
        for name, m in members.items():
            out.seek(m.at)
            out.write(m.local(crcs[name]))
        out.seek(0, os.SEEK_END)
        begin = out.tell()
        directory = b"".join(m.central(crcs[name]) for name, m in members.items())
        k, size = len(members), len(directory)
        out.write(directory + END64 + struct.pack("<Q2H2L4Q", 44, VERSION, VERSION, 0, 0, k, k, size, begin))
        out.write(LOCATOR + struct.pack("<LQL", 0, begin + size, 1) + END + struct.pack("<4H2LH", 0, 0, k, k, LARGE, LARGE, 0))
    os.replace(staged, path)
    return {"surfaces": n, "vertices": v, "faces": f}
