"""Density clusters of points, block by block: each block sees its own points and those within 2 eps, and only what joins blocks is put together.

Within a block points are sorted into cells of side eps / sqrt 2. All points of a cell are neighbours, so those of a
cell with min_samples are core as a whole, and cells, not points, are the nodes of a block's clusters. A core
point within eps of a block is clustered there too, which tells what that block's clusters are one with. No pair
of neighbours leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators import blocks
from geostrata.operators.components import components
from geostrata.storage import cut_lineage

#: Pairs of points held at once.
PAIRS = 1 << 20
OFFSETS = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]


class _Cells:
    """Points in cells, sorted by cell: `order` has the points, cell k those from starts[k] up to starts[k + 1]."""

    def __init__(self, x: np.ndarray, z: np.ndarray, eps: float):
        width = eps / np.sqrt(2) * (1 - 1e-12)  # so that no two points of a cell are further apart than eps
        cx, cz = (np.floor(v / width).astype(np.int64) for v in (x, z))
        cx, cz = cx - cx.min() + 2, cz - cz.min() + 2
        self.x, self.z, self.limit, self.row = x, z, eps * eps, int(cz.max()) + 3
        code = cx * self.row + cz
        self.order = np.argsort(code, kind="stable")
        self.codes, starts = np.unique(code[self.order], return_index=True)
        self.starts = np.append(starts, len(x))
        self.cell = np.searchsorted(self.codes, code)
        self.sizes = np.diff(self.starts)

    def beside(self, cells: np.ndarray, offset: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Which of cells have a neighbour at the offset, by place, and the neighbours."""
        code = self.codes[cells] + offset[0] * self.row + offset[1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        there = np.flatnonzero(self.codes[at] == code)
        return there, at[there]

    def near(self, points: np.ndarray, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(k, q): for places k of points and cells, taken side by side, the points q of cells[k] within eps of points[k]."""
        ends = np.cumsum(self.sizes[cells])
        at = 0
        while at < len(points):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            sizes = self.sizes[cells[at:to]]
            k = np.repeat(np.arange(at, to), sizes)
            q = self.order[np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[cells[k]]]
            dx, dz = self.x[points[k]] - self.x[q], self.z[points[k]] - self.z[q]
            good = dx * dx + dz * dz <= self.limit
            yield k[good], q[good]
            at = to


def _core(c: _Cells, min_samples: int, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted points have min_samples points within eps, themselves included."""
    core = wanted & (c.sizes[c.cell] >= min_samples)
    rest = np.flatnonzero(wanted & ~core)
    count = c.sizes[c.cell[rest]].copy()
    for offset in OFFSETS:
        if offset != (0, 0):
            here, there = c.beside(c.cell[rest], offset)
            for k, _ in c.near(rest[here], there):
                count += np.bincount(here[k], minlength=len(rest))
    core[rest[count >= min_samples]] = True
    return core


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        then = root.copy()
        np.minimum.at(then, root[a], low)
        np.minimum.at(then, root[b], low)
        while (up := then[then]).tobytes() != then.tobytes():
            then = up
        if (then == root).all():
            return root
        root = then


def cluster_block(x: np.ndarray, z: np.ndarray, pid: np.ndarray, own: np.ndarray, edge: np.ndarray, eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(points, core, roots): own points, and the core ones of `edge`, with the smallest core pid of each of this block's clusters that they are in or, if not core, next to.

    edge are the points within eps of the block; all points within 2 eps of it must be given.
    """
    c = _Cells(x, z, eps)
    core = _core(c, min_samples, own | edge)
    inside = np.flatnonzero(core)
    cells = np.unique(c.cell[inside])
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for offset in [o for o in OFFSETS if o > (0, 0)]:
        here, there = c.beside(c.cell[inside], offset)
        for k, q in c.near(inside[here], there):
            k, q = k[core[q]], q[core[q]]
            pairs = np.unique(c.cell[inside[here[k]]] * len(c.codes) + c.cell[q])
            links.append((pairs // len(c.codes), pairs % len(c.codes)))
    a, b = (np.concatenate([x[s] for x in links]) if links else np.empty(0, np.int64) for s in (0, 1))
    root = _joined(len(cells), np.searchsorted(cells, a), np.searchsorted(cells, b))
    least = np.full(len(cells), np.iinfo(np.int64).max)
    np.minimum.at(least, root[np.searchsorted(cells, c.cell[inside])], pid[inside])
    name = np.zeros(len(c.codes), np.int64)  # of a cell's cluster
    name[cells] = least[root]
    bare = np.flatnonzero(own & ~core)
    beside: list[np.ndarray] = []
    for offset in OFFSETS:
        here, there = c.beside(c.cell[bare], offset)
        for k, q in c.near(bare[here], there):
            k, q = k[core[q]], q[core[q]]
            beside.append(np.unique(np.stack([here[k], name[c.cell[q]]], axis=1), axis=0))
    told = np.unique(np.concatenate([*beside, np.empty((0, 2), np.int64)]), axis=0)
    roots = np.split(told[:, 1], np.searchsorted(told[:, 0], np.arange(1, len(bare)))) if len(bare) else []
    return np.concatenate([inside, bare]), np.append(np.ones(len(inside), bool), np.zeros(len(bare), bool)), [*name[c.cell[inside]][:, None], *roots]


def local_clusters(points: DataFrame, eps: float, min_samples: int, key: str, side: int = blocks.SIDE) -> DataFrame:
    """(key, pid, own, core, roots) of cluster_block for all blocks: one row for each point in its own block, and one for each core point within eps of another. points: (key, pid, x, z)."""
    rows = points.select(key, F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    kind = rows.schema[key].dataType.simpleString()

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, z, pid = part["x"].to_numpy(), part["z"].to_numpy(), part["pid"].to_numpy()
        away = np.maximum(*[np.maximum(b * side - v, v - (b + 1) * side) for v, b in ((x, group[1]), (z, group[2]))])  # beyond the block, if not negative
        own = (np.floor(x / side) == group[1]) & (np.floor(z / side) == group[2])
        at, core, roots = cluster_block(x, z, pid, own, ~own & (away <= eps), eps, min_samples)
        return pd.DataFrame({key: [group[0]] * len(at), "pid": pid[at], "own": own[at], "core": core, "roots": pd.Series(roots, dtype=object)})

    dealt = blocks.dealt(rows, 2 * eps, side)
    return cut_lineage(dealt.groupBy(key, "bx", "bz").applyInPandas(run, f"{key} {kind}, pid long, own boolean, core boolean, roots array<long>"))


def joined_roots(found: DataFrame, key: str) -> DataFrame:
    """(key, root, cluster): each block's clusters by the smallest core pid of all that they are one with."""
    home = found.where("own and core").select(key, "pid", F.col("roots")[0].alias("home"))
    away = found.where("not own").select(key, "pid", F.col("roots")[0].alias("there"))
    every = home.select(key, F.col("home").alias("a"), F.col("home").alias("b")).distinct()
    edges = every.unionAll(away.join(home, [key, "pid"]).select(key, "home", "there").distinct())
    return components(edges, key).select(key, F.col("node").alias("root"), F.col("component").alias("cluster"))
