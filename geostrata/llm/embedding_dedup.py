"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors link if their distance is at most eps, which a cosine threshold fixes. They are projected on
leading principal axes and laid into a grid of cells eps wide. In the order of (label, cell, cell, ...) the
sequence is cut into blocks of bounded size; two blocks are joined only if they share a label and their boxes
on the principal axes are within eps, as distances on some axes never exceed the whole. A block is sent once to
a task and meets up to PARTNERS others there, one after another. Within a pair of blocks the two intervals are
halved in turn and halves that are provably distant skipped; what is left is compared exactly. Equal vectors are
one node with a weight, and a pair of blocks gives link counts and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import connected_components, drop_saved, saved
from geostrata.llm.vectors import common_size, matrix, usable

THRESHOLD = 0.93
AXES, BLOCK, LEAF, SLACK = 8, 4096, 64, 1e-9
#: Blocks that a block meets in one task.
PARTNERS = 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(rows: DataFrame, d: int, axes: int = AXES) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the unit vectors of rows' x: d*d sums per task, added on the driver's side of one aggregate."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for x in frames:
            if len(x):
                u = unit(matrix(x["x"]))
                n, total, square = n + len(u), total + u.sum(0), square + u.T @ u
        flat = np.concatenate([[n], total, square.ravel()])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    got = rows.select("x").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # 1 + d + d * d rows
    flat = np.array([x["v"] for x in got]) if got else np.zeros(1 + d + d * d)
    n = max(1.0, flat[0])
    mean = flat[1 : 1 + d] / n
    spread = flat[1 + d :].reshape(d, d) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(spread)
    return mean, vectors[:, ::-1][:, : min(axes, d)]


def projected(u: np.ndarray, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Unit vectors on the principal axes, or on their first components where they are of another size: distances never grow. Missing axes are 0."""
    mean, axes = fitted
    p = (u - mean) @ axes if u.shape[1] == len(mean) else u[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _gap(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of the boxes of two sets of projected points."""
    apart = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt((apart * apart).sum()))


def join_intervals(u: np.ndarray, p: np.ndarray, v: np.ndarray, q: np.ndarray, eps: float, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between two intervals; each pair once, and no self-pairs, if they are the same interval."""
    stack = [(0, len(u), 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if same and d <= a or _gap(p[a:b], q[c:d]) > eps + SLACK:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(u[a:b] @ v[c:d].T >= threshold)
            i, j = i + a, j + c
            keep = i < j if same else slice(None)
            yield i[keep], j[keep]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links, each to its component's smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            parent[max(r, s)] = min(r, s)
    return [(root(x), x) for x in list(parent) if root(x) != x]


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component): links with cosine >= threshold within a label, and the smallest key that links reach.

    Vectors that are null, empty, zero or not finite, and those with a null label, link with nothing; vectors of
    different sizes never link. A row with a null key has no links and a null component. Rows that repeat a key
    count as vectors of their own with the same name. Other columns are left out, whatever their names; an empty
    table gives no rows. Cosines are taken in double precision of the vectors as given.
    """
    spark = rows.sparkSession
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    kind, bytes_of = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("x"), F.col(label).cast("string").alias("label"))
    fits = F.coalesce(F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")), F.lit(False))
    good = rows.where(fits).withColumn("same", F.sha2(F.concat_ws(",", F.length("label").cast("string"), "label", F.col("x").cast("array<string>")), 256))
    nodes = good.groupBy("same").agg(F.min("key").alias("node"), F.count("*").alias("weight"), F.min("label").alias("label"), F.min("x").alias("x"))
    nodes = saved(nodes.withColumn("group", F.concat_ws(":", F.size("x").cast("string"), "label")), "vectors")
    d, _ = common_size(nodes, "x")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    width = max(eps, 1e-6)
    shared = spark.sparkContext.broadcast(principal_axes(nodes.where(F.size("x") == d), max(1, d)))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                p = np.zeros((len(x), AXES))
                sizes = x["x"].map(len).to_numpy()
                for size in np.unique(sizes).tolist():
                    at = sizes == size
                    p[at] = projected(unit(matrix(x.loc[at, "x"])), shared.value)
                yield x.assign(p=list(p), cells=list(np.floor(p / width).astype(np.int64)))

    columns = "node long, weight long, group string, x " + kind
    placed = nodes.select("node", "weight", "group", "x").mapInPandas(project, columns + ", p array<double>, cells array<long>")
    order = ["group", "cells", "node"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for x in frames:
            x = x if held is None else pd.concat([held, x])
            at = 0
            while at < len(x):
                some = x.iloc[at : at + BLOCK]
                some = some[some["group"] == some["group"].iloc[0]]
                if at + len(some) == len(x):
                    break
                at += len(some)
                yield _block(some)
            held = x.iloc[at:] if at < len(x) else None
        if held is not None and len(held):
            yield _block(held)

    def _block(x: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(x["p"])
        packed = [np.ascontiguousarray(c).tobytes() for c in (x["node"].to_numpy(np.int64), x["weight"].to_numpy(np.int64), np.stack(x["x"]).astype(bytes_of))]
        return pd.DataFrame({"block": [int(x["node"].iloc[0])], "group": [x["group"].iloc[0]], "low": [p.min(0).tolist()], "high": [p.max(0).tolist()], "nodes": [packed[0]], "weights": [packed[1]], "vectors": [packed[2]]})

    schema = "block long, group string, low array<double>, high array<double>, nodes binary, weights binary, vectors binary"
    cut = saved(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(blocks, schema), "vector-blocks")
    span = lambda axis, more: F.explode(F.sequence(F.floor(F.col("low")[axis] / width) - more, F.floor(F.col("high")[axis] / width) + more))
    cell = cut.select("group", "block", "low", "high").withColumn("c0", span(0, 1)).withColumn("c1", span(1, 1))
    own = cut.select("group", "block", "low", "high").withColumn("c0", span(0, 0)).withColumn("c1", span(1, 0)).select("group", "c0", "c1", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = F.zip_with(F.zip_with("low", "high2", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with("low2", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: F.greatest(a, b))
    close = F.aggregate(F.transform(apart, lambda x: x * x), F.lit(0.0), lambda s, x: s + x) <= (eps + SLACK) ** 2
    pairs = saved(cell.join(own, ["group", "c0", "c1"]).where("block <= other").where(close).select("block", "other").distinct(), "block-pairs")
    hand = F.pmod(F.xxhash64("other"), F.ceil(F.count("*").over(Window.partitionBy("block")) / PARTNERS)).alias("hand")
    hands = saved(pairs.select("block", "other", hand), "hands")
    data = cut.select(F.col("block").alias("other"), "nodes", "weights", "vectors")
    first = hands.select("block", "hand").distinct().join(data.withColumnRenamed("other", "block").hint("merge"), "block").select("block", "hand", F.lit(None).cast("long").alias("other"), "nodes", "weights", "vectors")
    then = hands.join(data.hint("merge"), "other").select("block", "hand", "other", "nodes", "weights", "vectors")
    met = first.union(then).repartition("block", "hand").sortWithinPartitions("block", "hand", F.col("other").asc_nulls_first())

    def opened(x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        nodes = np.frombuffer(x.nodes, np.int64)
        u = unit(np.frombuffer(x.vectors, bytes_of).reshape(len(nodes), -1).astype(np.float64))
        return nodes, np.frombuffer(x.weights, np.int64), u, projected(u, shared.value)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = None
        for frame in frames:
            for x in frame.itertuples(index=False):
                if pd.isna(x.other):
                    mine = opened(x)
                    continue
                same = x.block == x.other
                (a, wa, u, p), (b, wb, v, q) = mine, mine if same else opened(x)
                ca, cb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                edges: list[tuple[int, int]] = []
                for i, j in join_intervals(u, p, v, q, eps, threshold, same):
                    ca += np.bincount(i, wb[j], len(a)).astype(np.int64)
                    cb += np.bincount(j, wa[i], len(b)).astype(np.int64)
                    edges += _forest(a[i], b[j])
                edges = _forest(*(np.array(c, np.int64) for c in zip(*edges, strict=True))) if edges else []
                if same:
                    ca, cb = ca + cb, cb[:0]
                counted = np.concatenate([ca, cb])
                nodes = a if same else np.concatenate([a, b])
                hit = counted > 0
                yield pd.DataFrame({"node": np.concatenate([nodes[hit], [y for _, y in edges]]).astype(np.int64), "links": np.concatenate([counted[hit], np.zeros(len(edges))]).astype(np.int64), "to": pd.array([None] * int(hit.sum()) + [x for x, _ in edges], dtype="Int64")})

    met = saved(met.mapInPandas(compare, "node long, links long, to long"), "vector-links")
    drop_saved(cut)
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(met.where(F.col("to").isNotNull()).select(F.col("to").alias("a"), F.col("node").alias("b")))
    named = nodes.select("same", "node", "weight").join(counts, "node", "left").join(component, "node", "left")
    named = saved(named.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vector-classes")
    linked = good.select("key", "same").join(named, "same").select("key", "n_links", "component")
    return linked.unionAll(rows.where(~fits).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
