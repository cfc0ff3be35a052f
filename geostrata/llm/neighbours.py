"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Nearness by Euclidean distance is turned into an inner product: |q - x|^2 = |q|^2 - 2 (<q, x> - |x|^2 / 2).
Vectors are cut into small subspaces with 16 codewords each, so a code is four bits a subspace. Codebooks and
codes minimise an anisotropic loss: residual error parallel to the vector, which shifts the scores of just
those queries for which it ranks high, weighs `parallel` times as much as orthogonal error. A query's
products with all codewords form a table; a scan adds one entry per subspace. What a code leaves of its vector is
coded too, a byte a component, with an error some hundred times smaller. A row's distance differs from that to its
code by no more than the code's error: so the best by the four-bit scan bound the k-th distance from above, by
their codes of two stages, and only rows that neither code puts beyond that bound are ranked by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import drop_saved, saved
from geostrata.llm.vectors import common_size, few, matrix, usable

SAMPLE_ROWS, WIDTH, CODEWORDS, PARALLEL, ROUNDS = 10_000, 2, 16, 4.0, 8
#: Vectors a scan takes at once, queries in a block, and the best of a scan per neighbour asked for that bound the k-th distance.
SCAN_ROWS, QUERY_BLOCK, BEST = 8192, 4096, 12
#: Levels of a byte on either side of 0, for what a code leaves.
LEVELS = 127


@dataclass
class Quantiser:
    """books[m]: the 16 codewords of subspace m; parallel: the weight of residual error along a vector."""

    books: np.ndarray
    parallel: float

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows of x as (row, subspace, component), with zeros after the last component."""
        m, w = self.books.shape[0], self.width
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of the rows of x, one number from 0 to 15 a subspace, by coordinate descent on the anisotropic loss."""
        parts = self.cut(x)
        norms = np.maximum((x * x).sum(1), 1e-30)
        square = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3)
        along = np.einsum("nmw,nmcw->nmc", parts, parts[:, :, None, :] - self.books[None])
        codes = square.argmin(2)
        rows = np.arange(len(x))
        total = sum(along[rows, m, codes[:, m]] for m in range(codes.shape[1]))
        for _ in range(rounds):
            for m in range(codes.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                loss = square[:, m] + (self.parallel - 1) * (rest[:, None] + along[:, m]) ** 2 / norms[:, None]
                codes[:, m] = loss.argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Rows (row, component) that codes stand for, with zeros after the last component."""
        return self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)

    def leftover(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What codes leave of the rows of x, a signed byte a component, and the step of each row."""
        left = x - self.decode(codes)[:, : x.shape[1]]
        unit = np.maximum(np.abs(left).max(1, initial=0), 1e-300) / LEVELS
        return np.rint(left / unit[:, None]).astype(np.int8), unit

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with each codeword: (subspace, codeword, query)."""
        return np.einsum("qmw,mcw->mcq", self.cut(q), self.books)


def fit_quantiser(x: np.ndarray, width: int = WIDTH, parallel: float = PARALLEL, rounds: int = ROUNDS, seed: int = 7) -> Quantiser:
    """Codebooks for the rows of x: codes by the anisotropic loss, then for each subspace the codewords that minimise it given the other subspaces."""
    m = -(-max(1, x.shape[1]) // width)
    rng = np.random.default_rng(seed)
    books = np.zeros((m, CODEWORDS, width))
    model = Quantiser(books, parallel)
    if not len(x):
        return model
    parts = model.cut(x)
    books[:] = parts[rng.integers(0, len(x), CODEWORDS)].transpose(1, 0, 2)
    norms = np.maximum((x * x).sum(1), 1e-30)
    for _ in range(rounds):
        codes = model.encode(x, 1).astype(np.int64)
        residual = np.stack([(parts[:, j] * (parts[:, j] - books[j, codes[:, j]])).sum(1) for j in range(m)], 1)
        total = residual.sum(1)
        for j in range(m):
            rest = total - residual[:, j] + (parts[:, j] ** 2).sum(1)
            weight = (parallel - 1) / norms
            outer = parts[:, j, :, None] * parts[:, j, None, :] * weight[:, None, None] + np.eye(width)
            target = parts[:, j] * (1 + weight * rest)[:, None]
            left, right = np.zeros((CODEWORDS, width, width)), np.zeros((CODEWORDS, width))
            np.add.at(left, codes[:, j], outer)
            np.add.at(right, codes[:, j], target)
            full = np.bincount(codes[:, j], minlength=CODEWORDS) > 0
            books[j, full] = np.linalg.solve(left[full], right[full][:, :, None])[:, :, 0]
            books[j, ~full] = parts[rng.integers(0, len(x), int((~full).sum())), j]
            total = total - residual[:, j]
            residual[:, j] = (parts[:, j] * (parts[:, j] - books[j, codes[:, j]])).sum(1)
            total = total + residual[:, j]
    return model


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE_ROWS) -> tuple[DataFrame, Quantiser]:
    """(key, embedding, codes) of every usable row, and the quantiser, fitted on at most `sample` rows of the most common size, the first by a hash of the key.

    Null keys and vectors that are null, empty, zero or not finite take no part. Rows of another size than most
    have no codes and are searched exactly. Codes hold two subspaces a byte; `rest` codes what they leave, a byte a
    component in steps of `unit`. Other columns are left out, whatever
    their names; repeated keys keep their rows; an empty table gives an empty index.
    """
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("key").isNotNull() & usable(F.col("embedding")))
    d, n = common_size(rows, "embedding")
    some = few(rows.where(F.size("embedding") == d), "key", n, sample).orderBy(F.xxhash64("key"), "key").limit(sample).select("embedding").toPandas()
    model = fit_quantiser(np.array(some["embedding"].tolist(), float).reshape(len(some), max(1, d)))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            x = x.assign(codes=None, rest=None, unit=np.nan)
            fits = x["embedding"].map(len) == d
            if fits.any():
                held = matrix(x.loc[fits, "embedding"])
                codes = shared.value.encode(held)
                rest, x.loc[fits, "unit"] = shared.value.leftover(held, codes)
                x.loc[fits, "rest"] = pd.Series([r.tobytes() for r in rest], x.index[fits])
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                packed = (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)
                x.loc[fits, "codes"] = pd.Series([r.tobytes() for r in packed], x.index[fits])
            yield x

    return rows.mapInPandas(encode, "key long, embedding array<double>, codes binary, rest binary, unit double"), model


def _first_copies(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Rows but those with n or more equal vectors of smaller id in the block, which can't be among n - 1 nearest. Keeps ties whole where a vector occurs very often."""
    by_id = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[by_id]).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    sizes = np.bincount(same)
    nth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(by_id[order[nth < n]])


@dataclass
class Block:
    """Vectors of one size that are scanned together. x is in single precision where that holds every component exactly; codes, rest and unit are None for sizes without codes."""

    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray | None = None
    rest: np.ndarray | None = None
    unit: np.ndarray | None = None


def _scan(model: Quantiser, block: Block, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    """The k nearest rows of a block to each query, and how many rows were ranked exactly: no row that may be among the nearest is left out."""
    ids, x, codes = block.ids, block.x, block.codes
    tables, coarse = model.tables(queries), model.decode(codes)[:, : x.shape[1]]
    second = block.rest * block.unit[:, None]
    fine = coarse + second
    size = lambda v: np.sqrt((v * v).sum(1))
    coarse_error, fine_error = size(x - coarse), size(x - fine)
    coarse_square, fine_square, query_square = (coarse * coarse).sum(1), (fine * fine).sum(1), (queries * queries).sum(1)
    rounding = np.sqrt((x.shape[1] + 8) * 4e-15) * (np.sqrt(query_square) + np.sqrt(max(coarse_square.max(initial=0), fine_square.max(initial=0))))
    out, ranked = [], 0
    depth = min(len(x), k * BEST)
    step = max(1, (1 << 20) // max(1, len(x)))
    for a in range(0, len(queries), step):
        part = tables[:, :, a : a + step]
        product = np.zeros((len(x), part.shape[2]))
        for m in range(part.shape[0]):
            product += part[m][codes[:, m]]
        to_coarse = np.sqrt(np.maximum(coarse_square[:, None] - 2 * product + query_square[a : a + step], 0))
        product += second @ queries[a : a + step].T
        to_fine = np.sqrt(np.maximum(fine_square[:, None] - 2 * product + query_square[a : a + step], 0))
        best = np.argpartition(to_coarse, depth - 1, axis=0)[:depth] if depth else np.empty((0, part.shape[2]), np.int64)
        for j in range(part.shape[2]):
            qid, q, slack = query_ids[a + j], queries[a + j], rounding[a + j]
            others = best[ids[best[:, j]] != qid, j]
            near = np.flatnonzero(ids != qid)
            if len(others) >= k:
                reach = np.partition(to_fine[others, j] + fine_error[others], k - 1)[k - 1] + slack
                near = near[to_coarse[near, j] - coarse_error[near] <= reach + slack]
                bound = to_fine[near, j] + fine_error[near]
                reach = min(reach, np.partition(bound, k - 1)[k - 1] + slack)
                near = near[to_fine[near, j] - fine_error[near] <= reach + slack]
            ranked += len(near)
            distance = np.sqrt(((x[near] - q) ** 2).sum(1))
            order = np.lexsort((ids[near], distance))[:k]
            out.append((np.full(len(order), qid), ids[near[order]], distance[order]))
    q, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pd.DataFrame({"query_id": q, "vec_id": v, "score": s}), ranked


def _exactly(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of a block to each query, all distances taken."""
    out = []
    for qid, q in zip(query_ids, queries, strict=True):
        own = ids != qid
        distance = np.sqrt(((x[own] - q) ** 2).sum(1))
        order = np.lexsort((ids[own], distance))[:k]
        out.append(pd.DataFrame({"query_id": np.full(len(order), qid), "vec_id": ids[own][order], "score": distance[order]}))
    return pd.concat(out)


def _blocks(rows: pd.DataFrame, model: Quantiser, k: int) -> Iterator[tuple[int, Block]]:
    """(size, block) of index rows, as plain arrays."""
    sizes = rows["embedding"].map(len).to_numpy()
    for d in np.unique(sizes).tolist():
        some = rows[sizes == d]
        for at in range(0, len(some), SCAN_ROWS):
            part = some.iloc[at : at + SCAN_ROWS]
            keys, x = part["key"].to_numpy(), matrix(part["embedding"])
            kept = _first_copies(keys, x, k + 1)
            with np.errstate(over="ignore"):  # what is too large for it is kept in double precision
                single = x.astype(np.float32)
            x = single if (single == x).all() else x
            if part["codes"].iloc[0] is None:
                yield d, Block(keys[kept], x[kept])
                continue
            packed = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1)
            codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(part), -1)[kept, : len(model.books)]
            rest = np.frombuffer(b"".join(part["rest"]), np.int8).reshape(len(part), -1)
            yield d, Block(keys[kept], x[kept], codes, rest[kept], part["unit"].to_numpy()[kept])


def search(index: DataFrame, model: Quantiser, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index found for each query but the query's own row.

    Queries are written in blocks of about QUERY_BLOCK as files of the shared folder. A task holds its partition of the
    index, as large as spark.sql.files.maxPartitionBytes lets it be, as plain arrays, reads one block of queries
    after another and gives k rows a query for all of it. Ties go to the smaller key. Unusable queries have no
    rows; of repeated query keys the one with the smallest vector counts. Vectors are compared with those of their
    own size. Fewer rows than k give fewer neighbours; an empty index or no queries give none.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("embedding")).where(F.col("key").isNotNull() & usable(F.col("embedding")))
    asked = saved(asked.groupBy("key").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = saved(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK)), "key"), "query-blocks")
    drop_saved(asked)
    paths = sorted(blocks.inputFiles())  # one name a block

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for frame in frames for x in _blocks(frame, model, k)]
        for path in paths if held else []:
            asked = _read_block(path)
            long = asked["embedding"].map(len).to_numpy()
            found = []
            for d in np.unique(long).tolist():
                some = asked[long == d]
                ids, q = some["key"].to_numpy(), matrix(some["embedding"])
                for block in [b for size, b in held if size == d]:
                    found.append(_exactly(block.ids, block.x, ids, q, k) if block.codes is None else _scan(model, block, ids, q, k)[0])
            if found:
                best = pd.concat(found).sort_values(["query_id", "score", "vec_id"])
                yield best.groupby("query_id").head(k)

    found = index.mapInPandas(scan, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _read_block(path: str) -> pd.DataFrame:
    from pyarrow import fs, parquet

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as source:
        return parquet.read_table(source).to_pandas()


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose vec_id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index, model = build_index(rows)
    return search(saved(index, "vector-index"), model, rows.where(F.col("vec_id") % 100 == 0))
