"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each visit fits a shallow tree on one feature's bins to the
current logistic gradients and adds its leaves to that feature's lookup table. Once the single features are
fitted, the pairs that explain most of what is left get tables of their own in the same way. A text's score
is a sum of table entries, one vectorised addition per feature and pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import small_batches, training_rows

#: Bounds and parameters of the fit.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 80, 0.1, 4.0
FEATURES = [
    "log_bytes", "log_words", "word_length", "distinct_words", "upper", "punctuation", "symbols", "digits", "non_ascii",
    "repeated_lines", "words_per_line", "short_words", "capitalised", "bangs", "bars", "compressed", "entropy", "symbol_words", "distinct_pairs", "spaces",
]
_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "punctuation": np.isin(_BYTES, list(b".,;:'\"()-")),
    "symbols": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~")),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "non_ascii": _BYTES >= 128,
    "bangs": np.isin(_BYTES, list(b"!?")),
    "bars": _BYTES == 124,
    "spaces": np.isin(_BYTES, [9, 10, 13, 32]),
}
_SYMBOL_ENDS = frozenset("#$%&*+/<=>@[]^_`{}~|!?")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES; of an empty or null text, zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    n, total = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {k: float(counts[v].sum()) / n for k, v in _IS.items()}
    p = counts[counts > 0] / n
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, total)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(np.log1p(total)), float(lengths.mean()), len(set(words)) / total, share["upper"], share["punctuation"], share["symbols"], share["digits"], share["non_ascii"],
        1 - len(set(lines)) / max(1, len(lines)), min(1000.0, total / max(1, len(lines))), float((lengths <= 3).mean()), sum(map(str.isupper, (x[0] for x in words))) / total, share["bangs"], share["bars"], len(zlib.compress(raw, 1)) / n, float(-(p * np.log2(p)).sum()), sum(x[-1] in _SYMBOL_ENDS for x in words) / total, pairs / max(1, total - 1), share["spaces"],
    ]


@dataclass
class AdditiveModel:
    """edges: inner bin limits of each feature; tables: scores by bin; pairs: (i, j, limits of i, limits of j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of x."""
        z = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _limits(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.empty(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of the best tree of the depth over ordered bins, from sums of gradients and curvatures."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    if depth and len(g) > 1:
        gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        cut = int(np.argmax(gains))
        if gains[cut] > _gain(cg[-1], ch[-1]) + 1e-9:
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1)])
    return np.full(len(g), _leaf(cg[-1], ch[-1]))


def _tree_of_two(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of the best tree over a table of two features' bins: a cut of one, then a cut of the other on either side."""
    best, out = -1.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            halves, gain = [], 0.0
            for part, weight in ((a[:cut], b[:cut]), (a[cut:], b[cut:])):
                column = _tree(part.sum(0), weight.sum(0), 1)
                gain += float((column * part.sum(0)).sum())
                halves.append(np.broadcast_to(column, part.shape))
            if gain > best:
                best, out = gain, np.concatenate(halves).T if flip else np.concatenate(halves)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits the model to rows x with labels y (0 or 1). With no rows every score is 0.5; with one label, near it."""
    if not len(x):
        return AdditiveModel(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    edges = [_limits(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(x), start)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(b, y - p, len(tables[k])), np.bincount(b, p * (1 - p), len(tables[k])))
            tables[k] += step
            z += step[b]
    coarse = [_limits(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-z))
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            m, n = len(coarse[i]) + 1, len(coarse[j]) + 1
            at = cells[i] * n + cells[j]
            g, h = np.bincount(at, y - p, m * n).reshape(m, n), np.bincount(at, p * (1 - p), m * n).reshape(m, n)
            found.append((float((_tree_of_two(g, h) * g).sum()), i, j))
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            at = cells[i] * table.shape[1] + cells[j]
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(at, y - p, table.size).reshape(table.shape), np.bincount(at, p * (1 - p), table.size).reshape(table.shape)
            step = RATE * _tree_of_two(g, h)
            table += step
            z += step.ravel()[at]
    return AdditiveModel(start, edges, tables, pairs)


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features) of every row. Nulls, empty and very long texts, ties and repeated rows each keep their row; other columns are left out."""

    small_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"].astype("Int64"), "features": [features(x) for x in frame["text"]]})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, "key long, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on at most `rows` labelled keys that may be learned from, the first by a hash of the key.

    A key with several labels counts by the largest, a key of several texts by the one with the smallest features;
    labels other than 0 and 1 and null keys are left out. Null and empty texts, and whole texts of any length,
    are learned from alike; other columns are left out. With no labelled row every score is 0.5.
    """
    good = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & training_rows(F.col(key)))
    chosen = good.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(label).cast("int").alias("__label")).orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    got = with_features(texts.join(F.broadcast(chosen.select("key")), "key", "left_semi"), "key", "text").join(F.broadcast(chosen), "key")  # at most `rows` keys
    data = got.groupBy("key").agg(F.min("features").alias("features"), F.max("__label").alias("__label")).orderBy("key").toPandas()  # at most `rows` keys
    x = np.array(data["features"].tolist(), float).reshape(len(data), len(FEATURES))
    return fit_additive(x, data["__label"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of docs, by its whole text alone, however long; a null text scores as an empty one.

    Null and repeated keys keep their rows; other columns are left out, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([features(t) for t in frame["text"]], float).reshape(len(frame), len(FEATURES))
            yield pd.DataFrame({"key": frame["key"].astype("Int64"), "score": shared.value.score(x)})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, "key long, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose score is at least the threshold. Rows are judged each for itself, whatever their keys and other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(shared.value.score(x))

    return docs.where(score(F.col(text).cast("string")) >= threshold)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select(F.col("key").alias("doc_id"), (~training_rows(F.col("key"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
