"""Shared helpers of the training-data operators: shared storage, word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.storage import shared_dir

#: Entries after which a task's word cache is emptied, so that its memory stays bounded.
CACHE_WORDS = 100_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Bits of a bitmap of ids; a power of 2.
FILTER_BITS = 1 << 24


def new_path(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def with_maybe(rows: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """rows with `maybe`: true where column `by` is among ids (one column), and rarely elsewhere, so that other rows need not be shuffled to be left out.

    A bitmap of FILTER_BITS hashed ids, FILTER_BITS / 64 rows at most, is broadcast; where many ids fill it, it
    is true of more rows, and the exact step that follows decides.
    """
    at = F.pmod(F.xxhash64(by), F.lit(FILTER_BITS))
    word, bit = F.floor(at / 64), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{by}`), 64) as int))")
    marked = ids.select(F.col(ids.columns[0]).alias(by)).select(word.alias("__word"), bit.alias("__bit"))
    bitmap = saved(marked.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), "bitmap")
    asked = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(bitmap), "__word", "left")
    return asked.withColumn("maybe", F.coalesce(F.expr("(__bits & __bit) <> 0"), F.lit(False)) & F.col(by).isNotNull()).drop("__word", "__bit", "__bits")


def training_rows(doc_id) -> "F.Column":
    """True where crc32(doc_id as text) mod 5 is not 0: rows that a model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, and the byte: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordHashes(dict):
    """64-bit hashes of byte words, kept for words seen again; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@functools.cache
def word_hashes() -> WordHashes:
    """One cache for all operators and tasks that a Python worker runs."""
    return WordHashes()


_MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, width: int, base: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each run of width words, by a polynomial in an odd base."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + word_hashes[k : k + n]
    return mixed(out)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS rows from now on, unless the session has a number of its own: some are long, and a batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def tidy() -> None:
    """Gives memory that a task has freed back to the system: a worker outlives its tasks, and each operator's leftovers would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches.

    Each node points to its smallest neighbour or itself; pointers are followed to their ends by doubling,
    the edges are drawn anew between the ends, and what is left of them goes the same way, until none is.
    Every round at least halves the nodes; stars, as most groups of copies are, take one. Neighbours are
    only aggregated and joined, so no hub's are gathered in one task. Null ends are ignored; repeated edges
    are harmless, and a self-loop makes a component of one.
    """
    left = saved(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct(), "edges")
    levels = []
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        ends = saved(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("end")), "ends")
        while True:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("far"))
            then = saved(ends.join(further, "end").select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")), "ends")
            moved = not then.where("moved").isEmpty()
            drop_saved(ends)
            ends = then
            if not moved:
                break
        levels.append(ends.select("node", "end"))
        drawn = left.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b")
        left = saved(drawn.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    out = levels[0].select("node", F.col("end").alias("component"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("node").alias("component"), "end"), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    return out
