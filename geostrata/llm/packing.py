"""Best-fit-decreasing packing of documents into windows of a fixed number of tokens.

Overlong documents are first cut into full windows; what is left of each is a piece shorter than a window.
Pieces are then packed longest first, each into the open window with the tightest room that still holds it,
found by a segment tree indexed by remaining capacity. As pieces of one length are alike, the plan is made
on the number of pieces by length: at most `window` counts, whatever the size of the corpus. The plan says,
for ranks of pieces of a length, which windows they fill from which offset; Spark ranks the pieces by length
(per task, then across tasks by their counts) and looks their places up. So all pieces of the corpus are
packed together, with no group of them in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.bytes_tokens import piece_encoder
from geostrata.llm.common import saved, small_batches, tidy

PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


class Capacities:
    """A segment tree over capacities 0..most that finds the smallest capacity, at least a given one, with open windows."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def put(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += change
            at //= 2

    def tightest(self, room: int) -> int:
        """The smallest capacity >= room that is open, or -1."""
        at = room + self.leaves
        if self.open[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """The plan for counts[length] pieces of each length from 1 to window.

    Rows (length, first rank, first sequence, pieces a sequence, offset): pieces from that rank on lie in
    the sequences from that one on, so many in each, one after another from the offset. Sequences are
    numbered from 0 in the order they are opened. Takes time by the number of rows, not of pieces.
    """
    tree, groups, plan, opened = Capacities(window), {}, [], 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = window // length
                room, first, n = window, opened, -(-left // each)
                opened += n
            else:
                first, n = groups[room].pop()
                tree.put(room, -1)
                each = room // length
            filled = min(n, left // each)
            if filled:
                plan.append((length, rank, first, each, window - room))
                rank, left = rank + filled * each, left - filled * each
                _keep(tree, groups, room - each * length, first, filled)
            if filled < n and left:
                plan.append((length, rank, first + filled, left, window - room))
                _keep(tree, groups, room - left * length, first + filled, 1)
                rank, left, filled = rank + left, 0, filled + 1
            if filled < n:
                _keep(tree, groups, room, first + filled, n - filled)
    return plan


def _keep(tree: Capacities, groups: dict, room: int, first: int, n: int) -> None:
    if room:
        groups.setdefault(room, []).append((first, n))
        tree.put(room, 1)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: none) and end_id, so every document has a piece. Rows with
    null or repeated keys are documents of their own. A very long text is cut into full windows and one
    shorter piece; pieces of equal length are ranked by task and then as they come, which a repeated task
    may do otherwise only before anything is placed, as the pieces are written first. Other columns are
    left out, whatever their names; an empty table gives no rows. sequence_id is dense from 0: sequences of several pieces first, then
    the full windows cut from overlong documents.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = piece_encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for frame in frames:
            for at in range(0, len(frame), 256):
                some, rows = frame.iloc[at : at + 256], []
                for doc, ids in zip(some["key"].tolist(), encoder.encode(some["text"].tolist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, part, nth))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    pieces = saved(rows.mapInPandas(cut, PIECE), "pieces")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_task = saved(by_task.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("earlier")), "piece-counts")
    counts = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    whole = counts.pop(window, 0)
    plan = np.array(best_fit_decreasing(counts, window) or [(0, 0, 0, 1, 0)], np.int64)
    used = int(max((s + -(-n // e) for s, n, e in _spans(plan, counts)), default=0))
    table = spark.sparkContext.broadcast((plan, used))  # bounded by the number of lengths, not by the corpus

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, used = table.value
        order = np.lexsort((plan[:, 1], plan[:, 0]))
        plan = plan[order]
        bounds = plan[:, 0] * (1 << 48) + plan[:, 1]
        for x in frames:
            length, rank = x["length"].to_numpy(np.int64), (x["nth"] + x["earlier"]).to_numpy(np.int64)
            row = plan[np.maximum(np.searchsorted(bounds, length * (1 << 48) + rank, "right") - 1, 0)]
            nth = rank - row[:, 1]
            full = length == window
            sequence = np.where(full, used + rank, row[:, 2] + nth // row[:, 3])
            offset = np.where(full, 0, row[:, 4] + nth % row[:, 3] * length)
            yield x.drop(columns=["nth", "earlier"]).assign(sequence_id=sequence, offset=offset)

    ranked = pieces.join(by_task.select("length", "part", "earlier").hint("merge"), ["length", "part"])  # as many rows as tasks times lengths: not to be broadcast
    ranked = ranked.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "nth", "earlier")
    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _spans(plan: np.ndarray, counts: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(first sequence, pieces, pieces a sequence) of each row of the plan."""
    rows = sorted(map(tuple, plan.tolist()))
    for k, (length, rank, first, each, _) in enumerate(rows):
        until = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts.get(length, 0)
        yield first, until - rank, each


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens, each document ended by id 1."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
