"""Removal of long repeated word runs, found through difference-cover anchors.

A difference cover D of a period v holds, for any two positions i and j, some shift below v that takes both
into D modulo v. So if only windows of w - v + 1 words that start at positions in D modulo v are hashed, any
two equal runs of w words still share an anchor that is aligned in both. Anchors that occur once rule out
every run around them; the runs of w words around the others are hashed in full, and each that also starts
earlier is a repeat: the match is extended to the whole window by a hash of 96 bits of its words. Hashes travel
in packed blocks by bucket of the hash, the answers in packed blocks by bucket of the document. Before anything
is sent, a task merges what repeats within it, so a passage that occurs in a third of all documents costs a
bucket one entry per sender. Only documents that an answer names are shuffled with it, and their texts are
streamed. No pairs of documents are formed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import drop_saved, saved, small_batches, tidy, window_hashes, with_maybe, word_hashes

WINDOW = 20
#: Difference covers by period.
COVERS = {13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}
CHUNK_WORDS, SLICE_ROWS = 1_000_000, 64
NO_KEY = 1 << 40
ADDED = ["n_words", "n_removed", "kept"]
#: The base of the second polynomial; with 32 bits of it a window's hash has 96 bits.
OTHER_BASE = 0xC2B2AE3D27D4EB4F
BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
BLOCK_SQL = "bucket int, block binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least 8 words, or the window itself."""
    return next((v, c) for v, c in COVERS.items() if v == 1 or window - v + 1 >= 8)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but blanks and 0x09 to 0x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _packed(*columns: np.ndarray) -> bytes:
    body = b"".join(x.tobytes() for x in columns)
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(8, "little") + body)


def _unpacked(block: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of a packed block; kind "steps" holds 64-bit integers as differences."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        column = np.frombuffer(raw, "<i8" if kind == "steps" else kind, n, at)
        at += column.nbytes
        out.append(np.cumsum(column) if kind == "steps" else column)
    return out


def _gathered(blocks: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [_unpacked(x, *kinds) for x in blocks]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, "<i8" if k == "steps" else k) for k in kinds]


def _places(blocks: list[bytes]) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """The places that a bucket's answers name: for each document its range, and the positions, sorted."""
    doc, at = _gathered(blocks, "steps", "<u4")
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    last = np.append(first, len(doc))[1:]
    return {d: (a, b) for d, a, b in zip(doc[first].tolist(), first.tolist(), last.tolist(), strict=True)}, at


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def _asked(h: list[np.ndarray], doc: np.ndarray, at: np.ndarray, n: int, *kinds: str) -> list[tuple[int, bytes]]:
    """Blocks by bucket of the hash: parts of the hash as kinds, document and position, in order of both."""
    bucket = ((h[0] >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((at, doc, bucket))
    h, doc, at, bucket = [x[order] for x in h], doc[order], at[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return [(k, _packed(*(x[a:b].astype(kind) for x, kind in zip(h, kinds, strict=True)), _steps(doc[a:b]), at[a:b].astype("<u4"))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _answered(doc: np.ndarray, at: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Blocks of (document, position) by bucket of the document."""
    bucket = doc_bucket(doc, n)
    order = np.lexsort((at, doc, bucket))
    doc, at, bucket = doc[order], at[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    return [(k, _packed(_steps(doc[a:b]), at[a:b].astype("<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """crc32 of the document's key as text, mod n, as Spark computes it too."""
    keys, back = np.unique(doc, return_inverse=True)
    return np.array([zlib.crc32(str(x).encode()) % n for x in keys.tolist()], np.int64)[back]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], schema=BLOCK)


def _by_block(asked: DataFrame, answer, pass_on: int) -> DataFrame:
    """Runs answer on each bucket's blocks and lays the answers out by bucket of the document. Buckets from pass_on on hold answers already made."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= pass_on:
            return pa.table({"bucket": pa.array([bucket - pass_on] * len(table), pa.int32()), "block": table["block"]}).cast(BLOCK)
        return pa.Table.from_batches([_batch(answer(table["block"].to_pylist()))])

    return saved(asked.groupBy("bucket").applyInArrow(run, BLOCK_SQL).repartition(pass_on, "bucket").sortWithinPartitions("bucket"), "repeats")


def _first_of(h: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by hash (its parts), document and position: (order, for each sorted entry the index of its hash's first entry)."""
    order = np.lexsort((at, doc, *h[::-1]))
    if not len(order):
        return order, np.empty(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for part in h:
        s = part[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


def _slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(bucket, whether these are texts, rows), in the order of the rows."""
    for batch in batches:
        bucket, texts = batch["bucket"].to_numpy(), batch["texts"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (texts[1:] != texts[:-1]), [True]])) if len(batch) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[a]), bool(texts[a]), batch.slice(int(a), int(b - a))


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, tuple[int, int]], np.ndarray, pa.RecordBatch]]:
    """Slices of texts, each with the places that its bucket's answers name; these come first in the bucket, and only they are held."""
    at, blocks, places = None, [], None
    for bucket, texts, run in _runs(batches):
        if bucket != at:
            at, blocks, places = bucket, [], None
        if not texts:
            blocks += run["block"].to_pylist()
            continue
        if places is None:
            places = _places(blocks)
        for some in _slices(run):
            yield *places, some


def _named(answers: DataFrame) -> DataFrame:
    """(key): the documents that the answers name, about once each, as the blocks of a bucket lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.int64)
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"], strict=True):
                if bucket != at:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], names=["key"])
                    at, held = bucket, np.empty(0, np.int64)
                held = np.union1d(held, _unpacked(block.as_py(), "steps", "<u4")[0])
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["key"])

    return answers.mapInArrow(run, "key long")


def _laid_out(texts: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Texts and answers by bucket of the document, a bucket's answers before its texts."""
    bucket = (F.crc32(F.col("key").cast("string").cast("binary")) % n).cast("int").alias("bucket")
    both = texts.select("*", bucket, F.lit(True).alias("texts")).unionByName(answers.withColumn("texts", F.lit(False)), allowMissingColumns=True)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "texts")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """docs' columns and n_words, n_removed, kept: the words no window of which starts earlier, joined by one space.

    A window is `window` consecutive words of one document; it goes if the same words also start in a
    document with a smaller key, or earlier in the same one. Words are case-sensitive and as in the input.
    A null or empty text has no words and an empty `kept`. Rows with a null key come after all others, in an
    order of their texts' hashes, so keys within NO_KEY of the largest long are not to be used. Rows that
    repeat a key at the same position, and rows without a key and of equal text, don't remove each other, so
    no passage is lost. A very long text is read whole, by one task at a time. A column that has one of the
    added names is replaced, whatever other columns are called. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    period, cover = cover_for(window)
    span = window - period + 1
    late = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(NO_KEY))
    others = [c for c in docs.columns if c not in (text, *ADDED)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.lit(0).alias("none")).alias("row"), F.coalesce(F.col(key).cast("long"), late).alias("key"), F.col(text).cast("string").alias("text"))
    starts = np.zeros(period, bool)
    starts[list(cover)] = True

    def joined(held: list[tuple]) -> list[np.ndarray]:
        """Hash parts, documents and positions of (document, positions, hash parts) entries."""
        doc = np.concatenate([np.full(len(at), d, np.int64) for d, at, *_ in held])
        return [doc, *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def flush() -> pa.RecordBatch:
            doc, at, h = joined(held)
            order, first = _first_of([h], doc, at)
            size = np.bincount(first, minlength=len(h))[first]
            known = order[size > 1]
            one = order[first == np.arange(len(first))]
            return _batch(_asked([h[one]], doc[one], at[one], n, "<u4") + [(n + k, b) for k, b in _answered(doc[known], at[known], n)])

        for some in (x for batch in batches for x in _slices(batch)):
            for doc, t in zip(some["key"].to_pylist(), some["text"].to_pylist(), strict=True):
                w = split_words(t)
                if len(w) >= window:
                    at = np.flatnonzero(np.resize(starts, len(w) - span + 1))
                    held.append((doc, at, window_hashes(word_hashes().of(w), span)[at]))
                    words += len(w)
            if words >= CHUNK_WORDS:
                yield flush()
                held, words = [], 0
        if held:
            yield flush()
        held.clear()
        tidy()

    def repeated(blocks: list[bytes]) -> list[tuple[int, bytes]]:
        h, doc, at = _gathered(blocks, "<u4", "steps", "<u4")
        order, first = _first_of([h], doc, at)
        hit = order[np.bincount(first, minlength=len(h))[first] > 1] if len(h) else order
        return _answered(doc[hit], at[hit], n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def flush() -> pa.RecordBatch:
            doc, at, h, more = joined(held)
            order, first = _first_of([h, more], doc, at)
            d, p = doc[order], at[order]
            late = (d != d[first]) | (p != p[first])
            one = order[first == np.arange(len(first))]
            return _batch(_asked([h[one], more[one]], doc[one], at[one], n, "<u8", "<u4") + [(n + k, b) for k, b in _answered(d[late], p[late], n)])

        for ends, at, some in _with_places(batches):
            for d, t in zip(some["key"].to_pylist(), some["text"].to_pylist(), strict=True):
                w = split_words(t) if d in ends else []
                if len(w) < window:
                    continue
                a, b = ends[d]
                near = np.zeros(len(w) + 1, np.int64)
                np.add.at(near, np.clip(at[a:b] - period + 1, 0, len(w)), 1)
                np.add.at(near, np.minimum(at[a:b] + 1, len(w)), -1)
                begin = np.flatnonzero(np.cumsum(near)[: len(w) - window + 1] > 0)
                h = word_hashes().of(w)
                held.append((d, begin, window_hashes(h, window)[begin], window_hashes(h, window, OTHER_BASE)[begin] >> np.uint64(32)))
                words += len(w)
            if words >= CHUNK_WORDS:
                yield flush()
                held, words = [], 0
        if held:
            yield flush()
        held.clear()
        tidy()

    def later(blocks: list[bytes]) -> list[tuple[int, bytes]]:
        h, more, doc, at = _gathered(blocks, "<u8", "<u4", "steps", "<u4")
        order, first = _first_of([h, more], doc, at)
        d, p = doc[order], at[order]
        late = (d != d[first]) | (p != p[first])
        return _answered(d[late], p[late], n)

    def cut(some: pa.RecordBatch, ends: dict[int, tuple[int, int]], at: np.ndarray) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        for d, t in zip(some["key"].to_pylist(), some["text"].to_pylist(), strict=True):
            w = split_words(t)
            counts.append(len(w))
            if d in ends:
                a, b = ends[d]
                begin = at[a:b]
                begin = begin[begin <= len(w) - window]
                gone = np.zeros(len(w) + 1, np.int64)
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + window, -1)
                left = np.cumsum(gone)[: len(w)] == 0
                w = [w[k] for k in np.flatnonzero(left).tolist()]
            removed.append(counts[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([some["row"], some["text"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "text", *ADDED])

    def cut_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (cut(some, ends, at) for ends, at, some in _with_places(batches))
        tidy()

    def cut_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (cut(some, {}, np.empty(0, np.int64)) for batch in batches for some in _slices(batch))
        tidy()

    hits = _by_block(rows.select("key", "text").mapInArrow(anchors, BLOCK_SQL), repeated, n)
    asked = _laid_out(with_maybe(rows.select("key", "text"), _named(hits), "key").where("maybe").drop("maybe"), hits, n).mapInArrow(windows, BLOCK_SQL)
    repeats = _by_block(asked, later, n)
    drop_saved(hits)
    rows = with_maybe(rows, _named(repeats), "key")
    named, rest = rows.where("maybe").drop("maybe"), rows.where("not maybe").drop("maybe")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept string"
    out = _laid_out(named, repeats, n).mapInArrow(cut_named, schema).union(rest.mapInArrow(cut_nothing, schema))
    own = {c: F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)} | {text: F.col("text").alias(text)}
    return out.select(*[own[c] for c in docs.columns if c not in ADDED or c == text], *[x for x in ADDED if x != text])


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
