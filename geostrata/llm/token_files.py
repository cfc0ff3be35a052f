"""Token-ID binary files: independent zstandard frames, a trailing seek table and per-frame checksums.

A file holds, in this order: zstandard frames, each with the ids of whole documents as little-endian
unsigned 32-bit integers; one skippable frame with the document index (for each document its key, the
number of its frame, the first id in that frame, the number of ids and whether it has a key, as
little-endian 64-bit integers);
one skippable frame with the seek table of zstandard's public seekable format (compressed size,
decompressed size and the low half of xxh64 for each frame, then the footer). Any zstandard tool can
decompress it; a reader fetches the tail, then only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.bytes_tokens import piece_encoder
from geostrata.llm.common import new_path, small_batches

# Fixed values of the public seekable format.
SKIPPABLE, INDEX_MAGIC, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_BYTES = 1 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenFileWriter:
    """Writes documents' ids to an open binary file; a frame closes at the document that fills frame_bytes."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.frame_bytes, self.codec = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.frames, self.docs = [], 0, [], []

    def add(self, key: int | None, ids: bytes) -> None:
        self.docs.append((key or 0, len(self.frames), self.size // 4, len(ids) // 4, key is not None))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.codec.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        index = self.codec.compress(np.asarray(self.docs, "<i8").reshape(-1, 5).T.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in [*self.frames, (len(index) + 8, 0, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class TokenFileReader:
    """Reads documents' ids from a seekable binary file, decompressing only the frames that hold them."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        source.seek(size - 9 - 12 * frames)
        self.entries = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])
        source.seek(int(self.begins[frames - 1]))
        length = struct.unpack("<II", source.read(8))[1]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(length)), "<i8").reshape(5, -1).T

    def frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k].tolist()
        self.source.seek(int(self.begins[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self, keys: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(key or None, ids as bytes), in file order; all documents, or those with the keys."""
        rows = self.docs if keys is None else self.docs[np.isin(self.docs[:, 0], np.fromiter(keys, np.int64)) & (self.docs[:, 4] == 1)]
        at, raw = -1, b""
        for key, k, first, n, keyed in rows.tolist():
            if k != at:
                at, raw = k, self.frame(k)
            yield key if keyed else None, raw[4 * first : 4 * (first + n)]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes docs and writes them in ascending key order, one file per range of keys.

    Returns (shard, path, n_docs, n_tokens), one row per file that has documents; shards ascend with the
    keys. Null text counts as empty: such a document has its end id alone. Rows with a null key come
    first and stay without a key; repeated keys stay separate documents, next to each other. A very
    long text is one document of one frame, held whole by its task. Other columns are left out, whatever
    their names. An empty table gives no file. A file is written under a name of its attempt and then
    renamed, so repeated or speculative tasks leave one whole file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        shard, encoder, end = context.partitionId(), piece_encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        final = f"{folder}/shard-{shard:06d}.tok"
        store, at = _opened(final)
        writer, out, n_docs, n_tokens = None, None, 0, 0
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                for doc, ids in zip(part["key"].astype("Int64"), encoder.encode(part["text"].tolist()), strict=True):
                    if writer is None:
                        store.create_dir(at.rpartition("/")[0], recursive=True)
                        held = f"{at}.{context.taskAttemptId()}"
                        out = store.open_output_stream(held)
                        writer = TokenFileWriter(out)
                    writer.add(None if doc is pd.NA else int(doc), ids + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(held, at)
            yield pd.DataFrame({"shard": [shard], "path": [final], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.repartitionByRange(n, "key").sortWithinPartitions("key").mapInPandas(write, "shard int, path string, n_docs long, n_tokens long")


def _read(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "start", "ids"]).astype({"key": "Int64"})


def read_token_files(files: DataFrame) -> DataFrame:
    """(key, start, ids): every document of the files, with the ids of all documents before it and its own ids as binary.

    files: (shard, path, n_tokens). Each task reads whole files frame by frame; at most a frame is held.
    """
    from pyspark.sql import Window

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("shard", "path", F.coalesce(before, F.lit(0)).alias("first"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"], strict=True):
                store, at = _opened(path)
                with store.open_input_file(at) as source:
                    held, size = [], 0
                    for key, ids in TokenFileReader(source, source.size()).documents():
                        held.append((key, first, ids))
                        first, size = first + len(ids) // 4, size + len(ids)
                        if size >= FRAME_BYTES:
                            yield _read(held)
                            held, size = [], 0
                    if held:
                        yield _read(held)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "shard").mapInPandas(read, "key long, start long, ids binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from the token files."""
    import public_tokenizers

    from geostrata.llm.common import saved

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = saved(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "tokens"), end_id=2), "token-files")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"doc_id": x["key"].astype("Int64"), "start": x["start"], "n_tokens": [len(b) // 4 for b in x["ids"]], "ids_crc32": [zlib.crc32(b) for b in x["ids"]]})

    return read_token_files(files).mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
