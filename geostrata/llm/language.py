"""Language identification by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is cut from all over a bounded sample of labelled rows. A text is cut into
blocks, every block is compressed with each dictionary, and the language with the smallest total wins. The
margin to the second smallest total, in proportion to it, says how sure that is; a narrow margin is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import small_batches, training_rows

#: Bounds of the sample: rows of a language, of whole texts; bytes of a dictionary; characters of a piece of one; languages.
ROWS, DICTIONARY_BYTES, PIECE, LANGUAGES = 400, 96 * 1024, 512, 1000
BLOCK, LEVEL, MARGIN = 4096, 6, 0.02
UNKNOWN = "und"


def fit_dictionaries(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each non-null language, of pieces of at most `rows` rows of it, the first by a hash of the key.

    Sampled texts are read whole, and pieces at hashed places all over them fill the dictionary, so that no row
    counts by its beginning. Rows are found by a threshold on the hash that follows from the language's count, so
    what tasks pass on does not grow with them. Rows with null text or key give nothing; of rows that repeat a
    key each counts. More than LANGUAGES languages are an error. No rows give no dictionaries.
    """
    good = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    good = good.select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 52)) / F.lit(1 << 52)
    counts = good.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    enough = rows + 6 * rows**0.5 + 20
    limits = docs.sparkSession.createDataFrame([(x["lang"], min(1.0, enough / x["n"])) for x in counts], "lang string, most double")
    near = good.withColumn("share", share).join(F.broadcast(limits), "lang").where("share <= most")  # at most LANGUAGES rows
    ranked = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("share", "key", "text"))).where(F.col("nth") <= rows)
    ranked = ranked.withColumn("whole", F.sum(F.octet_length("text")).over(Window.partitionBy("lang")))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = []
            for name, k, t, whole in zip(frame["lang"], frame["key"], frame["text"], frame["whole"], strict=True):
                for at in range(0, len(t), PIECE):
                    place = xxhash.xxh3_64_intdigest(f"{k}:{at}".encode())
                    if place / 2**64 <= (size + 8 * PIECE) * 1.2 / whole:
                        held.append((name, place - (1 << 63), t[at : at + PIECE].lower()))
            yield pd.DataFrame(held, columns=["lang", "place", "piece"])

    got = ranked.select("lang", "key", "text", "whole").mapInPandas(pieces, "lang string, place long, piece string").orderBy("lang", "place", "piece").collect()
    found: dict[str, bytes] = {x["lang"]: b"" for x in counts}
    for x in got:
        if len(found[x["lang"]]) < size:
            found[x["lang"]] += x["piece"].encode("utf-8", "replace") + b"\n"
    return {k: v[:size] for k, v in sorted(found.items())}


class LanguageClassifier:
    """Sizes of texts under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.block = block
        self.codecs = []
        for k in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[k] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.codecs.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-8", "replace")
        parts = [raw[at : at + self.block] for at in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(x)) for x in parts) for c in self.codecs])

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin): `und` with margin 0 if text is null or has no letter, or nothing was learned."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.languages[0], 1.0
        first, second = np.argsort(sizes, kind="stable")[:2]
        return self.languages[first], float((sizes[second] - sizes[first]) / sizes[second])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(key, lang_pred, lang, score): the closest language, the same or `und` where the margin is narrow, and margin / (margin + threshold).

    Null texts and texts without a letter: `und`, score 0. A tie goes to the first language by name with
    score 0. Texts of any length are read whole, in blocks. Null and repeated keys keep their rows; other
    columns are left out, whatever their names. An empty table gives no rows; with no dictionaries all is `und`.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LanguageClassifier(shared.value)
        for frame in frames:
            got = [model(x) for x in frame["text"]]
            yield pd.DataFrame({"key": frame["key"].astype("Int64"), "lang_pred": [x for x, _ in got], "lang": [x if m >= margin else UNKNOWN for x, m in got], "score": [m / (m + margin) for _, m in got]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "key long, lang_pred string, lang string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language after rejection, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_dictionaries(docs.where(training_rows(F.col("doc_id"))))
    out = identify(docs, model)
    return out.select(F.col("key").alias("doc_id"), (~training_rows(F.col("key"))).alias("held_out"), "lang_pred", "score", F.col("lang").alias("lang_accepted"))
