"""The corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet
in the shared folder and rereads it as the next one's docs. All but the last return the columns of documents.
Columns of docs beyond doc_id and text may have any names and stay as they are; n_chars, if there, follows the
text. An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import minhash, packing, quality, secrets, substrings
from geostrata.llm.common import saved

#: SQL can't express these stages; each is tested against a brute-force version.
ORACLE_SQL = None
QUALITY_THRESHOLD = 0.3
WINDOW, END_ID = 2048, 1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, unchanged. The model learns from the labels of sf_dir.

    A null text scores as an empty one. Null keys are scored but not learned from; repeated rows are each
    judged for themselves, alike. With no labels every score is 0.5, so all documents stay.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, QUALITY_THRESHOLD)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, unchanged.

    Documents with a null or empty text, or a null key, are in no group and stay. Rows that repeat a doc_id go
    or stay together.
    """
    out = minhash.near_duplicates(docs)
    gone = out.where(F.col("component") < F.col("doc")).select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(saved(gone, "near-duplicates"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; where words repeat an earlier passage, the text is the other words, joined by one space.

    A text without repeats stays as it is, a null text null; one of which no word is left is empty. A row with
    a null key comes after all others, and of repeated rows each keeps what the others hold at the same place.
    """
    out = substrings.dedup_substrings(_apart(docs), key="key")
    return _with_text(docs, out, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret, access identifier and linked weak part replaced by a mask.

    A text without any stays as it is, a null text null. Null keys and repeated rows are scanned each for itself.
    """
    out = secrets.scan_secrets(_apart(docs))
    spans = F.array_sort(F.concat("secret_base", "secret_linked"))
    return _with_text(docs, out, secrets.masked(F.col("text"), spans))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    A null or empty text has its end id alone; null keys and repeated rows are documents of their own.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, window=WINDOW)


def _apart(docs: DataFrame) -> DataFrame:
    """(row, key, text): all columns but the text as one, so that an operator's own columns meet none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").alias("key"), "text")


def _with_text(docs: DataFrame, out: DataFrame, text: Column) -> DataFrame:
    """The columns of docs from out, of (row, key, text) and what an operator added, with a new text; n_chars follows where the text changed."""
    out = out.withColumn("__new", text)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("__new").alias("text")}
    if "n_chars" in values:
        changed = ~F.col("text").eqNullSafe(F.col("__new"))
        values["n_chars"] = F.when(changed, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(values["n_chars"]).alias("n_chars")
    return out.select([values[c] for c in docs.columns])


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
