"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE encoding.

Each stage reads what the stage before it wrote. All but the last return the columns of documents;
the last returns doc_id, the token ids and their number for every row that the mix takes.
Rows without doc_id pass every stage: near dedup links nothing to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import bpe, content_sort, langid, minhash, mixing
from sessionloom.llm.common import Scratch, small_batches, table

#: Rows of one Arrow batch: executors carry what all stages leave behind, and a batch of 500 texts is about a megabyte.
BATCH_ROWS = 500


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are `und`: those without a letter.

    The score is no calibrated probability, so none is cut by it: with many languages, short texts
    with a right label score low.
    """
    small_batches(spark, BATCH_ROWS)
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    small_batches(spark, BATCH_ROWS)
    return content_sort.content_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle sets at Jaccard 0.8 or more, the smallest doc_id stays."""
    small_batches(spark, BATCH_ROWS)
    return minhash.near_dedup(docs, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_batches(spark, BATCH_ROWS)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to."""
    small_batches(spark, BATCH_ROWS)
    return bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), decoded=True)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", exact_dedup),
    ("minhash near dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte bpe", encode),
]

#: Language ID, MinHash and the mix are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each stage's output is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(before)
    return docs
