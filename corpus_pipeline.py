"""A training corpus in five stages, each an operator of quernal.llm on what the stage before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns each document's ids and what they decode to.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import bpe, exact_dedup, mixing, near_dedup, quality
from quernal.llm.common import materialize, release
from quernal.llm.queries import TOKENIZERS, VOCABULARY, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one stays."""
    return near_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat as often as the mix takes them."""
    return mixing.repeat(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    out = bpe.encode(docs, os.path.join(TOKENIZERS, VOCABULARY))
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]

#: Classifiers, components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if k:
            release(done)
    return docs
