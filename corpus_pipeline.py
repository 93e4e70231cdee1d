"""Cleaning pipeline over ``documents``: civil, distinct, without repeated passages or benchmark text, encodable.

Each stage works on all that the stage before kept, written as Parquet in the shared checkpoint folder and read
back; all but the last return the columns of ``documents``. A stage defines the result for null ids, null and empty
texts, repeated rows and empty tables in its operator's docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabsieve.llm import bpe, simhash, suffix, toxicity, winnow
from tabsieve.llm.common import prepare, table
from tabsieve.session import checkpoint_dir


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity grammar rejects; it learns from ``labels`` of the documents given."""
    prepare(spark)
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of SimHash near-duplicates."""
    prepare(spark)
    return simhash.keep_first(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a 100-byte passage that already occurs earlier; every document stays."""
    prepare(spark)
    return suffix.remove_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share 13-word windows with ``benchmark`` in a twentieth of their words or more."""
    prepare(spark)
    return winnow.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document left."""
    prepare(spark)
    return bpe.token_digests(docs, bpe.vocabulary(), ["doc_id"])


STAGES = [
    ("toxicity", civil),
    ("simhash_near_dedup", distinct),
    ("suffix_array_dedup", unrepeated),
    ("benchmark_decontamination", uncontaminated),
    ("bpe_encoding", encoded),
]

#: No stage but the last could be written in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}_{name}")
    return docs
