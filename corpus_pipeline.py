"""Raw documents to token ids: language ID, exact and near deduplication, mixing, encoding.

Every stage gets what its predecessor wrote and returns a DataFrame; all but the last return the
columns of documents. Each is written as Parquet in the shared folder and read again, so a lost
executor costs a stage's tasks and no more. Once a stage is written, what it had written on the way
and its predecessor's table are emptied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rarefy.llm import bpe, exact, language, mixing, simhash
from rarefy.llm._shared import documents, scratch, scratch_tables, tidy


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what op2_language calls und: documents without a letter."""
    return language.accept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share: documents beyond a budget go, a second epoch repeats documents."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_checked(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Language profiles, SimHash components and BPE are beyond SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        with scratch_tables(), tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            spark.range(0).write.mode("overwrite").parquet(before)
        docs, before = spark.read.parquet(path), path
    return docs
