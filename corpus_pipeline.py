"""Documents to packed training sequences: the stages of the training-data pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns the table that the next one reads. All but the last return the
columns of ``documents``, so that each stage works on everything its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from postmill.llm.common import crc_of_id
from postmill.llm.queries import SEQUENCE_TOKENS, word_tokenizer
from postmill.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter; learns from the labels of two thirds."""
    return language_id.lettered(docs, language_id.fit(docs.filter(crc_of_id("doc_id") % 3 != 1)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_tokenizer(), SEQUENCE_TOKENS)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: A fitted model, a seeded draw and a packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
