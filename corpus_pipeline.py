"""From raw documents to packed training sequences: quality rules, exact and near deduplication, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. What a
stage returns is written as Parquet and read again before the next one. SQL cannot express the tokenizer and the packing, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basketlens.functions.staging import scratch_dir
from basketlens.llm import bloom_dedup, hamming_index, repetition, source_mixing, swap_packing
from basketlens.llm.common import col, table
from basketlens.llm.queries import tokenizer_path

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    judged = repetition.repetition(docs.select(*[col(c).alias(f"own{i}") for i, c in enumerate(docs.columns)]), text=f"own{docs.columns.index('text')}")
    return judged.where("kept").select(*[col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return bloom_dedup.Groups(docs).kept()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a similarity of 0.8 or more."""
    return hamming_index.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return source_mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids and place in a sequence."""
    return swap_packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix sources", mix_sources), ("pack sequences", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
