"""A corpus pipeline: raw documents to packed training sequences.

Every stage takes the rows its predecessor kept, with the columns of `documents`, and its
result is written as Parquet before the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, packing, pii, quality_rules, simhash
from flowloom.llm.common import read
from flowloom.session import tune
from flowloom.stage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go, then documents that fail the rules or are depleted."""
    tune(spark)
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints (three-word shingles, two bits at most) stays."""
    tune(spark)
    return simhash.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    tune(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found personal data are replaced by their kind; every document stays."""
    tune(spark)
    return pii.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most 4096."""
    tune(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: Fingerprints and token ids have no form in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
