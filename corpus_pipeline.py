"""A training-data pipeline over `documents`; each stage reads what its predecessor has written.

Stages before the last give the columns of `documents`; the last gives the places of the kept documents' pieces in
training sequences. Documents that break a quality rule go, one document of each group of near-duplicates stays,
documents that contain a benchmark item go, and secrets are replaced in the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import decontamination, neardup, packing, quality, secrets
from codelake.llm.scratch import stored
from codelake.session import ship_package

# SQL has neither the tokenizer nor the components of near-duplicates; tests compare with a brute-force version.
ORACLE_SQL = None

WORDS, SIMILARITY = 5, 0.8
VOCABULARY, CAPACITY, END = public_tokenizers.path("byte_bpe_50k.json"), 1024, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    ship_package(spark)
    return quality.judge(docs, rules=quality.rules_where_listed()).filter(F.size("failed") == 0).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    ship_package(spark)
    return neardup.one_of_each(docs, WORDS, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SIMILARITY)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind."""
    ship_package(spark)
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    ship_package(spark)
    return packing.pack(docs, VOCABULARY, CAPACITY, END)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
