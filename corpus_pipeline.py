"""A corpus from documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs; all but the last return the columns of
documents, and each works on all that the one before has kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skewlens.llm import decontaminate, mixing, quality_rules, simhash, token_files
from skewlens.session import configure, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    return quality_rules.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return simhash.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Fingerprints, the knapsack and the tokenizer are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
