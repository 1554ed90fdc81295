"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. A stage works on all rows its predecessor
kept. Language ID drops texts in no learned language, the n-gram Jaccard join
keeps one document of each group of similar ones, decontamination drops
documents that share a passage with the benchmark, the secret scan masks the
secrets in the texts, and packing returns the sequences' pieces.

Empty tables, null columns, repeated rows and extra columns pass as the
operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moodcast.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from moodcast.llm.common import discard, materialise, temporary_tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("vector_packing", pack),
]

# MinHash, fitted filters and tokenisation are not expressible in SQL; the tests
# run the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        with temporary_tables(spark):   # only the stage's output outlives it
            kept = materialise(stage(spark, docs, sf_dir), name, scoped=False)
        if n:
            discard(docs)
        docs = kept
    return docs
