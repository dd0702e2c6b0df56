"""A training corpus in five stages: language ID, toxicity, exact dedup, SimHash near-dedup, best-fit packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from streetloom.llm.common import materialize, release_driver
from streetloom.llm.exact import keep_first_copies
from streetloom.llm.language import keep_known_language
from streetloom.llm.packing import pack_documents
from streetloom.llm.simhash import keep_one_of_group
from streetloom.llm.toxicity import keep_harmless


#: Rows a batch between the JVM and Python at most: with Spark's 10,000 both hold a task's whole texts at once.
BATCH_ROWS = 2_000


def _begin(spark: SparkSession) -> None:
    """Small batches, and a driver without what earlier stages left in it."""
    release_driver(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go (no letter, or no language likelier than 0.3)."""
    _begin(spark)
    return keep_known_language(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    _begin(spark)
    return keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    _begin(spark)
    return keep_first_copies(docs)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more, or at most 4 of 64 bits apart."""
    _begin(spark)
    return keep_one_of_group(docs, shingle=5, radius=4, least=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 1024 tokens."""
    _begin(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_neardup", simhash_neardup), ("best_fit_packing", best_fit_packing)]

#: Learned models and a tokenizer: SQL can't express it; tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
