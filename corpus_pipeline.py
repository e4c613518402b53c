"""From raw documents to a training mix: five stages, each a table that the next one reads.

Rows go where their language is not identified, where a quality rule fails, where a document
of the same near-duplicate class stays, or where a test item is found; the last stage mixes
the sources that are left to their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.scratch import materialize
from tidemark.llm import decontam, langid, mixing, neardup, quality


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no or uncertain language."""
    return langid.keep_known(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that break a base rule or their group's adaptive fences."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return neardup.one_per_class(docs)


def drop_test_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item."""
    return decontam.without_tests(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with the words taken of each and the epochs it appears in."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("quality rules", apply_quality_rules),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_test_copies),
    ("source mix", mix_sources),
]

#: The network of the first stage is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
