"""The corpus pipeline: quality rules, near-dedup, secret scan, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that the next one
reads. A null, empty or repeated row, and extra columns, go through each stage as its
operator defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import near_dedup, packing, quality_rules, secret_scan
from tarnwork.llm.common import written
from tarnwork.llm.queries import CAPACITY, vocabulary


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned rules reject go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.learn(docs, labels))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return near_dedup.keep_first(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays."""
    return secret_scan.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece and its place in a sequence."""
    return packing.packed_digest(docs, vocabulary("word_bpe_49k.json"), 1, CAPACITY)


STAGES = [
    ("quality rules", _quality),
    ("near-dedup", _near_dedup),
    ("secret scan", _secrets),
    ("best-fit packing", _packing),
]

#: The rules of the first stage are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage{number}")
    return docs
