"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Quality rules drop documents that fail; line dedup leaves one of the lines that are equal or nearly so, and drops
documents that keep none; the n-gram Jaccard join keeps one document of each group of near copies; secret scans mask
what they find; packing cuts what is left into sequences, one row for each piece; the first piece's row holds
the sequence's padded token ids.

Each stage works on all rows that its predecessor kept. Null texts fail the quality rules; empty input gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copperleaf.llm import jaccard, lines, packing, quality, secrets
from copperleaf.llm.common import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: MinHash signatures, union-find, character models and byte-level BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
