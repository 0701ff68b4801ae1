"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, mix.

Each stage works on all documents that the one before it kept and calls one
operator of ``codelake.llm``; all but the last return the columns of
``documents``.  Rows with null or empty text pass the quality stage only if
the model accepts an empty text, are never near-duplicates or leaks, hold no
secret and take no share of the mix.  Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from codelake.llm._tables import discard, landed
from codelake.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"), held_out)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near_dedup.keep_first(docs)


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", first_of_near_duplicates),
    ("decontaminate", no_benchmark_leaks),
    ("secrets", secrets_redacted),
    ("mix", mixed),
]

#: the stages hold trained models, which SQL cannot express; tests/llm checks them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    configure(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
