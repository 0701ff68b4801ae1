"""Instruction-response pairs as JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_SCHEMA = "instruction string, response string"


def write_jsonl(df: DataFrame, path: str, cols: tuple[str, ...] = ("instruction", "response")) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = PAIR_SCHEMA) -> DataFrame:
    """One object per line; blank lines are skipped by the JSON reader."""
    return spark.read.schema(schema).json(path)
