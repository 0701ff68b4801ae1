"""S7 prompt files and S10 state records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.text import pystrip
from codelake.operators.ordering import global_index
from codelake.sources.commit import read_once, write_once

# State record fields (fixed values).
DEFAULT_TOOL = "codelake"


def read_prompts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One prompt per file, stripped, in file-name order; ``idx`` is the
    0-based position in that order and empty prompts are skipped after
    numbering (they still hold their index, as in the reference)."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"),
                                   pystrip("value").alias("prompt"))
    return index_prompts(raw, ["name"])


def index_prompts(prompts: DataFrame, order: list[str]) -> DataFrame:
    """Number in ``order`` first, then drop empty prompts."""
    return global_index(prompts, order, "idx").filter(F.col("prompt") != "")


def state_records(df: DataFrame, prompt_col: str, scaffold_type: str = "example",
                  tool: str = DEFAULT_TOOL) -> DataFrame:
    """S10's record per prompt: type, intent, tool, UTC time and SHA-256 of the prompt."""
    return df.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256)) \
             .withColumn("scaffolded", F.lit(True)) \
             .withColumn("scaffold_type", F.lit(scaffold_type)) \
             .withColumn("tool", F.lit(tool)) \
             .withColumn("created_at", F.current_timestamp())


def write_state_once(records: DataFrame, path: str) -> bool:
    """Publish the state unless one is published; of several writers one wins, whole.  Says whether this one did."""
    return write_once(records, path)


def read_state(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The published state, or null."""
    return read_once(spark, path, schema=schema)
