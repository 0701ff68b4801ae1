"""Landed comment pages (the JSON the code-hosting API returns), batch or stream.

The HTTP pull is outside Spark; pages land as JSON files, one array of
comments per page, under ``<root>/<feed>/pr=<n>/page-*.json``.  Issue and
review comments carry ``created_at``; review submissions carry
``submitted_at``.  The reader flattens them to the page table that
``union_comments`` takes: ``feed, id, pr, created, body, author``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT_JSON = ("id bigint, created_at string, submitted_at string, body string, "
                "user struct<login:string>")


def _flatten(raw: DataFrame, feed: str) -> DataFrame:
    created = "submitted_at" if feed == "submission" else "created_at"
    return raw.select(F.lit(feed).alias("feed"), F.col("id"), F.col("pr").cast("bigint").alias("pr"),
                      F.col(created).alias("created"), F.col("body"),
                      F.col("user.login").alias("author"))


def read_comment_pages(spark: SparkSession, root: str, feed: str, stream: bool = False,
                       files_per_trigger: int | None = None) -> DataFrame:
    """One feed's landed pages; ``pr`` comes from the ``pr=<n>`` folder.

    Each page file is one JSON array (``multiLine``); an empty page is an
    empty array and contributes no rows."""
    path = f"{root.rstrip('/')}/{feed}"
    if stream:
        reader = spark.readStream.schema(COMMENT_JSON + ", pr bigint").option("multiLine", "true")
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
        raw = reader.json(path)
    else:
        raw = (spark.read.schema(COMMENT_JSON + ", pr bigint").option("multiLine", "true")
               .option("basePath", path).json(path))
    return _flatten(raw, feed)
