"""Positions in a total order, computed without a single-task window.

``row_number().over(Window.orderBy(..))`` with no partition moves every row
to one task.  ``global_index`` instead sorts with range partitioning (a
distributed sort), writes the sorted rows once with the number of the
partition each was written by, and adds the row count of all earlier
partitions.  Rows and counts come from that one written table, so they
agree whatever the optimiser does with either of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.session import scratch_path

_LOW_BITS = 33  # monotonically_increasing_id: partition id above bit 33


def global_index(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order`` (must be a total order)."""
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch_path(spark, "sorted")
    df.orderBy(*cols).withColumn("_mid", F.monotonically_increasing_id()).write.parquet(path)
    s = spark.read.parquet(path).withColumn("_pid", F.shiftright("_mid", _LOW_BITS))
    # one row per partition of the sort: a bounded window and a bounded broadcast
    offsets = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("bigint"))
             .drop("_mid", "_pid", "_off"))
