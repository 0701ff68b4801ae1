"""A keyed result that a stream keeps up to date (ST3), written in proportion to what changes.

In update mode a trigger yields the changed keys alone.  Each epoch writes
them to a folder of its own, replaced when the epoch is replayed after a
failure; nothing else is rewritten.  Readers take each key's row of the
latest epoch.  ``compact`` folds the epochs so far into a base, published by
a create-if-absent marker, so that readers need not look back for ever.

Layout: ``changes/epoch=<n>``, ``base/through=<n>`` and the markers
``_base/through=<n>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.sources.commit import create_if_absent, folders


def write_changes(batch: DataFrame, path: str, epoch: int) -> None:
    """The rows of one epoch (one a key); a replay of the epoch replaces them."""
    batch.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")


def sink_upserts(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that keeps ``path`` up to date with a keyed streaming aggregate."""
    w = df.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: write_changes(batch, path, epoch))
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _epoch(name: str) -> int:
    return int(name.rsplit("=", 1)[1])


def _published(spark: SparkSession, path: str) -> int:
    """The epoch up to which the latest published base goes, -1 without one."""
    return max((_epoch(n) for n in folders(spark, f"{path}/_base", "through=")), default=-1)


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """Each key's latest row; null before the first epoch.

    Epochs are numbers, so the newest one of a key is a hash aggregate; rows are then taken by (key, epoch)."""
    base = _published(spark, path)
    parts = [spark.read.parquet(f"{path}/base/through={base}").withColumn("_epoch", F.lit(base).cast("bigint"))] if base >= 0 else []
    later = [n for n in folders(spark, f"{path}/changes", "epoch=") if _epoch(n) > base]
    if later:
        changes = spark.read.option("basePath", f"{path}/changes").parquet(*[f"{path}/changes/{n}" for n in later])
        parts.append(changes.withColumn("_epoch", F.col("epoch").cast("bigint")).drop("epoch"))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(later) + (base >= 0) == 1:
        return rows.drop("_epoch")
    newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_epoch").alias("_newest"))
    same = F.col("_epoch") == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(newest, same, "left_semi").drop("_epoch")


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold all epochs into a base and publish it; returns the epoch it goes up to (-1: nothing to do).

    Epoch folders stay, for readers that started before; an unpublished base is replaced by the next attempt."""
    names = folders(spark, f"{path}/changes", "epoch=")
    last = max((_epoch(n) for n in names), default=-1)
    if last <= _published(spark, path):
        return -1
    read_upserts(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base/through={last}")
    create_if_absent(spark, f"{path}/_base/through={last}", "")
    return last
