"""The subpackage's registered queries; ``__spark_entry__`` adds them when this module can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def _remainder(mod: int, value: int):
    """crc32 of doc_id as text, modulo ``mod``, is ``value`` (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == value


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(4, 2))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.class_lm import score

    return score(_table(spark, sf_dir, "documents"), _remainder(5, 1))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.secret_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.nearest import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.radix_dedup import removed

    return removed(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.hard_negatives import mine, quantised, usable

    e = _table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("vector")), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codelake.llm.merkle import manifest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)


_ALL = [op1_license_scan, op2_near_dedup, op3_nearest, op4_class_lm, op5_decontaminate, op6_mixing, op7_secret_scan, op8_quality, op9_pii, op10_substring_dedup,
        op11_radix_dedup, op12_hard_negatives, op13_merkle_manifest]


def _configured(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _configured(f) for f in _ALL}


def all_oracles() -> dict[str, str]:
    from codelake.llm import hard_negatives, license_scan, merkle, mixing, near_dedup, nearest, radix_dedup, substring_dedup

    return {"op1_license_scan": license_scan.oracle(), "op2_near_dedup": near_dedup.oracle(),
            "op3_nearest": nearest.oracle(50), "op6_mixing": mixing.oracle(), "op10_substring_dedup": substring_dedup.oracle(),
            "op11_radix_dedup": radix_dedup.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_merkle_manifest": merkle.oracle()}
