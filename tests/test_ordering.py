"""Positions in a total order over many wide rows."""

import pytest
from pyspark.sql import functions as F

from codelake.operators.ordering import global_index


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_every_row_gets_its_own_index(spark, adaptive):
    n = 300_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("name"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("text"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        out = global_index(df, ["name"], "idx")
        r = out.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
                    F.min(F.length("text")).alias("w")).first()
        assert tuple(r) == (n, n, 0, n - 1, 512)
        a, b = out.select("idx", "name"), out.select((F.col("idx") - 1).alias("idx"), F.col("name").alias("after"))
        assert a.join(b, "idx").where("name >= after").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_empty_table(spark):
    assert global_index(spark.range(0), ["id"]).count() == 0


def test_scratch_tables_can_be_removed(spark):
    from codelake.session import remove_scratch

    out = global_index(spark.range(5), ["id"])
    path = out.inputFiles()[0].removeprefix("file:").removeprefix("//")
    import os

    assert os.path.exists(path) and out.count() == 5
    assert remove_scratch(spark) >= 1
    assert not os.path.exists(path)
