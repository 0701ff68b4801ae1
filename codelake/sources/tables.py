"""Readers for the input tables, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
               "value double, props string"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# The key each table is spread by when its scan is under-partitioned.
KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id", "events": "event_id",
        "embeddings": "vec_id", "benchmark": "item_id", "labels": "doc_id", "orders": "o_orderkey",
        "part": "p_partkey"}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows by the table key when the scan has fewer partitions
    than the session has cores.  A scan of a large table has more, so nothing
    is added there.  Only the placing of rows changes, never a result."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True) -> DataFrame:
    """Parquet scan; column pruning and filters reach the scan via Catalyst."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    if spread_rows and name in KEYS:
        df = spread(df, KEYS[name])
    return df
