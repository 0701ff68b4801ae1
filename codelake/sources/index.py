"""The chunk index on storage.

Primary layout: Parquet partitioned by ``example`` (partition pruning on
example, predicate pushdown of ``embedding IS NOT NULL``).  Interchange
layout: the reference's JSON documents ``{example, num_chunks, chunks}``.
A document holds one *part* of an example (a contiguous range of bounded
size), so no example is ever gathered into one task; readers concatenate
parts in path order, which is the index order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators.ordering import global_index

PART_BYTES = 64 << 20          # of one JSON document, about

CHUNK_JSON = ("struct<id:string, text:string, metadata:map<string,string>, embedding:string>")
DOC_JSON = f"struct<example:string, num_chunks:bigint, chunks:array<{CHUNK_JSON}>>"
ARRAY_JSON = f"array<{CHUNK_JSON}>"


def index_summary(chunks: DataFrame, example_col: str = "example") -> DataFrame:
    """A1: chunks per example and ``num_chunks`` = the embedded ones only."""
    return chunks.groupBy(example_col).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("num_chunks"))


def write_chunk_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 (primary): Parquet partitioned by example."""
    chunks.write.mode(mode).partitionBy("example").parquet(path)


def read_chunk_index_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3 (primary): unembedded chunks are dropped at the scan (pushed filter)."""
    return spark.read.parquet(path).filter(F.col("embedding").isNotNull())


def write_chunk_index_json(chunks: DataFrame, path: str, order_keys: list[str],
                           part_bytes: int = PART_BYTES) -> None:
    """S4 (interchange): reference-layout JSON documents, one per example part.

    ``chunks`` needs ``example, chunk_id, code, metadata, embedding`` and the
    ``order_keys``.  Null embeddings stay in the file and are not counted.
    A part is a contiguous range of the example's chunks in key order, as many
    as fit ``part_bytes`` at the example's largest chunk, so reading parts in
    path order is the index order whatever the size.
    """
    size = F.length("code") + 20 * F.coalesce(F.size("embedding"), F.lit(0)) \
        + F.length(F.coalesce(F.to_json("metadata"), F.lit("")))
    placed = global_index(chunks.withColumn("_size", F.greatest(size, F.lit(1))), ["example", *order_keys], "_at")
    per = placed.groupBy("example").agg(F.min("_at").alias("_first"), F.max("_size").alias("_most"))
    withp = placed.join(per, "example").withColumn("_part", F.lpad(F.expr(
        f"(_at - _first) div greatest(1, {int(part_bytes)} div _most)").cast("string"), 12, "0"))
    chunk = F.struct(F.col("chunk_id").alias("id"), F.col("code").alias("text"), "metadata", "embedding")
    docs = withp.groupBy("example", "_part").agg(
        F.count("embedding").alias("num_chunks"),
        F.array_sort(F.collect_list(F.struct(F.struct(*[F.col(k) for k in order_keys]).alias("k"),
                                             chunk.alias("c"))),
                     lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        .alias("_cs"))
    body = F.to_json(F.struct(F.col("example"), F.col("num_chunks"),
                              F.transform("_cs", lambda s: s["c"]).alias("chunks")))
    docs.select(F.col("example").alias("_ex"), "_part", body.alias("value")) \
        .write.mode("overwrite").partitionBy("_ex", "_part").text(path)


def read_chunk_index(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S3 (interchange): every document under ``path`` (``{"chunks": [..]}`` or a
    bare array), in path order then list position.

    Returns ``file, pos, id, text, metadata, embedding array<double>``;
    chunks without an embedding are dropped, string embeddings decoded.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if raw.select("file").isEmpty():
        raise FileNotFoundError(f"no index file under {path}")
    doc = F.from_json("value", DOC_JSON)
    arr = F.from_json("value", ARRAY_JSON)
    chunks = F.when(F.ltrim(F.col("value")).startswith("["), arr).otherwise(doc["chunks"])
    out = raw.select("file", F.posexplode(chunks).alias("pos", "c"))
    emb = F.from_json(F.col("c.embedding"), "array<double>")
    return (out.filter(F.col("c.embedding").isNotNull())
               .select("file", F.col("pos").cast("bigint").alias("pos"), F.col("c.id").alias("id"),
                       F.col("c.text").alias("text"), F.col("c.metadata").alias("metadata"),
                       emb.alias("embedding")))
