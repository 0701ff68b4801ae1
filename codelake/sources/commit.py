"""Results that appear once and whole: create-if-absent commits on the shared filesystem (S9, S10, ST5).

Data goes to a folder of its own first; a small marker file, created only if
it is absent, then names that folder.  Creation without overwriting is atomic
on the filesystems Spark writes to, so of several writers one is published, a
writer that dies leaves nothing visible, and a reader sees all of a result or
none of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKER = "_published"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file; false when it is there already."""
    p, fs = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as e:  # another writer was faster
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(content.encode())
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or null when it is absent."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the entries of a folder that start with ``prefix`` (one each epoch or version: few)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix))


def write_once(df: DataFrame, path: str, fmt: str = "json") -> bool:
    """Publish ``df`` at ``path`` unless something is published there; says whether it was this one."""
    spark, root = df.sparkSession, path.rstrip("/")
    if read_small(spark, f"{root}/{MARKER}") is not None:
        return False
    name = f"version-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).save(f"{root}/{name}")
    if create_if_absent(spark, f"{root}/{MARKER}", name):
        return True
    remove(spark, f"{root}/{name}")
    return False


def read_once(spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None) -> DataFrame | None:
    """What is published at ``path``, or null."""
    name = read_small(spark, f"{path.rstrip('/')}/{MARKER}")
    if name is None:
        return None
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(f"{path.rstrip('/')}/{name.strip()}")
