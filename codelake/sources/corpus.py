"""Scan a source tree into a file table.

The tree is listed first, paths only: the path rule is a native predicate on
``path`` and no content is read.  What is left are the folders that hold kept
files; contents are then read from those folders alone, so files under an
excluded segment cost a listing entry and no byte.  Files that are not valid UTF-8 are skipped, as the reference
skips unreadable files.  Exclusion is tested on the path *relative to the
scanned root* (the reference tests the absolute path, so a root below a
``build`` folder would yield nothing).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scan rule (fixed values).
CODE_SUFFIXES = (".cpp", ".cc", ".H", ".h", ".f90", ".F90")
CODE_NAMES = ("inputs",)
EXCLUDE_SEGMENTS = (".git", "build", "CMakeFiles")


@dataclass(frozen=True)
class PathRule:
    suffixes: tuple[str, ...] = CODE_SUFFIXES
    names: tuple[str, ...] = CODE_NAMES
    exclude_segments: tuple[str, ...] = EXCLUDE_SEGMENTS


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != F.lit(""))


def path_suffix(name: Column) -> Column:
    """``PurePath.suffix``: the last ``.ext`` of a name that is not only a dot-name."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def apply_path_rule(df: DataFrame, path_col: str, rule: PathRule = PathRule()) -> DataFrame:
    """Keep rows whose path has a kept suffix or name and no excluded segment.

    Adds ``name`` and ``suffix`` columns.
    """
    segs = path_segments(F.col(path_col))
    name = F.element_at(segs, -1)
    suffix = path_suffix(name)
    keep = ((suffix.isin(*rule.suffixes) | name.isin(*rule.names))
            & ~F.arrays_overlap(segs, F.array(*[F.lit(s) for s in rule.exclude_segments])))
    return df.withColumn("name", name).withColumn("suffix", suffix).filter(keep)


def kept_folders(spark: SparkSession, root: str, root_path: str, names: str, rule: PathRule) -> list[str]:
    """The folders with files that the rule keeps.  Exclusion goes by folder, so a folder's matching files are kept or left together.

    One entry a folder; Spark's own listing, which this reads, holds one a file."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root).select("path")
    kept = apply_path_rule(paths.withColumn("_rel", F.expr(f"substring(path, {len(root_path) + 2})")), "_rel", rule)
    return sorted(r[0] for r in kept.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().collect())


def scan_code_corpus(spark: SparkSession, root: str, layout: str = "per_subdir",
                     rule: PathRule = PathRule(), language: str | None = None) -> DataFrame:
    """File table ``(example, relative_path, source_file, language, text)``.

    ``per_subdir``: each first-level folder is an example, files directly in
    ``root`` are ignored.  ``single``: the whole root is one example named
    after the folder.  ``language`` defaults to the file suffix.
    """
    # the root as the scan's paths spell it (scheme, working folder), cut off by its length
    jvm = spark.sparkContext._jvm
    given = jvm.org.apache.hadoop.fs.Path(root)
    fs = given.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root_path = fs.makeQualified(given).toString().rstrip("/")
    # the glob keeps other files' contents from being read at all
    names = ",".join([f"*{s}" for s in rule.suffixes] + list(rule.names))
    names = "{" + names + "}"
    folders = kept_folders(spark, root, root_path, names, rule)
    if folders:
        escaped = [re.sub(r"([\\{}\[\]*?^])", r"\\\1", f) for f in folders]         # a path, not a pattern
        files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(escaped).select("path", "content")
    else:
        files = spark.createDataFrame([], "path string, content binary")
    files = files.withColumn("_rel_root", F.expr(f"substring(path, {len(root_path) + 2})"))
    files = apply_path_rule(files, "_rel_root", rule)
    if layout == "per_subdir":
        example = F.element_at(F.split("_rel_root", "/", -1), 1)
        relative = F.regexp_extract("_rel_root", r"^[^/]+/(.*)$", 1)
        files = files.filter(F.instr("_rel_root", "/") > 0)
    elif layout == "single":
        example = F.lit(root_path.rsplit("/", 1)[-1])
        relative = F.col("_rel_root")
    else:
        raise ValueError(f"unknown layout {layout}")
    text = F.col("content").cast("string")
    return (files.withColumn("text", text)
                 .filter(F.is_valid_utf8("text"))
                 .select(example.alias("example"), relative.alias("relative_path"),
                         F.col("name").alias("source_file"),
                         (F.lit(language) if language else F.col("suffix")).alias("language"),
                         "text"))
