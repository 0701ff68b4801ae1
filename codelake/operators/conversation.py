"""Conversation operators.

Batch and streaming share these projections unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feed order and uid prefixes (fixed values): the union order is the tie-break.
FEEDS = (("issue", "issue-", 0), ("review", "review-comment-", 1), ("submission", "review-submission-", 2))
REVIEW_SUFFIXES = (".c", ".cc", ".cpp", ".h", ".hpp")
REVIEW_NAME_PART = "Makefile"


def parse_ts(iso: Column) -> Column:
    """ISO-8601 with ``Z`` → UTC wall time (``timestamp_ntz``)."""
    return F.to_timestamp(F.regexp_replace(iso, "Z$", "+00:00")).cast("timestamp_ntz")


def union_comments(pages: DataFrame) -> DataFrame:
    """U1 + P3 + F23: one comment table from landed feed pages.

    ``pages``: ``feed, id, pr, created (ISO string), body, author`` with
    ``feed`` one of issue / review / submission.  The uid carries the feed
    prefix; only submissions drop empty bodies; a missing body is ``''``.
    One projection over one scan (the UNION ALL of disjoint feeds).
    """
    feed = F.col("feed")
    prefix = F.lit(None).cast("string")
    order = F.lit(None).cast("int")
    for name, pre, o in reversed(FEEDS):
        prefix = F.when(feed == name, F.lit(pre)).otherwise(prefix)
        order = F.when(feed == name, F.lit(o)).otherwise(order)
    empty = F.col("body").isNull() | (F.col("body") == "")
    kept = pages.filter(feed.isin(*[f for f, _, _ in FEEDS]) & ~((feed == "submission") & empty))   # P3
    return kept.select(
        F.concat(prefix, F.col("id").cast("string")).alias("uid"), "pr", "id",
        parse_ts(F.col("created")).alias("created_at"),
        F.coalesce(F.col("body"), F.lit("")).alias("body"), "author",
        feed.alias("source"), order.alias("feed_order"))


def union_feeds(issue: DataFrame, review: DataFrame, submission: DataFrame) -> DataFrame:
    """U1 for three separately landed feeds: tag each with its feed, UNION ALL."""
    tag = lambda df, f: df.select(F.lit(f).alias("feed"), "id", "pr", "created", "body", "author")
    return union_comments(tag(issue, "issue").unionByName(tag(review, "review"))
                          .unionByName(tag(submission, "submission")))


def _newest_key() -> Column:
    """A comment's rank as one number of fixed width: later first, then the earlier feed, then the smaller id.

    Microseconds (to the year 5138; none counts as the earliest), a digit for the feed, 20 digits for the id."""
    number = lambda c: c.cast("decimal(38,0)")
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(10 ** 15)))
    return (number(micros) * number(F.lit("1" + "0" * 21)) + number(9 - F.col("feed_order")) * number(F.lit("1" + "0" * 20))
            + number(F.lit("1" + "0" * 19)) - number(F.coalesce("id", F.lit(0)))).cast("decimal(38,0)")


def latest_comment(comments: DataFrame, group: str = "pr") -> DataFrame:
    """A3: newest comment per group; ties go to the earlier feed, then the earlier id.

    First only numbers are aggregated, in place by hash: a task ships one key per group, so a group with a
    third of all comments is no hot spot.  Then the winners' rows are fetched by (group, key), which
    spreads them evenly; bodies pass through no sort and no aggregate."""
    keyed = comments.withColumn("_key", _newest_key())
    best = keyed.groupBy(F.col(group).alias("_group")).agg(F.max("_key").alias("_best"))
    won = keyed.join(best, (F.col("_key") == F.col("_best")) & F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    # a comment delivered twice stands there twice
    once = Window.partitionBy(group, "_key").orderBy("uid")
    return won.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(group, "uid", "created_at", "body", "author", "source")


def exclude_seen(comments: DataFrame, seen: DataFrame, key: str = "uid") -> DataFrame:
    """Comments whose uid is not in the seen table (anti-join)."""
    return comments.join(seen.select(key), key, "left_anti")


def newest_open(prs: DataFrame, state_col: str, open_value: str, created_col: str, id_col: str) -> DataFrame:
    """P8 + T2: the newest open item (one row, or none)."""
    return (prs.filter(F.col(state_col) == open_value)
               .orderBy(F.col(created_col).desc(), F.col(id_col).desc()).limit(1))


def is_review_file(name: Column) -> Column:
    """C/C++ sources and headers, or any name containing ``Makefile``."""
    cond = F.lit(False)
    for s in REVIEW_SUFFIXES:
        cond = cond | F.endswith(name, F.lit(s))
    return cond | (F.instr(name, REVIEW_NAME_PART) > 0)


def source_sections(pr_files: DataFrame, files: DataFrame, name_col: str = "name",
                    text_col: str = "text") -> DataFrame:
    """Only PR files present in the file table contribute; one rendered
    section per file (rendered before any grouping)."""
    j = pr_files.join(files.select(name_col, text_col), name_col, "inner")
    return j.withColumn("section", F.concat(F.lit("\n===== FILE: "), F.col(name_col), F.lit(" =====\n"),
                                            F.col(text_col), F.lit("\n")))


def source_blob(sections: DataFrame, group: str = "pr", name_col: str = "name") -> DataFrame:
    """Per group, the sections concatenated in file-name order.

    The result is one string per group by definition; the aggregate ships
    pre-rendered sections, nothing else.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(name_col), F.col("section"))))
    return sections.groupBy(group).agg(
        F.array_join(F.transform(parts, lambda s: s["section"]), "").alias("blob"),
        F.count(F.lit(1)).alias("n_files"))


def short_name(x: Column) -> Column:
    """text after the last ``/``."""
    return F.element_at(F.split(x, "/", -1), -1)
