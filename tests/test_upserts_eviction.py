"""ST2 with a watermark that passes, ST3 as keyed upserts, and results published once."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from codelake.operators import conversation as CV
from codelake.sources import commit
from codelake.streaming import comments as ST
from codelake.streaming import upserts as U

PAGES = "feed string, id bigint, pr bigint, created string, body string, author string"


def _land(spark, root, rows):
    spark.createDataFrame([("issue", i, pr, f"2024-01-01T{h:02d}:00:00Z", f"b{i}", "u") for i, pr, h in rows], PAGES) \
        .coalesce(1).write.mode("append").parquet(root)


def _feed(spark, root):
    return CV.union_comments(spark.readStream.schema(PAGES).parquet(root))


def test_old_uids_are_evicted_and_late_comments_dropped(spark, tmp_dir):
    ST.disk_state(spark)
    root, out, check = (os.path.join(tmp_dir, n) for n in ("landed", "out", "ckpt"))
    state = []
    for rows in ([(i, 1, 0) for i in range(30)],              # 30 uids at 00:00
                 [(30, 1, 5), (3, 1, 0)],                     # 3 again, in time: known
                 [(31, 1, 9), (4, 1, 0), (99, 1, 2)],         # watermark 04:00: 4 again and 99 for the first time are late
                 [(31, 1, 9), (32, 1, 10)]):                  # 31 again: known
        _land(spark, root, rows)
        done = ST.run_to_parquet(ST.dedupe_seen(_feed(spark, root), watermark="1 hour").select("uid"), out, check)
        state.append(done[-1]["stateOperators"][0]["numRowsTotal"])
    got = sorted(r.uid for r in spark.read.parquet(out).collect())
    assert got == sorted(f"issue-{i}" for i in range(33))
    assert max(state) >= 30 and state[-1] <= 3                # the thirty are gone


def test_triggers_write_only_what_changed(spark, tmp_dir):
    root, out, check = (os.path.join(tmp_dir, n) for n in ("landed", "out", "ckpt"))
    assert U.read_upserts(spark, out, ["pr"]) is None and U.compact(spark, out, ["pr"]) == -1
    for rows in ([(i, i, 1) for i in range(50)], [(100, 7, 2)], [(101, 8, 0)], [(102, 7, 3), (103, 60, 1)]):
        _land(spark, root, rows)
        ST.finished(U.sink_upserts(ST.latest_per_pr(_feed(spark, root)), out, check))
    sizes = [spark.read.parquet(f"{out}/changes/{n}").count() for n in commit.folders(spark, f"{out}/changes", "epoch=")]
    assert sizes == [50, 1, 1, 2]
    want = {i: f"issue-{i}" for i in range(50)} | {7: "issue-102", 60: "issue-103"}
    read = lambda: {r.pr: r.uid for r in U.read_upserts(spark, out, ["pr"]).collect()}
    assert read() == want
    # an epoch replayed after a failure replaces its own rows
    U.write_changes(spark.read.parquet(f"{out}/changes/epoch=1").where("false"), out, 3)
    assert read()[7] == "issue-100"
    again = CV.latest_comment(CV.union_comments(spark.read.parquet(root))).where("pr in (7, 60)")
    U.write_changes(again, out, 3)
    assert read() == want
    assert U.compact(spark, out, ["pr"]) == 3 and read() == want and U.compact(spark, out, ["pr"]) == -1
    # a base that was not published is not read
    spark.read.parquet(f"{out}/base/through=3").where("pr = 1").write.parquet(f"{out}/base/through=9")
    assert read() == want


def test_batch_and_stream_agree_on_the_newest(spark):
    rows = [("issue", 5, 1, "2024-01-01T00:00:00.000001Z", "a", "u"), ("issue", 4, 1, "2024-01-01T00:00:00.000001Z", "b", "u"),
            ("review", 1, 1, "2024-01-01T00:00:00.000001Z", "c", "u"), ("issue", 4, 1, "2024-01-01T00:00:00.000001Z", "b", "u"),
            ("issue", -9, 2, "1969-01-01T00:00:00Z", "d", "u"), ("issue", 9_000_000_000_000_000_000, None, "2024-01-01T00:00:00Z", "e", "u"),
            ("review", 7, None, "2024-01-01T00:00:00Z", "f", "u")]
    c = CV.union_comments(spark.createDataFrame(rows, PAGES))
    a, b = ({r.pr: r.uid for r in f(c).collect()} for f in (CV.latest_comment, ST.latest_per_pr))
    assert a == b == {1: "issue-4", 2: "issue--9", None: "issue-9000000000000000000"}
    assert CV.latest_comment(c).count() == 3
    plan = CV.latest_comment(c)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("writers", [1, 6])
def test_one_of_several_writers_is_published(spark, tmp_dir, writers):
    path = os.path.join(tmp_dir, "state")
    with ThreadPoolExecutor(writers) as pool:
        won = list(pool.map(lambda i: commit.write_once(spark.range(100).select(F.lit(i).alias("w"), "id"), path), range(writers)))
    assert sum(won) == 1
    rows = commit.read_once(spark, path).collect()
    assert {r.w for r in rows} == {won.index(True)} and len(rows) == 100
    assert len(commit.folders(spark, path, "version-")) == 1
