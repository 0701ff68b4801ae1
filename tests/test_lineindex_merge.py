"""W5 line index and F22 merge: against plain versions, and in time proportional to the lines."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codelake.operators import diffs as DF
from codelake.operators import lineindex as LI


def test_running_sums_of_lists():
    lists = [[3, 1], [], None, [5], [0, 0, 2]]
    for a in (pa.array(lists, pa.list_(pa.int64())), pa.array([[9], *lists, [9]], pa.list_(pa.int64())).slice(1, 5)):
        assert LI.running_sums(a).to_pylist() == [[0, 3, 4], [0], None, [0, 5], [0, 0, 0, 2]]


def test_positions_in_odd_texts(spark):
    texts = ["ab\r\ncd\x0cé", "", None, "\n", "x", "\r\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", LI.line_starts("t").alias("s"))
    got = {r.i: (r.s, r.a, r.b) for r in df.select("i", "s", LI.position("s", F.lit(2), F.lit(2)).alias("a"), LI.offset_of("s", F.lit(0)).alias("b")).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").splitlines(keepends=True)
        want = None if t is None else [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
        assert got[i] == (want, want[1] + 1 if want and len(want) > 1 else None, None)


def test_index_takes_time_in_proportion_to_lines(spark):
    df = spark.createDataFrame([(0, "some line of code;\r\n" * 100_000)], "i int, t string")
    df.select(F.size(LI.line_starts("t"))).collect()
    t = time.time()
    assert df.select(F.size(LI.line_starts("t"))).first()[0] == 100_001
    assert time.time() - t < 8


def _greedy(old, new):
    out, last = [], -1
    for x in old:
        k = next((i for i in range(last + 1, len(new)) if new[i] == x), None)
        if k is None:
            break
        out.append(k)
        last = k
    return out


def test_match_positions_equal_the_plain_rule():
    rnd = random.Random(6)
    for _ in range(500):
        old, new = ([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in range(2))
        assert DF.match_positions(np.array(old, np.int64), np.array(new, np.int64)).tolist() == _greedy(old, new)


def test_merge_of_a_long_file(spark):
    old = [f"line {i % 997}" for i in range(100_000)]
    new = [x for i, x in enumerate(old) if i % 10_000 != 9_999] + ["end"]
    df = spark.createDataFrame([(0, old, new), (1, ["a"], ["a "]), (2, None, ["n"])], "i int, a array<string>, b array<string>")
    t = time.time()
    got = {r.i: r.merged for r in DF.conflict_merge(df, "a", "b").select("i", "merged").collect()}
    assert time.time() - t < 20
    assert got[1] is None and got[2] == [DF.MERGE_OPEN, "n", DF.MERGE_MID, DF.MERGE_CLOSE]
    side, theirs, ours = "both", [], []
    for x in got[0]:
        if x in (DF.MERGE_OPEN, DF.MERGE_MID, DF.MERGE_CLOSE):
            side = {DF.MERGE_OPEN: "new", DF.MERGE_MID: "old", DF.MERGE_CLOSE: "both"}[x]
            continue
        ours += [x] if side != "old" else []
        theirs += [x] if side != "new" else []
    assert theirs == old and ours == new
