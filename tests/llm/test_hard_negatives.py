"""op12: packed products and mined rows against plain integer arithmetic."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, vector array<bigint>, label int, id string, anchor int, score string, v int, place int, rank string"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every, positives=5, negatives=10):
    rows = [r for r in rows if None not in r]
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        by = lambda r: (-product(va, r[1]), r[0])
        best = sorted((r for r in rows if r[2] == la and r[0] != a), key=by)[:positives]
        others = sorted((r for r in rows if r[2] != la), key=by)
        for p, vp, _ in best:
            ps = product(va, vp)
            fit = [r for r in others if 30 * ps <= 100 * product(va, r[1]) <= 90 * ps][:negatives]
            out += [(a, p, k, r[0], ps, product(va, r[1])) for k, r in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame([(*r, "x", 1, "s", 2, 3, "r") for r in rows], SCHEMA).repartition(4)
    got = hn.mine(df, F.col("vec_id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("largest", [3, 256, 1 << 22, 1 << 27])     # fields of a double, of Python integers
def test_packed_scores_are_exact(largest):
    rnd = np.random.default_rng(largest)
    rows, anchors = rnd.integers(-largest, largest + 1, (7, 20)), rnd.integers(-largest, largest + 1, (3, 20))
    rows[0], anchors[0], rows[1] = largest, largest, -largest
    p = hn.Packing(largest, 20)
    assert (p.scores(anchors, p.pack(rows), 7) == anchors @ rows.T).all()
    assert bool(p.fields) == (largest <= 1 << 22)


def test_too_large_components_are_refused():
    with pytest.raises(ValueError):
        hn.Packing(1 << 31, 64)


@pytest.mark.parametrize("largest", [6, 1 << 28])
def test_mined_rows_equal_brute_force_with_ties_and_repeated_rows(spark, largest):
    rnd = random.Random(largest)
    rows = [(i, [rnd.randint(-largest, largest) for _ in range(4)], rnd.randint(0, 3)) for i in range(150)]
    rows += [(200 + i, [2, 1, 2, 1], 1) for i in range(40)] + [(300 + i, [largest, 1, 2, 2], 2) for i in range(40)]
    rows += [(20, [1, 2, 3, 4], 2), (33, [5, 5, 5, 5], 1), (33, [5, 5, 5, 5], 1)]
    rows += [(None, [1, 1, 1, 1], 1), (400, None, 1), (410, [1, 2, 3, 3], None), (420, [], 1), (430, [5, 4], 2), (440, [0, 0, 0, 0], 3)]
    padded = [(a, None if v is None else v + [0] * (4 - len(v)), x) for a, v, x in rows]
    want = brute(padded, 10)
    assert mined(spark, rows) == want and want
    assert mined(spark, rows, block_anchors=3) == want


def test_no_rows_no_anchor_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1], 1), (2, [1], 2)]) == []
    assert mined(spark, [(i, [1, 1], 1) for i in range(30)]) == []


def test_components_are_floored_and_unusable_vectors_left_out(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, []), (7, [-inf])],
                               "vec_id bigint, e array<float>")
    got = df.where(hn.usable(F.col("e"))).select("vec_id", hn.quantised(F.col("e")).alias("q")).collect()
    assert {r[0]: r[1] for r in got} == {1: [128, -1], 6: []}
