"""J1/T1 by cells: brute force's rows whatever the data; bounds that hold; splitting of hot cells."""

import numpy as np
import pytest

from codelake.operators import cells as X
from codelake.operators import retrieve as R


def _tables(spark, chunks, queries):
    c = spark.createDataFrame([(i, v) for i, v in enumerate(chunks)], "chunk_id bigint, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(queries)], "qid string, embedding array<double>")
    return q, c


def _found(q, c, **kw):
    return sorted((r.qid, r["rank"], r.chunk_id, r.sim) for r in R.retrieve_topk(q, c, **kw).collect())


@pytest.mark.parametrize("min_sim", [0.3, -2.0])
def test_rows_are_those_of_brute_force(spark, min_sim, monkeypatch):
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((12, 16))
    rows = [(middle[i % 12] + 0.1 * rng.standard_normal(16)).tolist() for i in range(900)]
    rows += [rows[5]] * 300 + [[0.0] * 16, None] + rng.poisson(0.2, (200, 16)).astype(float).tolist()
    asked = rows[::40] + [[0.0] * 16, None] + rng.standard_normal((20, 16)).tolist()
    q, c = _tables(spark, rows, asked)
    want = _found(q, c, k=4, min_sim=min_sim)
    monkeypatch.setattr(X.score_topk_cells, "__kwdefaults__", X.score_topk_cells.__kwdefaults__ | {
        "cell_rows": 60, "part_bytes": 50 * 16 * 8})
    assert _found(q, c, k=4, min_sim=min_sim, strategy="cells") == want
    assert _found(q, c, k=4, min_sim=min_sim, max_broadcast_queries=3) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    centres = X.unit(rng.standard_normal((8, 24)))
    rows = X.unit(np.repeat(centres, 100, 0) + 0.05 * rng.standard_normal((800, 24)))
    a = X.angles(rows, centres)
    near = a.argmin(1)
    angle = a[np.arange(800), near]
    bins = (angle / np.pi * X.BINS).astype(int)
    table = [(int(c), int(b), int((m := (near == c) & (bins == b)).sum()), angle[m].min(), angle[m].max())
             for c, b in set(zip(near, bins))]
    cells = X.Cells(centres, rows[::10], table, 30)
    of_row = np.array([cells.of_bin[at] for at in zip(near, bins)])
    q = X.unit(np.vstack([rows[:50] + 0.02 * rng.standard_normal((50, 24)), rng.standard_normal((50, 24))]))
    best = np.full((100, len(cells.centre)), -2.0)
    np.maximum.at(best, (slice(None), of_row), q @ rows.T)
    assert (cells.bounds(q) >= best - X.SLACK).all()
    row, part = cells.wanted(q[:50], cells.reach(q[:50], 5, 0.3))
    assert len(row) < 0.3 * 50 * cells.parts and (part < cells.parts).all()
    assert (np.bincount(of_row) <= 30 * cells.salts).all()
    assert (cells.home(q) < cells.parts).all()


def test_empty_sides_and_unequal_lengths(spark):
    q, c = _tables(spark, [[1.0, 0.0]], [[1.0, 1.0]])
    for a, b in ((q.limit(0), c), (q, c.limit(0)), (q.limit(0), c.limit(0))):
        assert _found(a, b, strategy="cells") == []
    assert [r[:3] for r in _found(q, c, strategy="cells")] == [("q0", 1, 0)]
    odd, _ = _tables(spark, [], [[1.0, 1.0, 2.0]])
    with pytest.raises(Exception, match="different length"):
        _found(odd, c, strategy="cells")
    nan, _ = _tables(spark, [], [[float("nan"), 1.0], [float("inf"), 1.0]])
    assert _found(nan, c, strategy="cells", min_sim=-2.0) == []


def test_many_equal_scores_stay_within_memory():
    """Scaled copies of one vector all tie: candidates are scored and cut a part at a time, the first rows win."""
    import tracemalloc

    v = np.arange(1.0, 65.0)
    rows = np.vstack([v * 2.0 ** (i % 40) for i in range(20000)])
    asked = np.vstack([v + np.eye(64)[i % 64] for i in range(100)])
    tracemalloc.start()
    kept = R.first_copies(rows, np.arange(20000), 3)
    q, r, s = R.best_rows(rows, asked, np.arange(20000), 3, np.full(100, 0.3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) == 120 and (kept == np.arange(120)).all()
    assert peak < 300e6 and (r == np.tile([0, 1, 2], 100)).all() and (q == np.repeat(np.arange(100), 3)).all()


def test_a_load_takes_a_query_once():
    rng = np.random.default_rng(9)
    centres = X.unit(rng.standard_normal((16, 8)))
    cells = X.Cells(centres, centres, [(c, b, 40, 0.05 * b, 0.05 * b + 0.05) for c in range(16) for b in range(10)], 50)
    load = cells.loads(1600)
    assert len(load) == cells.parts and load.max() < 6 and (np.diff(load) >= 0).all()
    row, part = cells.wanted(X.unit(rng.standard_normal((20, 8))), np.full(20, -1.0))
    assert len(row) == 20 * cells.parts and len(set(zip(row, load[part]))) == 20 * (load.max() + 1)
    assert (cells.cell_of(cells.first) == np.arange(len(cells.first))).all()
