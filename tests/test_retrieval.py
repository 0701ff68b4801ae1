"""Cosine rules, ties, threshold before k, both strategies, plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.functions import vectors as V
from codelake.operators import retrieve as R


def test_cosine_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), (None, [1.0, 1.0]),
                                ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == -1.0 and got[2] == -1.0 and got[3] == pytest.approx(1.0)


def test_cosine_unequal_lengths_raise(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        df.select(V.cosine("a", "b")).collect()


def _brute_topk(q, chunks, k, min_sim):
    scored = []
    for pos, (cid, v) in enumerate(chunks):
        a, b = np.asarray(q, float), np.asarray(v, float)
        d = np.linalg.norm(a) * np.linalg.norm(b)
        s = -1.0 if d == 0 else float(a @ b / d)
        scored.append((s, pos, cid))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return [cid for s, _, cid in scored if s >= min_sim][:k]


@pytest.mark.parametrize("strategy", ["numpy", "native"])
def test_topk_ties_threshold_and_brute_force(spark, strategy):
    rnd = np.random.default_rng(3)
    vecs = [rnd.integers(-2, 3, 4).astype(float).tolist() for _ in range(60)]
    vecs[10] = vecs[3]                      # equal similarity: position decides
    vecs[20] = [0.0, 0.0, 0.0, 0.0]         # zero vector scores -1
    chunks = [(i, v) for i, v in enumerate(vecs)]
    queries = [(100, vecs[3]), (101, [1.0, 1.0, 1.0, 1.0]), (102, [0.0, 0.0, 0.0, 0.0])]
    c = spark.createDataFrame(chunks, "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame(queries, "qid bigint, embedding array<double>")
    got = R.retrieve_topk(q, c, k=5, min_sim=0.3, strategy=strategy).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r.qid, r.rank)):
        by_q.setdefault(r.qid, []).append(r.chunk_id)
    for qid, qv in queries:
        assert by_q.get(qid, []) == _brute_topk(qv, chunks, 5, 0.3)
    assert 102 not in by_q                   # all below the threshold: empty


def test_native_plan_shape(spark):
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "qid bigint, embedding array<double>")
    plan = R.retrieve_topk(q, c, k=3, strategy="native")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan
    assert "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan or "Window" in plan


def test_blocked_fallback_matches(spark):
    rnd = np.random.default_rng(5)
    chunks = [(i, rnd.normal(size=3).tolist()) for i in range(40)]
    queries = [(100 + j, rnd.normal(size=3).tolist()) for j in range(7)]
    c = spark.createDataFrame(chunks, "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame(queries, "qid bigint, embedding array<double>")
    small = R.retrieve_topk(q, c, k=4, min_sim=0.0, strategy="native", max_broadcast_queries=2)
    big = R.retrieve_topk(q, c, k=4, min_sim=0.0, strategy="native")
    key = lambda rows: sorted((r.qid, r.chunk_id, r.rank) for r in rows)
    assert key(small.collect()) == key(big.collect())


def test_single_query(spark):
    c = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "chunk_id bigint, embedding array<double>")
    top = R.retrieve_single(F.array(F.lit(1.0), F.lit(0.0)), c, k=2, min_sim=0.3).collect()
    assert [r.chunk_id for r in top] == [2, 5]      # [2, 1] is closest to [1, 0]; position breaks the tie


def test_numpy_plan_shape(spark):
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "qid bigint, embedding array<double>")
    df = R.retrieve_topk(q, c, k=3)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_embedders_agree(spark):
    from codelake.operators import embed as E

    texts = [(1, "Add two Numbers  fast"), (2, "   "), (3, None), (4, "a\tb\nc  a"), (5, "éte été ÉTÉ x")]
    df = spark.createDataFrame(texts, "k bigint, t string")
    col = {r.k: r.v for r in df.select("k", E.hash_embed("t", 16).alias("v")).collect()}
    tab = {r.k: r.v for r in E.hash_embed_table(df, ["k"], "t", 16, out_col="v").collect()}
    wide = {r.k: r.v for r in E.hash_embed_table(df, ["k"], "t", 300, out_col="v").collect()}
    assert col == tab
    assert col[2] is None and col[3] is None and sum(col[1]) == 4.0
    assert sum(wide[4]) == 4.0 and wide[2] is None


def test_equal_vectors_rank_by_position(spark):
    """Thousands of copies of one vector: every query gets the first ones."""
    rng = np.random.default_rng(1)
    v = rng.standard_normal(64).tolist()
    c = spark.createDataFrame([(i, v) for i in range(5000)], "chunk_id bigint, embedding array<double>").repartition(5)
    near = [(np.array(v) + 0.3 * rng.standard_normal(64)).tolist() for _ in range(40)]
    q = spark.createDataFrame(list(enumerate(near)), "qid bigint, embedding array<double>")
    for kw in ({}, {"max_broadcast_queries": 7}):
        got = R.retrieve_topk(q, c, k=5, **kw).collect()
        assert len(got) == 200 and all(r.chunk_id == r["rank"] - 1 for r in got)


def test_block_size_and_strategy_do_not_change_rows(spark):
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 8)],
                              "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(30)] + [(99, None)], "qid bigint, embedding array<double>")
    want = None
    for kw in ({}, {"max_broadcast_queries": 4}, {"strategy": "native"}, {"strategy": "native", "max_broadcast_queries": 4}):
        got = sorted((r.qid, r["rank"], r.chunk_id, r.sim) for r in R.retrieve_topk(q, c, k=4, min_sim=-2.0, **kw).collect())
        want = want or got
        assert got == want and len(got) == 120
