"""What lets a step grow with its input: values computed once, batches of bounded size, no text where it is not needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.functions import declarations as D
from codelake.operators import cells as X
from codelake.operators import chunking as C
from codelake.operators import codeeval as CE
from codelake.operators import embed as E
from codelake.operators import retrieve as R
from codelake.operators import traindata as TD
from codelake.plans import answers_q as A
from codelake.plans import codeeval_q as Q
from codelake.plans import fixtures as D2
from inputs import SF_SMALL

TEXTS = ["a b  a", None, "", "  ", "x " * 50, "é È a\tb", "last"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("words", [1, 5, 1 << 19])
def test_embedding_takes_few_words_at_a_time(spark, monkeypatch, words):
    monkeypatch.setattr(E, "EMBED_TOKENS", words)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, t string").coalesce(1)
    out = E.hash_embed_table(df, ["k"], "t", 16, out_col="v", keep=["t"])
    assert "MapInArrow" not in _plan(out)           # other columns stay in the JVM
    want = {r.k: r.v for r in df.select("k", E.hash_embed("t", 16).alias("v")).collect()}
    got = {r.k: (r.t, r.v) for r in out.collect()}
    assert {k: t for k, (t, _) in got.items()} == dict(enumerate(TEXTS))
    assert {k: v for k, (_, v) in got.items()} == {k: None if v is None or not any(v) else v for k, v in want.items()}


def test_cosine_of_two_texts_stays_in_the_row(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "a", None), (2, " ", "x")], "k int, a string, b string")
    out = Q._pair_cosine(df, "a", "b")
    assert "Exchange" not in _plan(out) and "collect_list" not in _plan(out)
    got = sorted((r.k, r.a, round(r.cos, 9)) for r in out.collect())
    assert got == [(1, "a", -1.0), (1, "a b", 1.0), (2, " ", -1.0)]


def test_function_is_searched_once(spark):
    df = spark.createDataFrame([("x",)], "x string")
    plan = df.select(CE.clean_function(F.concat("x", F.lit("!"))).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("split(") == 1 and plan.count("concat(") == 1


def test_function_cases(spark):
    cases = {"}} int A::b(int x)\t {  a;\t\tb  \n { c }}  }": "A::b(int x) { a; b\n { c }}", "A::b() { {": "A::b() { {", "A::b(": "A::b(",
             " amrex::X::f(){ } #include <a>": "X::f(){ }", "é::ü(){}}": "é::ü(){}", None: None, "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [r[0] for r in df.select(CE.clean_function("x")).collect()] == list(cases.values())


def test_locals_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(D, "TEXTS", 2)
    df = spark.createDataFrame([(i, None if i == 3 else f"int v{i} = {i};") for i in range(7)], "i int, x string").coalesce(1)
    got = {r.i: r.y for r in df.select("i", CE.canonicalize_locals(F.col("x")).alias("y")).collect()}
    assert got == {i: None if i == 3 else f"int VAR1 = {i};" for i in range(7)}


def test_window_texts_are_those_of_the_arrays(spark, monkeypatch):
    monkeypatch.setattr(TD, "WINDOW_TEXTS", 2)
    rows = [(0, []), (1, [5, 1, 0]), (2, [7] * 4), (3, list(range(9))), (4, [1] * 5)]
    df = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1)
    arrays = df.select("i", F.posexplode(TD.encode_windows(F.col("ids"), 4)).alias("w", "x")) \
        .select("i", "w", F.array_join("x", " "), F.array_join(TD.mask_labels(F.col("x")), " "))
    texts = df.select("i", F.posexplode(TD.window_texts(F.col("ids"), 4)).alias("w", "x")).select("i", "w", "x.input_ids", "x.labels")
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, arrays.collect()))


@pytest.mark.parametrize("cut,head", [("chunk_cpp_files", C.CPP_HEAD), ("chunk_fortran_files", C.FORTRAN_HEAD)])
def test_a_file_is_searched_for_heads_twice_however_many_it_has(spark, cut, head):
    files = spark.createDataFrame([(1, ["// AI_METADATA", "! purpose: p", "a"] * 3)], "doc_id bigint, lines array<string>")
    out = getattr(C, cut)(files, ["doc_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {head}, ") == 2           # once for the heads, once for what stands between them
    assert out.count() == 3


def test_requests_are_read_once(spark):
    req = A._landed_requests(spark, SF_SMALL, "cpp")
    assert "regexp_extract" not in _plan(req) and req.count() == D2.d2_bodies(spark, SF_SMALL).count()
    plan = A.answer_prompts(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "conversations.parquet" not in plan and "RLIKE" not in plan


def test_usable_vectors_are_told_by_generated_code(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1.0, 2.0], None, [nan, 1.0], [None, 1.0], [None, nan], [1.0, inf], [-inf, 0.0], [0.0, 0.0], []]
    for kind in ("float", "double"):
        df = spark.createDataFrame(list(enumerate(rows)), f"k bigint, e array<{kind}>")
        out = X.usable(df, ["k"], "e")
        assert "lambda" not in _plan(out) and dict(out.dtypes)["vec"] == "array<double>"
        assert {r.k: r.vec for r in out.collect()} == {0: [1.0, 2.0], 7: [0.0, 0.0], 8: []}


def test_candidates_are_looked_for_by_rows_and_eights():
    rng = np.random.default_rng(3)
    for rows, cols in ((1, 1), (7, 8), (40, 13), (64, 512)):
        S = rng.random((rows, cols), dtype=np.float32)
        limit = rng.uniform(0.5, 1.1, rows).astype(np.float32)
        want = np.nonzero(S >= limit[:, None])
        assert all((g == w).all() and len(g) == len(w) for g, w in zip(R._marked(S, limit), want))


def test_best_rows_over_many_tiles_are_those_of_a_full_sort():
    rng = np.random.default_rng(5)
    rows, asked = rng.poisson(0.6, (1500, 24)).astype(float), rng.poisson(0.6, (1100, 24)).astype(float)
    rows[7], asked[9] = 0.0, 0.0
    place = rng.permutation(1500)
    size = R._lengths(asked)[:, None] * R._lengths(rows)[None]
    full = np.where(size == 0, -1.0, np.divide(asked @ rows.T, size, out=np.zeros_like(size), where=size > 0))
    for least in (0.3, -2.0):
        q, r, s = R.best_rows(rows, asked, place, 4, np.full(1100, least))
        order = np.lexsort((np.tile(place, (1100, 1)), -full), axis=1)[:, :4]
        want = [(a, int(b)) for a in range(1100) for b in order[a] if full[a, b] >= least]
        assert list(zip(q.tolist(), r.tolist())) == want
        assert (s == full[q, r]).all()
