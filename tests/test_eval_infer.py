"""S9 writer, J2 abort on a missing benchmark, J5 missing entry, X2 failure isolation."""

import os

import pytest
from pyspark.sql import functions as F

from codelake.operators import codeeval as CE
from codelake.operators import infer as I


def _echo():
    """The stand-in model as a closure, so that it travels to the workers by value."""
    def echo_model(prompt, model, opts):
        """A stand-in model: its name and the prompt's size; a model named ``missing-*`` fails as if unavailable."""
        if model.startswith("missing"):
            raise RuntimeError(f"model '{model}' not found")
        return f"[{model} seed={opts['seed']}] {len(prompt)} chars"

    return echo_model


def test_pair_eval_pairs_by_index_and_aborts_when_missing(spark):
    prompts = spark.createDataFrame([("p_a.txt", "x"), ("p_b.txt", ""), ("p_c.txt", "z")],
                                    "prompt_name string, prompt string")
    benches = spark.createDataFrame([(0, "B0"), (1, "B1"), (2, "B2")], "item_id bigint, bench string")
    got = sorted((r.idx, r.prompt_name, r.bench) for r in CE.pair_eval(prompts, benches, order=["prompt_name"]).collect())
    assert got == [(0, "p_a.txt", "B0"), (2, "p_c.txt", "B2")]          # the empty prompt keeps index 1
    short = spark.createDataFrame([(0, "B0")], "item_id bigint, bench string")
    with pytest.raises(Exception, match="benchmark_02.txt"):
        CE.pair_eval(prompts, short, order=["prompt_name"]).collect()


def test_flags_first_entry_and_missing(spark):
    entries = spark.createDataFrame([("a.cpp", "g++ -Ia -DX=1 -O2 -c a.cpp", 2), ("a.cpp", "g++ -Ib -c a.cpp", 1),
                                     ("b.cpp", "g++ -std=c++17 -fopenmp -fno-x '-DQ=a b' -c b.cpp", 0)],
                                    "file string, command string, pos int")
    files = spark.createDataFrame([("a.cpp",), ("b.cpp",)], "file string")
    got = {r.file: list(r.flags) for r in CE.flags_for_file(files, entries).collect()}
    assert got == {"a.cpp": ["-Ib"], "b.cpp": ["-std=c++17", "-fopenmp", "-DQ=a b"]}
    with pytest.raises(Exception, match="no compile entry"):
        CE.flags_for_file(spark.createDataFrame([("c.cpp",)], "file string"), entries).collect()


def test_eval_report_writer(spark, tmp_dir):
    df = spark.createDataFrame([(0, "g", "gn", "b", "bn", 0.123456)],
                               "idx bigint, g string, gn string, b string, bn string, cos double")
    rep = df.select("idx", CE.report_text("g", "gn", "gn", "b", "bn", "bn", F.col("cos")).alias("report"))
    path = os.path.join(tmp_dir, "reports")
    CE.write_eval_report(rep, path)
    text = spark.read.text(os.path.join(path, "idx=0"), wholetext=True).first()[0]
    assert text.endswith("Cosine similarity: 0.1235\n") and "generated, as received" in text


def test_batch_infer_isolates_failures(spark):
    prompts = spark.createDataFrame([(1, "hello"), (2, "world!")], "id bigint, prompt string")
    cells = I.prompts_by_models(prompts, ["m1", "missing-x"])
    rows = {(r.id, r.model): r for r in I.batch_infer(cells, "prompt", _echo()).collect()}
    assert rows[(1, "m1")].response == "[m1 seed=42] 5 chars" and rows[(1, "m1")].error is None
    bad = rows[(2, "missing-x")]
    assert bad.response is None and bad.error_class == "model_unavailable"


def test_batch_infer_gives_up_a_hung_call(spark):
    def slow(prompt, model, opts):
        import time

        if prompt == "hang":
            time.sleep(5)
        return prompt.upper()

    df = spark.createDataFrame([(1, "hang", "m"), (2, "ok", "m")], "id bigint, prompt string, model string").coalesce(1)
    rows = {r.id: r for r in I.batch_infer(df, "prompt", slow, timeout_s=0.5).collect()}
    assert rows[2].response == "OK" and rows[1].response is None and "within" in rows[1].error and rows[1].error_class == "other"
