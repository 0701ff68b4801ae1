"""The pipeline: each stage against a plain version over its own input."""

import random

import llm_plain as brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from codelake.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[-1].columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_quality_stage(spark, stages):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    want = quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), held).where("predicted = 1")
    assert {r[0] for r in want.select("doc_id").collect()} == {r["doc_id"] for r in stages[1].collect()}


def test_near_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = brute.components(rows)
    assert {r["doc_id"] for r in stages[2].collect()} == {d for d, (_, c) in want.items() if d == c}


def test_decontamination_stage(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    leaked = {d for d, t in before.items() if any(i in t for i in items)}
    assert set(before) - set(after) == leaked


def test_secret_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    known = brute.re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-z]{12,}')
    for d, t in before.items():
        assert after[d] == known.sub("[SECRET]", t)


def test_mix_stage(stages):
    rows = stages[5].collect()
    sizes = {r["doc_id"]: len(brute.words(r["text"])) for r in stages[4].collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_run_equals_the_stages(spark, stages):
    assert sorted(P.run(spark, SF).collect()) == sorted(stages[5].collect())


def test_stages_on_odd_input(spark, docs_of, corpus):
    rnd = random.Random(1)
    rows = corpus + [(None, "a text without an id " * rnd.randint(3, 5))] + corpus[:3]
    docs = docs_of(rows)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert "kept" in docs.columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    empty = docs_of(corpus).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
