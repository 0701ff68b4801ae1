"""S1, S3-S7, S10 sources and sinks; U1/A3/J8; ST1-ST3 across micro-batches."""

import json
import os

import pytest

from pyspark.sql import functions as F

from codelake.operators import conversation as CV
from codelake.sources import corpus as SC
from codelake.sources import index as IX
from codelake.sources import jsonl as JL
from codelake.sources import prompts as SP
from codelake.streaming import comments as ST


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def test_scan_code_corpus(spark, tmp_dir):
    root = os.path.join(tmp_dir, "examples")
    _write(f"{root}/ex1/a.cpp", "// AI_METADATA\nint a;")
    _write(f"{root}/ex1/sub/inputs", "n = 1")
    _write(f"{root}/ex1/build/b.cpp", "skipped")
    _write(f"{root}/ex1/notes.txt", "skipped")
    _write(f"{root}/ex2/m.F90", "x")
    _write(f"{root}/top.cpp", "root files are ignored in per_subdir layout")
    with open(f"{root}/ex2/bad.h", "wb") as f:
        f.write(b"\xff\xfe\x00bad")
    got = sorted((r.example, r.relative_path, r.source_file, r.language)
                 for r in SC.scan_code_corpus(spark, root).collect())
    assert got == [("ex1", "a.cpp", "a.cpp", ".cpp"), ("ex1", "sub/inputs", "inputs", ""),
                   ("ex2", "m.F90", "m.F90", ".F90")]
    single = SC.scan_code_corpus(spark, f"{root}/ex1", layout="single", language="fortran").collect()
    assert sorted(r.relative_path for r in single) == ["a.cpp", "sub/inputs"]
    assert {r.example for r in single} == {"ex1"} and {r.language for r in single} == {"fortran"}


def test_read_reference_index(spark, tmp_dir):
    d = os.path.join(tmp_dir, "rag")
    doc = {"example": "e", "num_chunks": 2, "chunks": [
        {"id": "1", "text": "t1", "metadata": {"k": "v"}, "embedding": [1, 2]},
        {"id": "2", "text": "t2", "metadata": {}, "embedding": None},
        {"id": "3", "text": "t3", "metadata": {}, "embedding": "[0.5, 0.25]"}]}
    _write(f"{d}/a.json", json.dumps(doc, indent=2))
    _write(f"{d}/b.json", json.dumps([{"id": "4", "text": "t4", "metadata": {}, "embedding": [3.0, 4.0]}]))
    _write(f"{d}/c.txt", "not an index file")
    rows = IX.read_chunk_index(spark, d, glob="*.json").orderBy("file", "pos").collect()
    assert [(r.id, list(r.embedding)) for r in rows] == [("1", [1.0, 2.0]), ("3", [0.5, 0.25]), ("4", [3.0, 4.0])]
    assert [r.pos for r in rows] == [0, 2, 0]


def test_index_write_read_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame(
        [("ex", 1, 0, "id-a", "code a", {"k": "v"}, [1.0, 0.0]), ("ex", 1, 1, "id-b", "code b", {}, None),
         ("ex", 2, 0, "id-c", "code c", {}, [0.0, 1.0]), ("other", 3, 0, "id-d", "d", {}, [1.0, 1.0])],
        "example string, doc bigint, chunk bigint, chunk_id string, code string, metadata map<string,string>, "
        "embedding array<double>")
    path = os.path.join(tmp_dir, "idx")
    IX.write_chunk_index_json(df, path, ["doc", "chunk"], part_bytes=100)
    back = IX.read_chunk_index(spark, path).collect()
    assert sorted(r.id for r in back) == ["id-a", "id-c", "id-d"]
    summary = {r.example: (r.n_chunks, r.num_chunks) for r in IX.index_summary(df).collect()}
    assert summary == {"ex": (3, 2), "other": (1, 1)}
    pq = os.path.join(tmp_dir, "idx_pq")
    IX.write_chunk_index(df, pq)
    assert IX.read_chunk_index_parquet(spark, pq).count() == 3


def test_index_parts_keep_the_order(spark, tmp_dir):
    """Parts are contiguous: read back in path order, chunks stand in key order; an empty folder is an error."""
    df = spark.createDataFrame([("ex", i, f"id-{i:02d}", "code", {}, [1.0]) for i in range(12)],
                               "example string, doc bigint, chunk_id string, code string, metadata map<string,string>, embedding array<double>")
    path = os.path.join(tmp_dir, "parts")
    IX.write_chunk_index_json(df.repartition(3), path, ["doc"], part_bytes=110)
    rows = IX.read_chunk_index(spark, path).orderBy("file", "pos").collect()
    assert [r.id for r in rows] == [f"id-{i:02d}" for i in range(12)]
    assert 1 < len({r.file for r in rows}) < 12
    os.makedirs(os.path.join(tmp_dir, "empty"))
    with pytest.raises(FileNotFoundError):
        IX.read_chunk_index(spark, os.path.join(tmp_dir, "empty"))


def test_scan_root_is_taken_as_a_whole(spark, tmp_dir, monkeypatch):
    """A relative root, and a root whose path repeats its own name."""
    for p in ("src/w/src/a/f.cpp", "src/w/src/b/src/g.H", "src/w/src/a/.git/x.cpp", "src/w/src/a/big.bin"):
        _write(os.path.join(tmp_dir, p), "int x;")
    got = lambda root: sorted((r.example, r.relative_path) for r in SC.scan_code_corpus(spark, root).collect())
    want = [("a", "f.cpp"), ("b", "src/g.H")]
    assert got(os.path.join(tmp_dir, "src/w/src")) == want
    assert got("file:" + os.path.join(tmp_dir, "src/w/src")) == want


def test_jsonl_prompts_state(spark, tmp_dir):
    pairs = spark.createDataFrame([("i1", "r1"), ("i2", 'r "2"\nx')], "instruction string, response string")
    p = os.path.join(tmp_dir, "jsonl")
    JL.write_jsonl(pairs, p)
    _write(os.path.join(p, "part-extra.txt"), "\n\n")
    assert sorted(tuple(r) for r in JL.read_jsonl(spark, p).collect()) == [("i1", "r1"), ("i2", 'r "2"\nx')]
    pd_ = os.path.join(tmp_dir, "prompts")
    _write(f"{pd_}/b.txt", "  second \n")
    _write(f"{pd_}/a.txt", "first")
    _write(f"{pd_}/c.txt", "   ")
    _write(f"{pd_}/d.txt", "fourth")
    got = sorted((r.idx, r.prompt) for r in SP.read_prompts(spark, pd_).collect())
    assert got == [(0, "first"), (1, "second"), (3, "fourth")]   # the empty file keeps index 2
    st = os.path.join(tmp_dir, "state")
    recs = SP.state_records(spark.createDataFrame([("make x",)], "p string"), "p")
    assert SP.read_state(spark, st) is None
    assert SP.write_state_once(recs, st)
    assert not SP.write_state_once(SP.state_records(spark.createDataFrame([("other",)], "p string"), "p"), st)
    import hashlib
    assert [r.prompt_hash for r in SP.read_state(spark, st).collect()] == [hashlib.sha256(b"make x").hexdigest()]


def _pages(spark, rows):
    return spark.createDataFrame(rows, "feed string, id bigint, pr bigint, created string, body string, author string")


def test_union_latest_seen(spark):
    rows = [("issue", 1, 7, "2024-01-01T00:00:05Z", "a", "u"), ("review", 2, 7, "2024-01-01T00:00:05Z", "b", "u"),
            ("submission", 3, 7, "2024-01-01T00:00:01Z", "", "u"), ("submission", 4, 8, "2024-01-01T00:00:09Z", "s", "u"),
            ("issue", 5, 8, "2024-01-01T00:00:02Z", None, "u")]
    c = CV.union_comments(_pages(spark, rows))
    assert sorted(r.uid for r in c.collect()) == ["issue-1", "issue-5", "review-comment-2", "review-submission-4"]
    latest = {r.pr: r.uid for r in CV.latest_comment(c).collect()}
    assert latest == {7: "issue-1", 8: "review-submission-4"}   # equal times: the earlier feed wins
    seen = spark.createDataFrame([("issue-1",)], "uid string")
    assert sorted(r.uid for r in CV.exclude_seen(c, seen).collect()) == ["issue-5", "review-comment-2",
                                                                          "review-submission-4"]
    assert [r.body for r in c.filter(F.col("uid") == "issue-5").collect()] == [""]


def test_stream_dedupe_and_latest_across_batches(spark, tmp_dir):
    src = os.path.join(tmp_dir, "landed")
    schema = "feed string, id bigint, pr bigint, created string, body string, author string"
    b1 = [("issue", 1, 7, "2024-01-01T00:00:05Z", "hi @assistant x", "u"), ("review", 2, 7, "2024-01-01T00:00:06Z", "no", "u")]
    b2 = b1 + [("issue", 3, 7, "2024-01-01T00:00:09Z", "@assistant y", "u")]      # a poll re-reads everything
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(os.path.join(src, "p1"))
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(os.path.join(src, "p2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
    comments = CV.union_comments(stream)
    out = os.path.join(tmp_dir, "out")
    ST.run_to_parquet(ST.mentions(ST.dedupe_seen(comments)).select("uid", "prompt"), out,
                      os.path.join(tmp_dir, "ck1"))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("issue-1", "x"), ("issue-3", "y")]
    out2 = os.path.join(tmp_dir, "out2")
    ST.run_to_parquet(ST.latest_per_pr(CV.union_comments(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").parquet(src))), out2, os.path.join(tmp_dir, "ck2"), mode="complete")
    assert [r.uid for r in spark.read.parquet(out2).collect()] == ["issue-3"]


def test_read_comment_pages(spark, tmp_dir):
    from codelake.sources.comments import read_comment_pages

    root = os.path.join(tmp_dir, "landed")
    _write(f"{root}/issue/pr=7/page-1.json", json.dumps(
        [{"id": 11, "created_at": "2024-01-01T00:00:01Z", "body": "hi @assistant go", "user": {"login": "a"}}]))
    _write(f"{root}/issue/pr=7/page-2.json", "[]")
    _write(f"{root}/review/pr=7/page-1.json", json.dumps(
        [{"id": 12, "created_at": "2024-01-01T00:00:02Z", "user": {"login": "b"}}]))
    _write(f"{root}/submission/pr=7/page-1.json", json.dumps(
        [{"id": 13, "submitted_at": "2024-01-01T00:00:03Z", "body": "", "user": {"login": "c"}},
         {"id": 14, "submitted_at": "2024-01-01T00:00:04Z", "body": "lgtm", "user": {"login": "c"}}]))
    feeds = [read_comment_pages(spark, root, f) for f in ("issue", "review", "submission")]
    c = CV.union_comments(feeds[0].unionByName(feeds[1]).unionByName(feeds[2]))
    got = sorted((r.uid, r.pr, r.body, r.author) for r in c.collect())
    assert got == [("issue-11", 7, "hi @assistant go", "a"), ("review-comment-12", 7, "", "b"),
                   ("review-submission-14", 7, "lgtm", "c")]


def test_plugin_embedder_and_context_styles(spark):
    from codelake.functions.prompts import render_context
    from codelake.operators.embed import embed_with

    calls = {"n": 0}

    def flaky(texts):
        calls["n"] += 1
        if any(t == "boom" for t in texts):
            raise RuntimeError("embedding failed")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "boom"), (3, "xyz")], "id bigint, t string")
    got = {r.id: r.embedding for r in embed_with(df, "t", flaky, sleep_s=0.0).collect()}
    assert got[1] == [2.0, 1.0] and got[2] is None and got[3] == [3.0, 1.0]
    blank = spark.createDataFrame([(1, None), (2, "  "), (3, " abc ")], "id bigint, t string")
    got = {r.id: r.embedding for r in embed_with(blank, "t", flaky, sleep_s=0.0, max_chars=2).collect()}
    assert got == {1: None, 2: None, 3: [2.0, 1.0]}

    def slow(texts):
        if "hang" in texts:
            import time
            time.sleep(5)
        return [[1.0] for _ in texts]

    some = spark.createDataFrame([(i, "hang" if i == 3 else "t") for i in range(8)], "id bigint, t string").coalesce(1)
    got = {r.id: r.embedding for r in embed_with(some, "t", slow, sleep_s=0.0, attempts=1, timeout_s=0.5, call_texts=4).collect()}
    assert got == {i: None if i == 3 else [1.0] for i in range(8)}
    meta = spark.createDataFrame([({"function": "f", "source_file": "a.cpp"}, "code")],
                                 "m map<string,string>, c string")
    feat = meta.select(render_context(F.col("c"), "features", F.col("m"))).first()[0]
    assert feat == "\nFUNCTION: f\nFEATURES: \nFILE: a.cpp\n\nCODE:\ncode\n"
    purp = meta.select(render_context(F.col("c"), "purpose", F.col("m"))).first()[0]
    assert purp.startswith("\nPURPOSE: \nKEYWORDS: \nCONTEXT: \nFILE: a.cpp")


def test_watcher_service(spark, tmp_dir):
    from codelake.session import checkpoint_dir

    root = os.path.join(tmp_dir, "landed")
    _write(f"{root}/issue/pr=3/page-1.json", json.dumps(
        [{"id": 1, "created_at": "2024-01-01T00:00:01Z", "body": "@assistant how to sort", "user": {"login": "a"}},
         {"id": 2, "created_at": "2024-01-01T00:00:02Z", "body": "/agent-coder\nrename x", "user": {"login": "a"}}]))
    for f in ("review", "submission"):
        _write(f"{root}/{f}/pr=3/page-1.json", "[]")
    out = os.path.join(tmp_dir, "replies")
    q = ST.start_watcher(spark, root, out, f"{checkpoint_dir(spark)}/watcher-{os.path.basename(tmp_dir)}",
                         poll="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.uid, r.kind, r.intent) for r in spark.read.parquet(out).collect())
    assert got == [("issue-1", "mention", "codeadvising"), ("issue-2", "agent", None)]


def test_bounded_dedupe_within_watermark(spark, tmp_dir):
    src = os.path.join(tmp_dir, "landed_wm")
    schema = "feed string, id bigint, pr bigint, created string, body string, author string"
    rows = [("issue", 1, 7, "2024-01-01T00:00:05Z", "@assistant a", "u"),
            ("issue", 1, 7, "2024-01-01T00:00:05Z", "@assistant a", "u"),
            ("issue", 2, 7, "2024-01-01T00:10:00Z", "@assistant b", "u")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = os.path.join(tmp_dir, "out_wm")
    ST.run_to_parquet(ST.dedupe_seen(CV.union_comments(stream), watermark="1 hour").select("uid"), out,
                      os.path.join(tmp_dir, "ck_wm"))
    assert sorted(r.uid for r in spark.read.parquet(out).collect()) == ["issue-1", "issue-2"]
