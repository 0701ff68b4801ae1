"""W1/W2/F2/F3/A8/S2/W5 golden cases, and properties that hold for any file."""

import random

from pyspark.sql import functions as F

from codelake.operators import chunking as C


def _lines_df(spark, files: dict[int, list[str]]):
    rows = [(fid, i, line) for fid, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id bigint, line_no bigint, line string")


def _chunks(spark, files):
    out = C.chunk_cpp(_lines_df(spark, files), ["doc_id"]).orderBy("doc_id", "chunk_no").collect()
    return {fid: [r for r in out if r.doc_id == fid] for fid in files}


def test_cpp_golden_markers(spark):
    f = [
        "int before;                 // text before the first marker is dropped",
        "// plain comment",
        "// AI_METADATA",             # opens: first marker of this comment run
        "// AI_METADATA",             # same run: metadata, not a new chunk
        "//AI_METADATA",              # no space: not a marker
        "// user_intent: inline dropped",
        "// add two numbers",
        "// key: a:b",
        "// key: second wins",
        "// language: override",
        "",
        "    int add(int a, int b) {",
        "        return a + b;",
        "    }",
        "// AI_METADATA",
        "",                           # blank line between marker and header: code starts here
        "// user_intent:",
        "x",
    ]
    got = _chunks(spark, {1: f})[1]
    assert len(got) == 2
    m = dict(got[0].metadata)
    assert m["user_intent"] == "add two numbers"
    assert m["key"] == "second wins"
    assert m["language"] == "override"
    assert got[0].code == "\nint add(int a, int b) {\n    return a + b;\n}"
    assert dict(got[1].metadata)["user_intent"] == ""
    assert got[1].code == "\n// user_intent:\nx"


def test_cpp_fixed_keys_overridden(spark):
    df = _lines_df(spark, {7: ["// AI_METADATA", "// language: c++17", "code"]}).withColumn("src", F.lit("ex"))
    fixed = {"example": F.col("src"), "language": F.lit(".cpp")}
    r = C.chunk_cpp(df, ["doc_id"], fixed).collect()[0]
    assert dict(r.metadata) == {"example": "ex", "language": "c++17", "user_intent": ""}


def _random_files(pool, seed, size):
    rnd = random.Random(seed)
    return {i: [rnd.choice(pool) for _ in range(rnd.randint(0, size))] for i in range(300)}


CPP_POOL = ["// AI_METADATA", "//AI_METADATA", "  // AI_METADATA x", "// user_intent:", "// intent words",
            "// k: v", "// k2: v: w", "// note", "", "   ", "\tcode();", "  int x;", "}", "// AI_METADATA"]


def test_cpp_lines_are_conserved(spark):
    """Every line has exactly one role; what follows the first marker is marker, metadata or code, in order."""
    files = _random_files(CPP_POOL, 7, 25)
    marked = C.mark_cpp_lines(_lines_df(spark, files), ["doc_id"]).orderBy("doc_id", "line_no").collect()
    by = {f: [r for r in marked if r.doc_id == f] for f in files}
    for f, lines in files.items():
        rows = by[f]
        assert [r.line for r in rows] == lines
        opened = [i for i, r in enumerate(rows) if r.role == "marker"]
        assert all(r.role == "none" for r in rows[:opened[0] if opened else None])
        # one marker per run of comment lines, and it is the run's first
        for i in opened:
            j = i
            while j and lines[j - 1].strip().startswith("//"):
                j -= 1
                assert not lines[j].strip().startswith("// AI_METADATA")
        for r, s in zip(rows, lines):
            assert r.role != "meta" or s.strip().startswith("//")
            assert r.role == "none" or r.chunk_no == sum(i <= r.line_no for i in opened)
        for i in range(1, len(rows)):
            if rows[i].role == "meta":
                assert rows[i - 1].role in ("marker", "meta")


def test_cpp_rechunking_a_chunk_is_stable(spark):
    """Marker, metadata and code of a chunk, put back together, chunk to the same code."""
    files = {f: lines for f, lines in _random_files(CPP_POOL, 8, 12).items()}
    for r in spark.createDataFrame([(1,)], "x int").collect():
        first = [c for cs in _chunks(spark, files).values() for c in cs]
    again = _chunks(spark, {i: ["// AI_METADATA", "// user_intent:", "// " + (c.user_intent.replace("\n", " ") or "z"), ""] + c.code.split("\n")
                            for i, c in enumerate(first) if "AI_METADATA" not in c.code})
    for i, got in again.items():
        assert len(got) == 1 and got[0].code == "\n" + first[i].code


def test_fortran_golden(spark):
    f = [
        "! PURPOSE: compute flux",
        "! KEYWORDS: a, b ,, c",
        "! continues purpose after keywords",
        "! CONTEXT: solver",
        "! continues context",
        "module procedure  p1 &",
        "x = 1",
        "! END CODE CHUNK",
        "after end is dropped",
        "! purpose: second",
        "! END CODE CHUNK",
    ]
    rows = C.chunk_fortran(_lines_df(spark, {1: f}), ["doc_id"]).orderBy("chunk_no").collect()
    a, b = rows
    assert a.purpose == "compute flux continues purpose after keywords"
    assert list(a.keywords) == ["a", "b", "c"]
    assert a.context == "solver continues context"
    assert a.procedure == "p1"
    assert a.code == "module procedure  p1 &\nx = 1"
    # an END marker right after the header is header text
    assert b.purpose == "second END CODE CHUNK" and b.code == "" and b.procedure is None


def test_explode_lines_and_offsets(spark):
    df = spark.createDataFrame([(1, "a\r\nbb\n\nccc\n"), (2, ""), (3, "x\ry")], "doc_id bigint, text string")
    lines = C.explode_lines(df, "text", ["doc_id"])
    got = sorted((r.doc_id, r.line_no, r.line) for r in lines.collect())
    assert got == [(1, 0, "a"), (1, 1, "bb"), (1, 2, ""), (1, 3, "ccc"), (3, 0, "x"), (3, 1, "y")]
    offs = {(r.doc_id, r.line_no): r.offset for r in C.line_offsets(lines, ["doc_id"]).collect()}
    assert offs[(1, 0)] == 0 and offs[(1, 1)] == 2 and offs[(1, 3)] == 6


def test_dedent_matches_textwrap(spark):
    import textwrap

    cases = ["    a\n      b\n    c", "\ta\n\t\tb", "  a\n\tb", "   \n    a\n    b", "", "x\n  y", "  \t a\n  \t b"]
    from codelake.functions.text import dedent

    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(dedent("t")).collect()]
    assert got == [textwrap.dedent(c) for c in cases]


FORTRAN_POOL = ["! PURPOSE: p", "! purpose: q r", "! KEYWORDS: a, b", "!keywords: c", "! CONTEXT: ctx", "! more",
                "!", "module procedure x &", "  MODULE PROCEDURE y", "x = 1", "", "! END CODE CHUNK", "  ! end code chunk "]


def test_fortran_properties(spark):
    """One chunk per purpose line; code is one contiguous stretch of the chunk's own lines without an end marker."""
    files = _random_files(FORTRAN_POOL, 11, 20)
    rows = C.chunk_fortran(_lines_df(spark, files), ["doc_id"], {"example": F.lit("ex")}).collect()
    for f, lines in files.items():
        got = sorted((r for r in rows if r.doc_id == f), key=lambda r: r.chunk_no)
        starts = [i for i, x in enumerate(lines) if x.lower().startswith("! purpose:")]
        assert len(got) == len(starts)
        for r, a, b in zip(got, starts, [*starts[1:], len(lines)]):
            own = "\n".join(lines[a:b])
            assert r.purpose.startswith(lines[a].split(":")[1].strip())
            assert r.code in own and "end code chunk" not in r.code.lower()
            assert not r.code or not r.code.split("\n")[0].strip().startswith("!")
            assert set(r.keywords) <= {"a", "b"} and (r.procedure or "x") in ("x", "y")
            assert dict(r.metadata) == {"example": "ex", "procedure": r.procedure or "", "purpose": r.purpose,
                                        "keywords": ", ".join(r.keywords), "context": r.context}


def test_fortran_embedding_limit_is_an_argument(spark):
    f = ["! PURPOSE: p", *[f"x{i} = 1" for i in range(200)]]
    whole, part = (C.chunk_fortran(_lines_df(spark, {1: f}), ["doc_id"], embed_lines=n).first().embedding_text for n in (None, 80))
    assert whole.count(" = 1") == 200 and part.count(" = 1") == 80


def test_fixtures_keep_every_character(spark):
    """Marker lines are added to the texts, never put in their place."""
    from codelake.plans import fixtures as D

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for make, strip in ((D.d1_cpp_lines, ("// ", "    ")), (D.d3_fortran_lines, ("! PURPOSE: ", "")), (D.d8_pair_lines, ("instruction: ", ""))):
        rows = {}
        for r in make(spark, sf).orderBy("doc_id", "line_no").collect():
            rows.setdefault(r.doc_id, []).append(r.line)
        for d, t in texts.items():
            left = iter(rows[d])
            for x in t.split("\n"):
                assert any(y in (strip[0] + x, strip[1] + x) for y in left), (make, d, x)


def test_offsets_count_the_file_own_breaks(spark):
    import random as rnd_

    rnd = rnd_.Random(5)
    texts = ["ab\r\ncd\r\nef", "", "\r\n", "a\x0cb\u2028c", "x\n"] + [
        "".join(rnd.choice(["ab", "\n", "\r\n", "\r", "\x0b", "é"]) for _ in range(rnd.randint(0, 9))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in C.file_line_offsets(df, "t", ["i"]).orderBy("i", "line_no").collect():
        got.setdefault(r.i, []).append(r.offset)
    assert got[0] == [0, 4, 8]
    for i, t in enumerate(texts):
        kept = t.splitlines(keepends=True)
        assert got.get(i, []) == [sum(map(len, kept[:k])) for k in range(len(kept))]


def _file_df(spark, files):
    return spark.createDataFrame(list(files.items()), "doc_id bigint, lines array<string>").repartition(4, "doc_id")


def test_files_and_lines_give_the_same_cpp_chunks(spark):
    files = _random_files(CPP_POOL, 21, 30)
    fixed = {"language": F.lit(".cpp")}
    a = C.chunk_cpp(_lines_df(spark, files), ["doc_id"], fixed)
    b = C.chunk_cpp_files(_file_df(spark, files), ["doc_id"], fixed)
    assert a.columns == b.columns
    key = lambda r: (r.doc_id, r.chunk_no)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    assert "Exchange" not in C.chunk_cpp_files(spark.range(3).select("id", F.array(F.lit("x")).alias("lines")), ["id"]) \
        ._jdf.queryExecution().executedPlan().toString()


def test_files_and_lines_give_the_same_fortran_chunks(spark):
    files = _random_files(FORTRAN_POOL, 22, 30)
    fixed = {"example": F.lit("ex")}
    a = C.chunk_fortran(_lines_df(spark, files), ["doc_id"], fixed)
    b = C.chunk_fortran_files(_file_df(spark, files), ["doc_id"], fixed)
    assert a.columns == b.columns
    key = lambda r: (r.doc_id, r.chunk_no)
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)
    assert "Exchange" not in C.chunk_fortran_files(spark.range(3).select("id", F.array(F.lit("x")).alias("lines")), ["id"]) \
        ._jdf.queryExecution().executedPlan().toString()


def test_files_and_lines_give_the_same_pairs(spark):
    from codelake.operators import traindata as TD

    files = _random_files(["instruction: q", "instruction:", "response: r", "response:", "text", "", "  indented  ", " instruction: no"], 23, 14)
    a = TD.parse_pairs(_lines_df(spark, files), ["doc_id"])
    b = TD.parse_pairs_files(_file_df(spark, files), ["doc_id"])
    got = [sorted(map(tuple, d.select("doc_id", "pair_no", "instruction", "response").collect())) for d in (a, b)]
    assert got[0] == got[1]
