"""F8-F16, P4-P6, W3, F17, F19, F22, F28/F29 golden cases."""

import random
import re

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.operators import codeeval as CE
from codelake.operators import traindata as TD
from codelake.operators import diffs as DF


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_mention_and_commands(spark):
    assert _one(spark, P.mention_prompt, "Hi @Assistant  do it ") == "do it"
    assert _one(spark, P.mention_prompt, "nothing here") is None
    assert _one(spark, P.agent_instruction, " /agent-coder\n fix x \n") == "fix x"
    assert _one(spark, P.agent_instruction, "/Agent-Coder") == "(no instruction)"
    assert _one(spark, P.agent_instruction, "x\n/agent-coder") is None
    assert _one(spark, P.compiler_block, "a\n/agent-build\nerr1\n /AGENT-BUILD again\nerr2") == "err1\nerr2"
    assert _one(spark, P.compiler_block, "/agent-build") is None


def test_intent_cascade_and_labels(spark):
    cases = {
        "ld returned 1 exit status": ("compilation", "compilation"),
        "give me starter code for a solver": ("scaffolding", "scaffolding"),
        "Give the code for x": (None, "codeadvising"),
        "give a sample code for x": ("codeadvising", None),
        "Implement a new method foo": (None, "codemodification"),
        "please modify this routine": ("code_generation", None),
        "what does this\nfunction do": (None, None),          # '.' stops at a newline
        "what does it do": ("explaining", "explaining"),
    }
    for text, (fort, cpp) in cases.items():
        assert _one(spark, lambda c: P.classify_intent(c, "fortran"), text) == fort, text
        assert _one(spark, lambda c: P.classify_intent(c, "cpp"), text) == cpp, text
    assert _one(spark, P.clean_task_label, "  add_member_variable: because") == "ADD_MEMBER_VARIABLE"
    assert _one(spark, P.clean_task_label, "something else") == "ADD_CLASS_METHOD"
    assert _one(spark, P.parse_intent_reply, '{"intent": "refactor"}') == "refactor"
    assert _one(spark, P.parse_intent_reply, "not json") == "codeadvising"
    assert _one(spark, P.parse_intent_reply, '{"intent": "dance"}') == "codeadvising"


def test_slots(spark):
    t = "Implement a new function in the Solver class in src/Solver.cpp\nfunction: go"
    assert _one(spark, P.extract_class, t) == "Solver"
    assert _one(spark, P.extract_file, t) == "src/Solver.cpp"
    assert _one(spark, P.extract_function, t) == "go"
    assert _one(spark, P.extract_class, " class : Foo_1\nfile: a.H") == "Foo_1"
    assert _one(spark, P.target_file, "write OUT.CPP now") == "OUT.CPP"
    assert _one(spark, P.strip_slot_lines, "class: A\n  file: b\nkeep\nfunction: f") == "keep"


def test_parse_pairs_golden(spark):
    files = {
        0: ["pre", "instruction: a", "x", "instruction: b", "mid", "response: inline", "y"],
        1: ["instruction:  spaced  ", "", "response:", "", "kept", "", ""],
        2: ["response: r", "no instruction"],
        3: ["instruction: one", "drop", "response: drop", "drop too", "response:", "last  ", " instruction: not at the start"],
        4: [],
        5: ["instruction: a", "instruction: b"],
    }
    df = spark.createDataFrame([(f, i, l) for f, ls in files.items() for i, l in enumerate(ls)], "doc_id bigint, line_no bigint, line string")
    by = {}
    for r in TD.parse_pairs(df, ["doc_id"]).orderBy("doc_id", "pair_no").collect():
        by.setdefault(r.doc_id, []).append((r.instruction, r.response))
    assert by == {0: [("a", "pre\nx"), ("b", "y")], 1: [("spaced", "kept")],
                  3: [("one", "last\n instruction: not at the start")], 5: [("a", ""), ("b", "")]}


def test_parse_pairs_round_trip(spark):
    """Pairs written out as text lines parse back to themselves."""
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(["alpha", "beta:", "response", "x"]) for _ in range(rnd.randint(1, 4)))
    want = {f: [(text(), "\n".join(text() for _ in range(rnd.randint(1, 3)))) for _ in range(rnd.randint(1, 4))] for f in range(60)}
    rows = []
    for f, ps in want.items():
        lines = [x for a, b in ps for x in (f"instruction: {a}", "noise", "response: noise", *("" for _ in range(rnd.randint(0, 2))), *b.split("\n"))]
        rows += [(f, i * 3, x) for i, x in enumerate(lines)]
    by = {}
    df = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, line string")
    for r in TD.parse_pairs(df, ["doc_id"]).orderBy("doc_id", "pair_no").collect():
        by.setdefault(r.doc_id, []).append((r.instruction, r.response))
    assert by == want


def test_clean_function_cases(spark):
    def expect(code):
        code = re.sub(r"\bamrex::", "", code)
        code = re.sub(r"#include\s*<[^>]+>", "", code)
        m = re.search(r"\b\w+::\w+\s*\([^)]*\)\s*\{", code)
        if not m:
            return code.strip()
        depth, end = 0, None
        for i in range(m.end() - 1, len(code)):
            depth += {"{": 1, "}": -1}.get(code[i], 0)
            if code[i] == "}" and depth == 0:
                end = i + 1
                break
        if end is None:
            return code.strip()
        f = re.sub(r" *\n", "\n", re.sub(r"[ \t]+", " ", code[m.start():end]))
        return f.strip()

    cases = ["no signature", "void A::b() { { }", "int A::b(int x) { if (x) { y(); } }  tail }",
             "#include <v.H>\namrex::Real F::g ()\n{\n  a  = 1;   \n}", "  A::b(){}  "]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r[0] for r in df.select(CE.clean_function("x")).collect()]
    assert got == [expect(c) for c in cases]


def test_canonicalize_locals(spark):
    code = "void F::g ( int a ) { int tmp = a ; double z ; z = tmp ; }"
    got = _one(spark, CE.canonicalize_locals, code)
    assert got == "void F::g ( int a ) { int VAR1 = a ; double VAR2 ; VAR2 = VAR1 ; }"


O, M, C = DF.MERGE_OPEN, DF.MERGE_MID, DF.MERGE_CLOSE


def _merge(spark, cases):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    return [r.merged for r in DF.conflict_merge(df, "a", "b").orderBy("i").collect()]


def test_conflict_merge_cases(spark):
    assert _merge(spark, [
        (["a", "b"], ["a", "x", "b"]),                 # insertion in the middle
        (["a", "b", "c"], ["a", "x", "c"]),            # replacement in the middle takes all the rest
        (["a", "b"], ["a"]),                           # deletion at the end
        (["a "], ["a"]), ([], []), (None, None),       # nothing changed
        ([], ["n"]), (["o"], []), (["a", "a"], ["x", "a", "y", "a", "z"]),
    ]) == [["a", O, "x", M, C, "b"], ["a", O, "x", "c", M, "b", "c", C], ["a", O, M, "b", C], None, None, None,
           [O, "n", M, C], [O, M, "o", C], [O, "x", M, C, "a", O, "y", M, C, "a", O, "z", M, C]]


def _merge_cases(n):
    rnd = random.Random(3)
    return [([rnd.choice("abc") for _ in range(rnd.randint(0, 6))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 6))])
            for _ in range(n)]


def test_conflict_merge_properties(spark):
    """Taking either side of every block gives back that side's lines; old lines stand in the last block only."""
    cases = _merge_cases(400)
    for (old, new), out in zip(cases, _merge(spark, cases)):
        assert (out is None) == (old == new)
        if out is None:
            continue
        ours, theirs, side = [], [], "both"
        blocks = 0
        for x in out:
            if x == O:
                side = "new"
            elif x == M:
                side = "old"
            elif x == C:
                side, blocks = "both", blocks + 1
            else:
                ours += [x] if side != "old" else []
                theirs += [x] if side != "new" else []
                assert side != "old" or blocks == out.count(O) - 1
        assert ours == new and theirs == old


def test_encode_fixed_and_mask(spark):
    df = spark.createDataFrame([([5, 1, 7],)], "ids array<int>")
    ids = df.select(TD.encode_fixed(F.col("ids"), n=6).alias("i")).first()[0]
    assert ids == [5, 1, 7, 1, 1, 1]
    lab = df.select(TD.mask_labels(TD.encode_fixed(F.col("ids"), n=6)).alias("l")).first()[0]
    # pad id equals the end-of-sequence id: a real token with that id is masked too
    assert lab == [5, -100, 7, -100, -100, -100]
    long = spark.createDataFrame([(list(range(2, 12)),)], "ids array<int>")
    assert long.select(TD.encode_fixed(F.col("ids"), n=4)).first()[0] == [2, 3, 4, 5]


def test_encode_whatever_the_join(spark):
    texts = spark.createDataFrame([(i, "the the the cat " * (i % 4) + f"w{i} the") for i in range(60)] + [(99, ""), (98, None)],
                                  "k bigint, text string")
    vocab = TD.build_vocab(texts, "text")
    ids = {r.token: r.id for r in vocab.collect()}
    want = {r.k: [ids[t] for t in (r.text or "").split()] for r in texts.collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert {r.k: list(r.ids) for r in TD.encode(texts, ["k"], "text", vocab).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert want[0] == [ids["w0"], 2]                                 # 'the' is the most frequent token


def test_windows_hold_the_whole_sequence(spark):
    df = spark.createDataFrame([(i, list(range(2, 2 + i))) for i in range(12)], "i int, ids array<int>")
    for r in df.select("i", "ids", TD.encode_windows(F.col("ids"), n=4).alias("w")).collect():
        flat = [x for w in r.w for x in w]
        assert all(len(w) == 4 for w in r.w) and len(r.w) == max(1, -(-r.i // 4))
        assert flat[:r.i] == r.ids and all(x == TD.PAD_ID for x in flat[r.i:])


def test_merge_oracle_agrees_with_merge_rule(spark):
    import duckdb

    from codelake.plans.codeeval_q import _sql_merge_core

    cases = _merge_cases(300)
    con = duckdb.connect()
    con.execute("create table cases(doc_id int, old varchar[], new varchar[])")
    con.executemany("insert into cases values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(cases)])
    got = dict(con.execute("with recursive " + _sql_merge_core("(select * from cases)")).fetchall())
    assert [got[i] for i in range(300)] == [None if x is None else "\n".join(x) for x in _merge(spark, cases)]


def test_intent_reply_must_be_one_json_value(spark):
    raw = ['{"intent": "compilation"}', ' {"intent": "compilation"}\n', '{"intent": "compilation"} trailing', "{'intent': 'compilation'}",
           '{"intent": "compilation"}, {}', '["compilation"]', '{"intent": 5}', "", "null", '{"a": {"intent": "compilation"}}', None]
    got = _col_of(spark, raw, P.parse_intent_reply)
    assert got == ["compilation"] * 2 + ["codeadvising"] * 9


def test_compile_flags_are_shell_words(spark):
    raw = ['g++ -DNAME=\\"x\\" -c f.cpp', "cc '-DTWO=a b' -I\"/inc dir\"/x", 'cc "-DQ=\\"q\\" \\n" -DA=\\ b -fopenmp', "", None]
    import shlex

    keep = lambda t: t.startswith(("-I", "-D", "-std=")) or t == "-fopenmp"
    got = _col_of(spark, raw, CE.compile_flags)
    assert got[:4] == [[t for t in shlex.split(x) if keep(t)] for x in raw[:4]]
    assert got[0] == ['-DNAME="x"']


def _col_of(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_coded_texts_share_dictionaries_by_block(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["a", "b", "c(", "dd", "é"]) for _ in range(rnd.randrange(12))) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    monkeypatch.setattr(TD, "BLOCK_TOKENS", 10)
    coded = TD.code_texts(df, ["k"], "text")
    assert coded.where("tokens is not null").count() > 20
    want = {k: re.findall(r"[A-Za-z0-9_]+|\S", t or "") for k, t in rows}
    vocab = TD.vocabulary(coded)
    ids = {r.token: r.id for r in vocab.collect()}
    counts = {r.token: r["count"] for r in vocab.collect()}
    assert counts == {t: sum(w.count(t) for w in want.values()) for t in ids}
    some = vocab.where("token <> 'b'")                  # a token the vocabulary lacks
    got = {r.k: list(r.ids) for r in TD.encode_coded(coded, ["k"], some).collect()}
    assert got == {k: [TD.UNK_ID if t == "b" else ids[t] for t in w] for k, w in want.items()}
    assert TD.encode_coded(TD.code_texts(df.limit(0), ["k"], "text"), ["k"], vocab).collect() == []
