"""op13: the manifest against a plain recursion, and its defined cases."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from codelake.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, at string, digest int, path int, root string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, t, lang, source, n):
    return sha("".join(map(field, (d, source, lang, n, t))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i:i + 8])) for i in range(0, len(x), 8)])
    return levels


def path(levels, i):
    out = []
    for x in levels[:-1]:
        run = x[i // 8 * 8:i // 8 * 8 + 8]
        out.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        i //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        of = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((of, levels_of([leaf(*r) for r in of])))
    top = levels_of([t[-1][0] for _, t in trees])
    out = []
    for k, (of, t) in enumerate(trees):
        for i, r in enumerate(of):
            proof = path(t, i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if hit and r[1] is not None else r[1]
            cur = leaf(r[0], text, *r[2:])
            for a, b in proof:
                cur = sha(a + cur + b)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "r") for r in rows], SCHEMA).repartition(3)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_manifest_equals_plain_recursion(spark):
    rnd = random.Random(2)
    sizes = {"en": 600, None: 9, "": 1, "fr": 8, "ñ": 65, "ça": 1}
    rows = [(i * 7 + k, rnd.choice(["Text", "plain", None, "", "É Ω", "A" * 300_000 if i == 5 else "b"]), lang, rnd.choice(["s", None]), rnd.choice([3, None]))
            for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "a", "en", "s", 1), (None, None, None, None, None), (14, "Again", "en", "s", 1), (21, "same", "fr", "s", 1), (21, "same", "fr", "s", 1)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_one_row_one_tree_and_no_rows(spark):
    rows = [(3, "One Row", "en", "s", 7)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_one_key_in_very_many_rows_is_sorted_by_many_tasks(spark):
    rows = [(5, "same", "en", "s", 4)] * 700 + [(i, "t", "en", "s", 1) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_sweeps_hold_few_messages():
    leaves = [sha(str(i)) for i in range(300)]
    top, nodes = merkle.forward(leaves, 3)
    assert top == levels_of(leaves)[-1][0]
    assert [n[0] for n in nodes] == sorted(n[0] for n in nodes)
    proofs = merkle.backward(nodes, [], 300, 3)
    assert [[(p["left"], p["right"]) for p in x] for x in proofs] == [path(levels_of(leaves), i) for i in range(300)]
