"""Operators whose results are exact: compared with plain versions."""

import random

import llm_plain as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import license_scan, mixing, near_dedup, nearest, pii, substring_dedup


def test_license_base_places(docs_of, corpus):
    rows = corpus + [(100, "Released under the MIT License. mit-license MIT\nLICENSE"), (101, "cc by cc by-nc 4.0"), (102, "the mit"),
                     (103, "GNU General Public License, apache license " * 3)]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        n, hits = brute.base_places(t)
        r = got[d]
        at = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(hits), min(at, default=None), max(at, default=None))
        labels = sorted({x for _, x in hits})
        assert r["base_labels"] == ",".join(labels)
        assert set(labels) <= set(r["labels"].split(",")) | ({""} - {""}) or not labels
        assert 0 <= r["score"] <= 1


def test_license_passage_with_edits(docs_of):
    text = license_scan.PASSAGES[0][0].split()
    edited = text[:10] + ["verily", "so"] + text[10:30] + text[32:]
    rows = [(1, "preface here " + " ".join(edited)), (2, " ".join(text[:12])), (3, "nothing of the kind")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and got[1]["score"] > 0.6
    assert got[2]["labels"] == "" and got[3]["score"] == 0


def test_repeated_rows_give_a_row_each(docs_of):
    rows = [(1, "mit license"), (1, "mit license"), (None, "apache license")]
    got = license_scan.scan(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in got) == [(0, 1), (1, 1), (1, 1)]


def test_near_duplicates(docs_of, corpus):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(corpus)).collect()}
    want = brute.components(corpus)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_copies_of_one_text_without_a_square(docs_of, prose):
    """A big family around one base: components are those of all pairs."""
    rnd = random.Random(9)
    base = prose(rnd, 150).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10 ** 6)}"
        rows.append((i * 7 % 151, " ".join(w[rnd.randint(0, 12):])))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute.components(rows).items()}


def test_near_duplicates_null_id_and_repeats(docs_of):
    t = "a b c d e f g h i j"
    rows = [(None, t), (None, t), (5, t), (5, t), (3, t), (9, "other words stand here now")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_duplicates(docs_of(rows)).collect())
    assert got == [(0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    left = near_dedup.keep_first(docs_of(rows))
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 9]
    assert left.columns == docs_of(rows).columns


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats_removed(docs_of, corpus, hot):
    got = substring_dedup.remove_repeats(docs_of(corpus), hot_documents=hot, group_windows=500).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.repeats_removed(corpus)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_removed_on_few_words(docs_of, seed):
    """A tiny alphabet makes repeats everywhere, within and across texts."""
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    got = substring_dedup.remove_repeats(docs_of(rows), window=5, gram=2, hot_documents=[3, 10, 100][seed], group_windows=50).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.repeats_removed(rows, 5)


def test_repeats_with_one_doc_id_and_null(docs_of, prose):
    p = prose(random.Random(1), 80)
    rows = [(2, p), (2, p), (2, "more " + p), (None, p), (1, "x " + p)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(rows)).collect())
    assert got == [(0, 80, 0), (1, 81, 0), (2, 80, 80), (2, 80, 80), (2, 81, 80)]


def _targets(sizes, weights, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_targets(docs_of, corpus):
    docs = docs_of(corpus * 3, sources=("b", "a", None, "é", "Z", "b", "b"))
    rows = docs.select("doc_id", "source").collect()
    for kw in ({}, {"block_words": 7, "shard_words": 500}):
        mix = mixing.mix(docs, **kw)
        got = mix.collect()
        assert len(got) == len(rows)
        assert sorted(got) == sorted(mixing.mix(docs, **kw).collect())
        by = {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by.setdefault((r["source_size"], r["target"]), []).append(r)
        sizes = {}
        for d, s in ((r["doc_id"], r["source"]) for r in rows):
            t = dict(corpus)[d]
            sizes[s] = sizes.get(s, 0) + len(brute.words(t))
        want = _targets(sizes, (5, 2, 1))
        assert sorted((k[0], round(k[1], 6)) for k in by) == sorted((sizes[s], round(t, 6)) for s, t in want.items())
        block = kw.get("block_words", mixing.BLOCK_WORDS)
        for (size, target), part in by.items():
            assert sum(r["size"] for r in part) == size
            shards = max(1, -(-size // kw.get("shard_words", mixing.SHARD_WORDS)))
            assert abs(sum(r["taken"] for r in part) - target) <= block * (shards + 1)


def test_apportionment_is_by_highest_quotients(spark):
    rnd = random.Random(2)
    votes = {i: rnd.choice([0.0, 1.0, 3.0, 1000.0]) * rnd.random() for i in range(40)}
    df = spark.createDataFrame([(0, i, v) for i, v in votes.items()], "g int, key int, v double")
    for seats in (1, 17, 500):
        best = sorted(((-v / (2 * j + 1), i, j) for i, v in votes.items() if v for j in range(seats)))[:seats]
        want = {i: sum(b[1] == i for b in best) for i in votes}
        for group in ([], ["g"]):
            got = mixing.apportion(df, "v", F.lit(seats), group, "key", "seats")
            assert {r["key"]: r["seats"] for r in got.collect()} == want


def _near(rows, every, k=5):
    out = []
    for q, x in rows:
        if q % every:
            continue
        s = sorted((-float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), c) for c, y in rows if c != q)
        out += [(q, i + 1, c, -v) for i, (v, c) in enumerate(s[:k])]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(24).tolist()) for i in range(400)]
    good[7] = (7, good[50][1])
    good[9] = (9, [2 * x for x in good[50][1]])
    bad = [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24), (1150, [1.0] * 23), (1200, []), (None, good[0][1]),
           (1250, [float("inf")] + [1.0] * 23), (1300, [None] + [1.0] * 23)]
    df = spark.createDataFrame([(i, v, 0, 0.5) for i, v in good + bad + good[:20]], "vec_id bigint, embedding array<double>, label int, score double")
    want = _near(good, 50)
    for kw in ({}, {"block_rows": 64, "block_queries": 3}):
        got = sorted(tuple(r) for r in nearest.search(df, F.col("vec_id") % 50 == 0, **kw).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r)[:3] for r in nearest.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert nearest.search(few.limit(0), F.col("vec_id") == 0).count() == 0


PII = ["mail a.b@c.de, x@@y.z q@w.e.r. (+49) 30", "+1 (743) 555-3824 and +12", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3",
       "4111 1111 1111 1111 4111-1111-1111-1112", "é+1 (843) 555-7672 170.106.47.2", "9" * 300 + ".1.1.1", "a@b.c@d.e", "+1" + "(" * 50 + "23456789",
       "no data", "", None, "x" * 2000 + "@" + "y" * 2000 + ".z", "4111111111111111" * 3, "1 " * 15 + "1"]


def test_pii_base_spans(docs_of):
    rnd = random.Random(3)
    texts = PII + ["".join(rnd.choice("01 4.-+@a()é") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t or "") == brute.pii_base(t), t
    got = {r["doc_id"]: r for r in pii.find(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = brute.pii_base(t)
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) or not base


def test_long_runs_of_one_word_make_no_large_group(docs_of):
    """Unlike texts with long runs of one word: runs count by their windows, and are few rows at full depth."""
    rows = [(i, f"start{i} " + "run " * (2_000 + i) + f"end{i}") for i in range(40)] + [(50 + i, ("w%d " % (i % 3)) * 300 + f"e{i}") for i in range(9)]
    want = brute.repeats_removed(rows)
    for most in (substring_dedup.HOT_WINDOWS, 500):
        got = substring_dedup.remove_repeats(docs_of(rows), hot_windows=most).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    prof = substring_dedup.profile(docs_of(rows).select("doc_id", "text"), 50, 8).select("doc_id", F.explode("found").alias("f"))
    marks = prof.groupBy("doc_id").agg(F.collect_set("f.prefix").alias("hot"))
    nodes = substring_dedup.full_depth(docs_of(rows).select("doc_id", "text").join(marks, "doc_id"), 50, 8)
    assert nodes.count() < 60 * 120 and nodes.agg(F.sum("n")).first()[0] > 40 * 1_900
