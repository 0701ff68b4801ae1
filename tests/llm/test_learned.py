"""Operators with trained parts: their exact columns, held-out quality, and behaviour on odd input."""

import random

import llm_plain as brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelake.llm import class_lm, decontaminate, pii, quality, queries, secret_scan

SF = "/root/testdata/sf0.01"


def test_class_lm_base_columns_and_sum_to_one(docs_of, corpus):
    rows = corpus + [(None, "one two")]
    got = class_lm.score(docs_of(rows), queries._remainder(5, 1), classes=8, exchange_words=64, rounds=2).collect()
    held = [brute.remainder("" if d is None else d, 5) == 1 for d, _ in rows]
    want = {d: w for (d, _), w in zip(rows, brute.unigram(rows, held))}
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_class_lm_is_a_distribution():
    """Over all known words, the end and one unseen word, probabilities of what may follow add up to one."""
    rng = np.random.default_rng(0)
    c = np.array([5, 1, 7, 2, 0])
    cls = np.array([1, 1, 2, 2, 1], np.uint8)
    n = np.zeros((3, 3))
    n[0, 1], n[0, 2], n[1, 1], n[1, 2], n[2, 2], n[2, 0], n[1, 0] = 2, 1, 2, 3, 5, 2, 1
    n[1, 1] = 6 - n[0, 1] - n[2, 1]
    n[2, 2] = 9 - n[0, 2] - n[1, 2]
    n[2, 0] = 3 - n[1, 0]
    m = class_lm.Model(n, int(c.sum()) + 3, 5, 1, 3)
    for context in rng.permutation(5):
        total = 0.0
        for w in [*range(5), None]:
            row = {"held": [False], "lens": [1 + (w is not None)], "tokens": class_lm.pack(np.array([context] + ([w] if w is not None else []), np.uint32))}
            ch = class_lm._Chunk(row)
            _, _, best = m.rate(ch, cls, c)
            if w is None:
                total += 10 ** best[0] / head(m, cls, c, context)
            else:
                close = 10 ** np.log10(m.next[cls[w], 0] * (1 - m.unseen)) if c[w] else m.freq[0] * (1 - m.unseen)
                total += 10 ** best[0] / close / head(m, cls, c, context)
        assert total == pytest.approx(1.0, abs=1e-9)


def head(m, cls, c, w):
    """The probability of the first word of a text."""
    return (1 - m.unseen) * m.next[0, cls[w]] * c[w] / m.size[cls[w]] if c[w] else m.unseen


def test_class_lm_beats_unigrams_on_held_out_text(spark):
    r = queries.op4_class_lm(spark, SF).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r["s"] > r["b"] * 0.9


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    classes, words = 5, 40
    true = rng.integers(1, classes, words)
    seq, last = [], 1
    for _ in range(20000):
        last = last % (classes - 1) + 1
        seq.append(rng.choice(np.flatnonzero(true == last)))
    seq = np.array(seq)

    def counts(cls):
        s, g = classes + 1, np.concatenate([[0], cls[seq], [0]])
        pairs = np.bincount(g[:-1] * s + g[1:], minlength=s * s).reshape(s, s)
        w = np.zeros((words, 2 * s), np.int64)
        np.add.at(w, (seq, g[:-2]), 1)
        np.add.at(w, (seq, s + g[2:]), 1)
        return pairs, w

    def likelihood(p):
        x = class_lm._xlogx
        return x(p.astype(float)).sum() - x(p.sum(0).astype(float)).sum() - x(p.sum(1).astype(float)).sum()

    cls = rng.integers(1, classes, words)
    before = likelihood(counts(cls)[0])
    for _ in range(4):
        cls = class_lm.exchange(*counts(cls), cls, classes)
    assert likelihood(counts(cls)[0]) > before


def _leaky(prose, seed=6):
    rnd = random.Random(seed)
    items = [(i, prose(rnd, rnd.choice([4, 9, 20, 45]))) for i in range(30)] + [(30, None), (31, ""), (None, "some item without an id in it at all"), (33, "--")]
    rows, want = [], set()
    for d in range(120):
        body = prose(rnd, rnd.randint(0, 200))
        if d % 3 == 0:
            i = d // 3 % 30
            w = items[i][1].split(" ")
            for _ in range(d % 2 * max(0, int(0.1 * len(w)))):
                w[rnd.randrange(len(w))] = "edited"
            body += " ... " + " ".join(w).replace("e", "E").replace("t", "T") + "!\n" + prose(rnd, 60)
            want.add((d, i))
        rows.append((d, body))
    return items, rows, want


def test_leaks_are_found_and_verified(spark, docs_of, prose):
    items, rows, want = _leaky(prose)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of(rows + [(500, None), (501, ""), (501, "")])
    got = decontaminate.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    long = {(d, i) for d, i in want if len(items[i][1].split()) >= 9}
    assert len(long - found) <= 0.02 * len(long)
    texts = dict(rows)
    for r in got:
        w = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.fold(texts[r["doc_id"]]))
        item = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.fold(dict(items)[r["item_id"]]))
        assert _edits(item, w[r["first_word"]:r["end_word"]]) == r["edits"] <= 0.2 * len(item)
    clean = {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in found} | {500, 501}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_walk_coordinates_of_equal_windows_agree():
    h = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([h, h])
    k = decontaminate.walk_keys(twice, np.arange(len(twice)), 0, 16)
    assert (k[:30] == k[59:89]).all() and len(set(k[:30].tolist())) > 10


def test_secrets_held_out(spark):
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    fresh = secret_scan.labelled_findings(spark, 4000).where("md5(text) < '4'").withColumn("text", F.concat(F.lit("then "), F.col("text")))
    d = secret_scan._split(fresh, "value", "label").withColumnRenamed("value", "secret")
    d = d.select("secret", "label", F.transform(secret_scan._findings(d, forest, 0.5), lambda c: c["value"]).alias("found"))
    r = d.agg(F.avg(F.when(F.col("label"), F.array_contains("found", F.col("secret")).cast("double"))).alias("recall"),
              F.avg(F.when(~F.col("label"), (F.size("found") > 0).cast("double"))).alias("false")).first()
    assert r["recall"] > 0.95 and r["false"] < 0.05


def test_secrets_on_odd_input(spark, docs_of):
    key = "AKIA" + "Q3RTY7ZXCVBNM4KP"
    rows = [(1, f"use {key} here"), (2, None), (3, ""), (4, 'token = "' + "0a1b2c3d4e" * 4 + '"### and more'), (5, "plain words " * 3000),
            (6, "commit " + "0a1b2c3d4e" * 4), (1, f"use {key} here"), (None, f"{key}\n")]
    docs = docs_of(rows)
    found = [(r["doc_id"], r["word"], r["kind"]) for r in secret_scan.scan(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, "aws_access_key"), (1, 1, "aws_access_key"), (4, 2, "token"), (None, 0, "aws_access_key")], key=str)
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[1]["text"] == "use [SECRET] here" and texts[1]["n_chars"] == 17 and texts[2]["text"] is None
    assert texts[4]["text"] == 'token = "[SECRET]"### and more' and texts[6]["text"] == rows[5][1] and texts[5]["text"] == rows[4][1]


def test_forest_walk_matches_plain_walk(spark):
    forest = secret_scan.Forest(["x\n If (feature 0 <= 0.5)\n  Predict: 0.0\n Else (feature 0 > 0.5)\n  If (feature 1 <= 2.0E-1)\n   Predict: 1.0\n"
                                 "  Else (feature 1 > 2.0E-1)\n   Predict: 0.0\n", "y\n Predict: 1.0\n"])
    df = spark.createDataFrame([(0.0, 0.1), (1.0, 0.1), (1.0, 0.3)], "a double, b double")
    assert [r[0] for r in df.select(forest.vote(F.array("a", "b"))).collect()] == [0.5, 1.0, 0.5]


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality(spark, SF).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert r > 0.95


def test_quality_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = queries._remainder(4, 2)
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(map(tuple, quality.classify(docs, x, held).select("doc_id", "score").collect())) for x in (labels, other))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_quality_on_odd_input(spark, docs_of, corpus):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id bigint, quality int")
    got = quality.classify(docs_of(corpus + [(1, "again")]), labels, queries._remainder(4, 2)).collect()
    assert len(got) == len(corpus) + 1 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.classify(docs_of(corpus), labels.limit(0), queries._remainder(4, 2)).collect()
    assert {r["score"] for r in none} == {0.5}
    x = quality.features(pa.array([None, "", " ", "word", "w" * 9000, "A!! B!!" * 50]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def test_pii_added_spans():
    model = pii.train()
    rows = pii.labelled_spans(2000, seed=77)
    hit = np.array([any(a < e and s < b for _, s, e in pii.added_spans(t, [], model)) for t, _, a, b, _ in rows])
    y = np.array([r[4] for r in rows]) == 1
    assert hit[y].mean() > 0.9 and hit[~y].mean() < 0.1
    t = "call me at (743) 555-3824 or write jo [at] host [dot] com"
    assert pii.written(pii.added_spans(t, [], model)).count("phone") == 1


def test_empty_tables(spark, docs_of, corpus):
    from codelake.llm import license_scan, mixing, near_dedup, substring_dedup

    none = docs_of(corpus).limit(0)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for df in (license_scan.scan(none), near_dedup.near_duplicates(none), class_lm.score(none, queries._remainder(5, 1)),
               decontaminate.leaks(none, bench), mixing.mix(none), secret_scan.scan(none), secret_scan.redact(none),
               quality.classify(none, labels, queries._remainder(4, 2)), quality.keep_good(none, labels, queries._remainder(4, 2)),
               pii.find(none), pii.redact(none), substring_dedup.remove_repeats(none)):
        assert df.collect() == []
    assert decontaminate.leaks(docs_of(corpus), bench.limit(0)).collect() == []
    assert decontaminate.without_leaks(docs_of(corpus), bench.limit(0)).count() == len(corpus)


def test_leaks_of_every_item_length_are_found_in_running_text():
    """Exact copies of short items always, copies with as many edits as allowed with the target recall, per length."""
    rnd = np.random.default_rng(8)
    other = lambda n: rnd.integers(1, 2 ** 62, n).astype(np.uint64)
    sizes = (1, 2, 3, 4, 5, 9, 12, 15, 20)
    items = [other(n) for n in sizes for _ in range(20)] + [other(60) for _ in range(150)]
    index = decontaminate.Index(list(range(len(items))), items, 0.2, 0.99)
    for n in sizes:
        missed, copies = 0, [i for i, w in enumerate(items) if len(w) == n] * 15
        for i in copies:
            copy = decontaminate.edit(items[i], int(0.2 * n), rnd)
            text = np.concatenate([other(30), copy, other(30)])
            item, start = index.search(text)
            near = start[(item == i) & index.plausible(text, item, start)]
            missed += not any(index.verified(i, text, int(s)) for s in near)
        assert missed <= (0 if n < 5 else 0.02 * len(copies)), n
    items = [other(n) for n in (3, 4) for _ in range(100)]
    index = decontaminate.Index(list(range(200)), items, 0.2, 0.99)
    assert all((i, 30) in zip(*map(list, index.search(np.concatenate([other(30), w, other(30)])))) for i, w in enumerate(items))


def test_lengths_that_walks_do_not_find_are_found_by_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_REPEATS", 0)
    rnd = np.random.default_rng(9)
    items = [rnd.integers(1, 2 ** 62, n).astype(np.uint64) for n in (5, 14, 33)]
    index = decontaminate.Index([0, 1, 2], items, 0.2, 0.99)
    assert index.repeats == {5: 0, 14: 0, 33: 0}
    for i, w in enumerate(items * 40):
        text = np.concatenate([items[0][::-1], decontaminate.edit(w, int(0.2 * len(w)), rnd), items[1][::-1]])
        item, start = index.search(text)
        assert any(index.verified(i % 3, text, int(s)) for s in start[(item == i % 3) & index.plausible(text, item, start)])


def test_pii_prefilter_drops_no_candidate():
    for t in ("jane.doe { at } mail.org", "jane.doe {AT} mail.org", "jane.doe ( AT ) mail.org", "jane.doe(At)mail.org", "jane.doe AT mail DOT com",
              "jane.doe [at ] mail [ DOT] org", "jane.doe {aT}mail.org", "meet at noon", "a DOT b", "(at) the", "jane at mail dot com", "İo (at) x.org",
              "jane.doe (at) maſl.org", "jane.doe at mail dot Kom"):
        assert [c for c in pii.candidates(t) if c[0] == "email"] == [(k, m.start(), m.end()) for k, p in pii._SPELLED for m in p.finditer(t)], t
    model = pii.train()
    assert pii.added_spans("write to jane.doe {AT} mail.org today", [], model) == [("email", 9, 31)]


def test_whole_values_after_a_key_word(spark, docs_of):
    rows = [(1, "password=P@ss!w0rd#24"), (2, "then password=Summer2024!x$Kq9 and"), (3, 'db_password: "x7#kQ!" and a x7#kQ!'), (4, "pwd = hu7!x"),
            (5, "the password: required and the key: value of it"), (6, '{"user":"a","password":"q9$Z!","n":"q9"}'), (7, "author: the, password=${PASSWORD} or <none>"),
            (8, "passwd 'k3#Lp!9z'\tthere"), (9, "the password:"), (10, "password=")]
    docs = docs_of(rows)
    got = {r["doc_id"]: (r["word"], r["kind"], r["length"]) for r in secret_scan.scan(docs).collect()}
    assert got == {1: (0, "password", 12), 2: (1, "password", 16), 3: (1, "password", 6), 4: (2, "password", 5), 6: (0, "password", 5), 8: (1, "password", 8)}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert clean[1] == "password=[SECRET]" and clean[2] == "then password=[SECRET] and" and clean[8] == "passwd '[SECRET]'\tthere"
    assert clean[3] == 'db_password: "[SECRET]" and a x7#kQ!' and clean[4] == "pwd = [SECRET]" and clean[6] == '{"user":"a","password":"[SECRET]","n":"q9"}'
    assert all(clean[i] == dict(rows)[i] for i in (5, 7, 9, 10))
