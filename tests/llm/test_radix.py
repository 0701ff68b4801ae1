"""op11: removed bytes against brute force, over every pass, and the defined cases."""

import hashlib
import random

import numpy as np
import pytest

from codelake.llm import radix_dedup as rd


def brute(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - depth + 1):
            seen[t[i:i + depth]] = seen.get(t[i:i + depth], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of_every_kind():
    rnd = random.Random(8)

    def text(n, letters="abcdé \n"):
        return "".join(rnd.choice(letters) for _ in range(n))

    passage = text(50)
    rows = [(i, text(rnd.choice([0, 10, 19, 20, 21, 60, 200]))) for i in range(30)]
    rows += [(100 + i, text(rnd.randint(0, 25)) + passage[:rnd.randint(18, 50)] + text(rnd.randint(0, 25))) for i in range(60)]
    rows += [(200 + i, "x" * n) for i, n in enumerate([19, 20, 21, 40, 9000, 9001])] + [(210, "ab" * 300), (211, "ba" * 100 + "c"), (212, "abc" * 50)]
    rows += [(220 + i, rows[20 + i % 3][1]) for i in range(12)] + [(240 + i, passage + "!" * i) for i in range(6)]
    rows += [(250, None), (251, ""), (None, passage), (None, None), (7, passage + "z"), (7, passage + "z"), (7, "other" + passage)]
    rows += [(260, text(3000, "ab")), (261, text(3000, "ab")), (262, "𝒳" * 30), (263, text(30_000))]
    return rows


@pytest.mark.parametrize("depth,grams,group", [(20, (8,), 10_000), (20, (8, 12, 16), 1), (24, (8, 16), 60), (9, (8,), 5), (200, rd.GRAMS, rd.GROUP_WINDOWS)])
def test_removed_bytes_equal_brute_force(docs_of, depth, grams, group):
    rows = rows_of_every_kind()
    got = rd.removed(docs_of(rows), depth, grams, group)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, depth)


def test_spans_and_kept_bytes(docs_of):
    rows = rows_of_every_kind()
    texts = {}
    for r in rd.without_repeats(docs_of(rows), 20, (8, 16), 50).collect():
        texts.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        if d in (None, 7):                       # several rows
            continue
        [r] = texts[d]
        own = (t or "").encode()
        keep = b"".join(own[a:b] for a, b in zip([0] + [s["hi"] for s in r["spans"]], [s["lo"] for s in r["spans"]] + [len(own)]))
        assert keep == (own if r["kept"] is None else bytes(r["kept"])), d


def test_no_rows(docs_of, spark):
    assert rd.removed(docs_of([(1, "a")]).limit(0)).collect() == []
    assert [tuple(r)[:4] for r in rd.removed(docs_of([(1, None)])).collect()] == [(1, 0, 0, 0)]


def test_many_rows_of_one_key_and_text(docs_of):
    rows = [(5, "k" * 15 + str(i % 2) * 15) for i in range(400)] + [(i, "k" * 15 + chr(65 + i) * 20) for i in range(20)]
    assert sorted(map(tuple, rd.removed(docs_of(rows), 20, (8,), 50).collect()), key=repr) == brute(rows, 20)


def test_long_texts_of_one_letter_are_few_stretches():
    buf = np.full(100_000, 65, np.uint8)
    first, count, g, code, twice = rd._found(buf, np.arange(len(buf)) < len(buf) - 199, 32, 200)
    assert len(first) < 40 and count.sum() == len(buf) - 199 and twice.all()
    assert len(set(zip(g, code))) <= 3


def test_chunks_do_not_change_the_windows(monkeypatch):
    rnd = np.random.default_rng(1)
    buf = rnd.integers(0, 3, 5000).astype(np.uint8)
    ok = np.arange(len(buf)) < 4981
    whole = rd._found(buf, ok, 8, 20)
    monkeypatch.setattr(rd, "CHUNK", 700)
    cut = rd._found(buf, ok, 8, 20)
    names = [np.repeat(x[2], x[1]) for x in (whole, cut)]
    assert (names[0] == names[1]).all() and whole[1].sum() == cut[1].sum() == 4981
