import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SYLLABLES = ["er", "in", "the", "on", "an", "re", "ti", "la", "que", "ou", "ñé", "Th", "de."]


@pytest.fixture(scope="session")
def prose():
    def make(rnd, n):
        return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """Rows (doc_id, text) with copies, near copies, shared passages, short, empty and null texts."""
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.choice([3, 20, 60, 150, 300]))) for i in range(40)]
    shared = prose(rnd, 70)
    for i in range(40, 60):
        w = rows[rnd.randrange(40)][1].split(" ")
        kind = i % 4
        if kind == 0:
            rows.append((i, " ".join(w)))
        elif kind == 1:
            w[rnd.randrange(len(w))] = "changed"
            rows.append((i, "\t ".join(w)))
        elif kind == 2:
            rows.append((i, prose(rnd, 30) + "\n" + shared + " " + prose(rnd, 40)))
        else:
            rows.append((i, " ".join(w[: len(w) * 9 // 10]).upper()))
    rows += [(60, ""), (61, None), (62, "  \n\t"), (63, "one"), (64, "one"), (65, "a b c d"), (66, "A b  c d"),
             (67, "x " * 400), (68, "x " * 300), (69, prose(rnd, 5000)), (70, " nbsp em \x1cfs"), (71, "w" * 5000)]
    return rows


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names clash with the operators' own."""
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, n int, rank string, "
              "words int, row int, pos int, comp int, prefix int, held int, x int, key int, label int, c int, kept int")

    def make(rows, sources=("a", "b", None)):
        return spark.createDataFrame([(d, t, "en", sources[i % len(sources)], len(t or ""), *([1, "s", 1, "r"] + [7] * 11))
                                      for i, (d, t) in enumerate(rows)], schema).repartition(3)
    return make
