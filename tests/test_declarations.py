"""the names that declarations hold, by hand; renaming as a fold of whole-word replacements; cost in line with length."""

import re
import time

import pytest
from pyspark.sql import functions as F

from codelake.functions import declarations as D
from codelake.operators import codeeval as CE

CASES = [
    ("for (int i = 0, j = 1;;) { }", "i j"),
    ("auto [a, b] = f();", "a b f"),
    ("for (const auto& [k, v] : table) { use(k); }", ""),
    ("for (auto x : v) { y = 1; }", ""),
    ('const char* s = "int hidden = 1;"; // int gone = 2;', "s"),
    ("/* int a = 1; */ char c = ';'; int d;", "c d"),
    ("#define int q = 3;\nint r = R\"x(int m = 1; )\" int n;)x\";", "r"),
    ("void F::g ( int a ) { int tmp = a ; double z ; z = tmp ; }", "tmp z"),
    ("std::vector<std::pair<int, Foo>> v(n, x.size()); amr::Box bx = mfi.tilebox();", "bx mfi n v x"),
    ("int x(a * b); Foo y(m);", "a b m x y"),
    ("if (auto p = find(k); p) { }", "find k p"),
    ("int f(Foo x, int); Real g(const Box& b); return q;", "f g"),
    ("auto g = [=] (int u, Real w) { Real h = u; return h + k; };", "g h k"),
    ("int a[] = {x * y, z}; T *p = q, r{3};", "a p q r x y z"),
    ("a = b * c; x < y; foo(bar); return zed; delete s;", ""),
    ("A::A(int x) : b(x) { Box c = x; }", "c"),
    ("void (*cb)(int) = h;", "cb h"),
    ("auto s = p->len - > m + o.k + std::max(t, 1'000);", "max o p s t"),
    ("void f(const Foo& a, Bar b = c) { int d = a.e + b; }", "d"),
    ("struct P { int x; void m(int y) { int z = y; } }; class Q final { double w{2}; };", "z"),
    ("switch (n) { case 1: int a = 2; break; default: Real b; }", "a b"),
    ("if (x) int a = 1; else int b = 2; do Foo c = d; while (c);", "a b c d"),
    ("unsigned long long n = 3; static constexpr Real dt{0.5}; int é = n;", "dt n é"),
    ("return a; using B = C; typedef int T; throw e; goto out;", ""),
    ("ParallelFor(bx, [=] (int i) { Real t = s(i); });", "s t"),
    ("", ""), ("int", ""), ("int x", ""), (") ] } int a = (", "a"), ('int a = "open', "a"),
]


@pytest.mark.parametrize("code,names", CASES)
def test_names(code, names):
    assert D.locals_of(code) == sorted(names.split())


@pytest.mark.parametrize("code", [c for c, _ in CASES] + [
    "int A = 1, VAR1 = 2; VAR3 = A;", "int VAR2 = VAR1 + b; int B;", "int VAR3, VAR2, VAR1, A; VAR4 = VAR1;"])
def test_renaming_is_the_fold_of_whole_word_replacements(code):
    want = code
    for k, n in enumerate(D.locals_of(code), 1):
        want = re.sub(rf"\b{n}\b", f"VAR{k}", want)
    assert D.renamed(code) == want


def test_columns(spark):
    df = spark.createDataFrame([("int b = 1; b++;",), (None,), ("",)], "x string")
    got = df.select(CE.canonicalize_locals(F.col("x")).alias("y"), D.declared_locals(F.col("x")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("int VAR1 = 1; VAR1++;", ["b"]), (None, None), ("", [])]


@pytest.mark.parametrize("piece", ["int a = b < c; ", "(", "{", "a<", '"\\', "'", "auto f = [] (int q) { ", 'R"( ', "int f(a<", "/* "])
def test_cost_follows_length(piece):
    def cost(n):
        at = time.process_time()
        D.renamed(piece * n)
        return time.process_time() - at

    assert cost(40_000) < 10 * max(cost(10_000), 0.05)
