"""Contents are read from kept folders only."""

import os

from codelake.sources.corpus import scan_code_corpus


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_files_under_excluded_folders_are_not_read(spark, tmp_dir):
    root = os.path.join(tmp_dir, "a tree")
    for name in ("a/main.cpp", "a/src {1}/x*.H", "b/inputs", "b/deep/er/f.F90", "b/notes.md", "top.cpp"):
        _write(f"{root}/{name}", f"text of {name}")

    def scan():
        df = scan_code_corpus(spark, root)
        return df.inputFiles(), sorted((r.example, r.relative_path, r.text) for r in df.collect())

    files, rows = scan()
    assert [r[:2] for r in rows] == [("a", "main.cpp"), ("a", "src {1}/x*.H"), ("b", "deep/er/f.F90"), ("b", "inputs")]
    for name in ("a/.git/hook.cpp", "a/build/out.cpp", "a/build/x/y.h", "build/c/z.cpp", "b/CMakeFiles/t.cc"):
        _write(f"{root}/{name}", "never read")
    again, same = scan()
    assert sorted(again) == sorted(files) and same == rows


def test_nothing_kept(spark, tmp_dir):
    _write(f"{tmp_dir}/tree/a/readme.md", "x")
    assert scan_code_corpus(spark, f"{tmp_dir}/tree").collect() == []
