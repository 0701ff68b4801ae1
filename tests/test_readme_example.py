"""The README usage example runs as written (on a tiny code tree)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_readme_example(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/code/ex1")
    os.makedirs(f"{tmp_dir}/prompts")
    with open(f"{tmp_dir}/code/ex1/a.cpp", "w") as f:
        f.write("// AI_METADATA\n// user_intent:\n// add two numbers fast\nint add(int a,int b){return a+b;}\n")
    with open(f"{tmp_dir}/prompts/p1.txt", "w") as f:
        f.write("add two numbers")
    src = open(os.path.join(ROOT, "README.md")).read()
    start = src.index("```python") + len("```python")
    code = src[start:src.index("```", start)]
    code = (code.replace('"/code/examples"', f'"{tmp_dir}/code"').replace('"/shared/index"', f'"{tmp_dir}/index"')
                .replace('"/prompts"', f'"{tmp_dir}/prompts"'))
    ns = {"spark": spark}
    exec(code, ns)  # noqa: S102 - the documented example itself
    rows = ns["top"].collect()
    assert [(r.qid, r.relative_path, r.rank) for r in rows] == [("p1.txt", "a.cpp", 1)]
    assert abs(rows[0].sim - 2 ** -0.5) < 1e-12
