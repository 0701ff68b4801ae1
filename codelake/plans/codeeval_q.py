"""Registered queries for code evaluation and file versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelake.functions import declarations as DC
from codelake.functions import vectors as V
from codelake.functions.once import once
from codelake.functions.text import WS, pystrip
from codelake.operators import codeeval as CE
from codelake.operators import diffs as DF
from codelake.operators import embed as E
from codelake.operators.lineindex import line_starts, position
from codelake.plans import fixtures as D
from codelake.plans import sqltext as S
from codelake.plans.registry import query
from codelake.session import scratch_path
from codelake.sources.tables import read_table

DIM = E.DEFAULT_DIM


def _sql_normalize(x: str) -> str:
    e = f"regexp_replace({x}, '\\bamrex::', '', 'g')"
    e = f"regexp_replace({e}, '\\bAMREX_GPU_DEVICE\\b', '', 'g')"
    e = f"regexp_replace({e}, '\\bAMREX_FORCE_INLINE\\b', '', 'g')"
    e = f"regexp_replace({e}, '([{{}}();,+\\-*/=])', ' \\1 ', 'g')"
    e = f"regexp_replace({e}, '{WS}+', ' ', 'g')"
    return S.strip(e)


def _rstrip(x: str) -> str:
    return S.rstrip(x)


def _sql_clean(x: str) -> str:
    """F17 as DuckDB text: signature, brace depth over the braces only, cut, collapse."""
    c = f"regexp_replace(regexp_replace({x}, '\\bamrex::', '', 'g'), '#include\\s*<[^>]+>', '', 'g')"
    sig = "'\\b\\w+::\\w+\\s*\\([^)]*\\)\\s*\\{'"
    return f"""(select case when st = 0 or k = 0 then {S.strip('c')} else
      {S.strip("regexp_replace(regexp_replace(substr(c, st, cast(br - st + coalesce(list_sum(list_transform(pieces[1:k], lambda p: len(p))), 0) + k as bigint)), '[ \\t]+', ' ', 'g'), ' *\\n', chr(10), 'g')")} end
  from (select c, st, br, pieces, coalesce(list_position(list_transform(range(1, len(braces) + 1),
          lambda i: len(list_filter(braces[1:i], lambda b: b = '{{'))
                  - len(list_filter(braces[1:i], lambda b: b = '}}'))), 0), 0) k
        from (select c, st, br, regexp_extract_all(substr(c, br), '[{{}}]') braces,
                     string_split_regex(substr(c, br), '[{{}}]') pieces
              from (select c, st, case when st > 0 then st + len(regexp_extract(c, {sig}, 0)) - 1 else 0 end br
                    from (select c, case when regexp_matches(c, {sig}) then instr(c, regexp_extract(c, {sig}, 0)) else 0 end st
                          from (select {c} c))))))"""


_W = r"[\p{L}_][\p{L}\p{N}_]*"
_sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _sql_canon(x: str) -> str:
    """F19 as DuckDB text for D4 (plain words, signs and strings in one function): strings out, statements by
    ``;``, ``{``, ``}``; one that begins with type and name declares all its words but the type."""
    kind = rf"^\s*(?:(?:else|do|try)\s+)*({_W})"
    head = rf"{kind}[*&\s]*[*&\s]({_W})\s*[=,\[;]"
    no_default = S.strip("regexp_replace(p, '=.*$', '')")
    return rf"""(select array_to_string(list_transform(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
    lambda t: case when list_contains(names, t) then 'VAR' || cast(list_position(names, t) as varchar) else t end), '')
  from (select x, list_sort(list_filter(list_distinct(flatten(list_transform(statements, lambda s:
          list_filter(regexp_extract_all(substr(s, len(regexp_extract(s, '{kind}', 0)) + 1),
            '[\p{{L}}\p{{N}}_]+'), lambda n: regexp_matches(n, '^[\p{{L}}_]') and not list_contains({_sql_list(DC.KEYWORD)}, n)))) ),
        lambda n: not list_contains(params, n))) names
    from (select x, list_filter(regexp_extract_all(regexp_replace(x, '"(?:\\.|[^"\\\n])*"?', '"', 'g'), '[^;{{}}]*[;{{}}]'), lambda s:
              regexp_matches(s, '{head}')
              and not list_contains({_sql_list(DC.KEYWORD - DC.BUILTIN)}, regexp_extract(s, '{head}', 1))
              and not list_contains({_sql_list(DC.KEYWORD)}, regexp_extract(s, '{head}', 2))) statements,
            list_transform(string_split(regexp_extract(x, '\b\w+::\w+\s*\(([^)]*)\)', 1), ','),
              lambda p: string_split_regex({no_default}, '[\s*&]+')[-1]) params
          from (select {x} x))))"""


def _pair_cosine(df, a: str, b: str):
    """``df`` with ``cos``, the cosine of the native embeddings of two text columns, in the row: no text but
    these goes through Python, and none is shuffled."""
    df = once(df, E.hash_embed_arrow(a, DIM).alias("_va"), E.hash_embed_arrow(b, DIM).alias("_vb"))
    return df.withColumn("cos", V.cosine("_va", "_vb")).drop("_va", "_vb")


def _sql_merge_core(f_sql: str) -> str:
    """F22 as DuckDB text over ``f(doc_id, old, new)`` line lists: a recursive
    CTE matches each old line at the first later equal new line (the greedy
    two-pointer walk), then blocks are assembled from the match positions."""
    return f"""f as {f_sql},
m(doc_id, k, j) as (
  select doc_id, 0, 0 from f
  union all
  select m.doc_id, m.k + 1, m.j + coalesce(list_position(f.new[m.j + 1:], f.old[m.k + 1]), 0)
  from m join f using (doc_id)
  where m.k < len(f.old) and coalesce(list_position(f.new[m.j + 1:], f.old[m.k + 1]), 0) > 0),
steps as (select doc_id, k, j, lag(j) over (partition by doc_id order by k) pj from m),
body as (select s.doc_id, s.k,
  list_concat(case when s.j - s.pj > 1 then list_concat(['{DF.MERGE_OPEN}'], f.new[s.pj + 1:s.j - 1], ['{DF.MERGE_MID}', '{DF.MERGE_CLOSE}'])
                   else []::VARCHAR[] end, [f.old[s.k]]) part
  from steps s join f using (doc_id) where s.k > 0),
last as (select doc_id, max(k) kk, arg_max(j, k) jj from m group by doc_id),
tail as (select f.doc_id, case
    when l.kk < len(f.old) then list_concat(['{DF.MERGE_OPEN}'], f.new[l.jj + 1:], ['{DF.MERGE_MID}'], f.old[l.kk + 1:], ['{DF.MERGE_CLOSE}'])
    when l.jj < len(f.new) then list_concat(['{DF.MERGE_OPEN}'], f.new[l.jj + 1:], ['{DF.MERGE_MID}', '{DF.MERGE_CLOSE}'])
    else []::VARCHAR[] end part
  from f join last l using (doc_id)),
merged as (select f.doc_id, f.old = f.new same,
  list_concat(coalesce(flatten(list(b.part order by b.k) filter (where b.part is not null)), []::VARCHAR[]), t.part) lines
  from f join tail t using (doc_id) left join body b using (doc_id) group by f.doc_id, f.old, f.new, t.part)
select doc_id, case when same then null else array_to_string(lines, chr(10)) end merged from merged"""


def _sql_merge() -> str:
    rs = lambda e: S.rstrip(e)
    src = f"""(select o.doc_id, o.old, coalesce(n.new, []::VARCHAR[]) new from
  (select doc_id, list({rs('old_line')} order by line_no) old from {D.SQL_D5} group by doc_id) o left join
  (select doc_id, list({rs('new_line')} order by line_no) filter (where not dropped) new from {D.SQL_D5} group by doc_id) n
  using (doc_id))"""
    return "with recursive " + _sql_merge_core(src)


@query("normalize_code", f"""with t as (select 'doc' src, doc_id id, text x from documents
  union all select 'page', page_id, html from pages)
select src, id, {_sql_normalize('x')} normalized from t""")
def normalize_code(spark, sf_dir):
    """F18 on every document and every page."""
    d = read_table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                                      F.col("text").alias("x"))
    p = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                                  F.col("html").alias("x"))
    return d.unionByName(p).select("src", "id", CE.normalize_code("x").alias("normalized"))


@query("clean_function", f"""select item_id, {_sql_clean('bench')} bench_clean, {_sql_clean('gen')} gen_clean
from {D.SQL_D4}""")
def clean_function(spark, sf_dir):
    """F17 on both sides of D4 (brace matching)."""
    d4 = D.d4_eval_pairs(spark, sf_dir)
    return d4.select("item_id", CE.clean_function("bench").alias("bench_clean"),
                     CE.clean_function("gen").alias("gen_clean"))


def _canonical(df, **cols: str):
    """Per new column: the code of an old one cut out (F17, as ``<new>_fn``), normalised (F18), locals renamed (F19); each step once."""
    df = once(df, *[CE.clean_function(c).alias(f"{n}_fn") for n, c in cols.items()])
    df = once(df, *[CE.normalize_code(f"{n}_fn").alias(f"{n}_norm") for n in cols])
    return once(df, *[CE.canonicalize_locals(f"{n}_norm").alias(n) for n in cols])


_SQL_CANON_D4 = f"""c1 as (select item_id, {_sql_clean('bench')} b1, {_sql_clean('gen')} g1 from {D.SQL_D4}),
c2 as (select item_id, {_sql_normalize('b1')} b2, {_sql_normalize('g1')} g2 from c1),
c3 as (select item_id, {_sql_canon('b2')} bench_canon, {_sql_canon('g2')} gen_canon from c2)"""


@query("canonicalize_locals", f"""with {_SQL_CANON_D4}
select item_id, bench_canon, gen_canon from c3""")
def canonicalize_locals(spark, sf_dir):
    """F19 on both sides of D4, cut out (F17) and normalised."""
    d4 = D.d4_eval_pairs(spark, sf_dir)
    t = _canonical(d4, bench_canon="bench", gen_canon="gen")
    return t.select("item_id", "bench_canon", "gen_canon")


_SQL_START = "coalesce(nullif(instr(text, chr(10)), 0), len(text))"
_SQL_END = (f"case when instr(substr(text, {_SQL_START} + 1), chr(10)) > 0 "
            f"then {_SQL_START} + instr(substr(text, {_SQL_START} + 1), chr(10)) else len(text) end")


@query("conflict_patch", f"""with o as (select doc_id, text, {_SQL_START} s, {_SQL_END} e from documents),
f as (select *, substr(text, s + 1, greatest(e - s, 0)) orig from o)
select doc_id, concat(left(text, s), '{CE.CONFLICT_OPEN.strip()}', chr(10), {_rstrip('orig')}, chr(10),
  '=======', chr(10), '<<<<<<< GENERATED CODE', chr(10), {_rstrip("replace(orig, ' ', '_')")}, chr(10),
  '{CE.CONFLICT_CLOSE.strip()}', chr(10), substr(text, e + 1)) patched from f""")
def conflict_patch(spark, sf_dir):
    """each document's second line replaced by a conflict block against
    a generated version (spaces turned into underscores)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("text")
    s = F.coalesce(F.nullif(F.instr(t, "\n"), F.lit(0)), F.length(t))
    rest_nl = F.instr(F.substring(t, s + 1, 1 << 30), "\n")
    e = F.when(rest_nl > 0, s + rest_nl).otherwise(F.length(t))
    orig = F.substring(t, s + 1, F.greatest(e - s, F.lit(0)))
    return d.select("doc_id", CE.conflict_patch(t, s, e, F.replace(orig, F.lit(" "), F.lit("_"))).alias("patched"))


def _versions(spark, sf_dir):
    """The D5 versions as files: ``(doc_id, lines)`` before and after."""
    v = D.d5_files(spark, sf_dir)
    return v.select("doc_id", F.col("old_lines").alias("lines")), v.select("doc_id", F.col("new_lines").alias("lines"))


_SQL_VERSIONS = f"""v as {D.SQL_D5},
o as (select doc_id, line_no, old_line line from v),
n as (select doc_id, row_number() over (partition by doc_id order by line_no) - 1 line_no, new_line line from v where not dropped),
j as (select coalesce(o.doc_id, n.doc_id) doc_id, o.line is not distinct from n.line same
  from o full outer join n on o.doc_id = n.doc_id and o.line_no = n.line_no),
cnt as (select doc_id, cast(sum(case when same then 0 else 1 end) as bigint) lines_changed from j group by doc_id
  having sum(case when same then 0 else 1 end) > 0)"""


@query("line_diff", f"""with {_SQL_VERSIONS}
select doc_id, lines_changed from cnt""")
def line_diff(spark, sf_dir):
    """J3 + A4 on D5: changed lines per file (positional), files without change dropped."""
    old, new = _versions(spark, sf_dir)
    return DF.changed_line_count(DF.join_before_after(old, new, ["doc_id"]), ["doc_id"])


@query("change_status", f"""with {_SQL_VERSIONS},
f as (select doc_id, concat(lang, '/doc', cast(doc_id as varchar), '.cpp') name,
  doc_id in (select doc_id from labels) existed from documents),
r as (select f.doc_id, f.name, case when not f.existed then 'added' when coalesce(c.lines_changed, 0) > 0 then 'modified'
  else 'none' end status, c.lines_changed from f left join cnt c using (doc_id))
select doc_id, name, status, cast(case when status = 'modified' then lines_changed else 0 end as bigint) lines_changed,
  case when status = 'added' then concat('- ', name)
       when status = 'modified' then concat('- ', name, ': ', cast(lines_changed as varchar), ' lines changed') end message
from r""")
def change_status(spark, sf_dir):
    """A5: added / modified / none per file; a file existed before when it has a labels row."""
    old, new = _versions(spark, sf_dir)
    counts = DF.changed_line_count(DF.join_before_after(old, new, ["doc_id"]), ["doc_id"])
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("existed", F.lit(True))
    files = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".cpp")).alias("name"),
        F.coalesce("existed", F.lit(False)).alias("existed"))
    return DF.change_report(files, counts, ["doc_id"], "name", "existed")


@query("conflict_merge", _sql_merge())
def conflict_merge(spark, sf_dir):
    """F22 on D5: old lines against the kept, edited new lines, per file."""
    old, new = _versions(spark, sf_dir)
    j = DF.join_before_after(old, new, ["doc_id"])
    return DF.conflict_merge(j, "old_lines", "new_lines").select("doc_id", F.array_join("merged", "\n").alias("merged"))


@query("copy_if_absent", """with src as (select concat(lang, '/doc', cast(doc_id as varchar), '.cpp') relative_path, doc_id from documents),
dst as (select concat(d.lang, '/doc', cast(d.doc_id as varchar), '.cpp') relative_path from documents d
  where d.doc_id in (select doc_id from labels))
select relative_path from src where relative_path not in (select relative_path from dst)""")
def copy_if_absent(spark, sf_dir):
    """Example files that a scaffold copy would add (target = labelled documents)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".cpp")).alias("relative_path")
    src = docs.select("doc_id", path)
    dst = docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(path)
    return DF.copy_if_absent(src, dst).select("relative_path")


def _eval_inputs(spark, sf_dir):
    d4 = D.d4_eval_pairs(spark, sf_dir)
    prompts = d4.select(F.format_string("prompt_%06d.txt", F.col("item_id")).alias("prompt_name"),
                        pystrip("gen").alias("prompt"))
    benches = d4.select("item_id", pystrip("bench").alias("bench"))
    return prompts, benches


@query("eval_pairing", f"""with p as (select printf('prompt_%06d.txt', item_id) prompt_name, {S.strip('gen')} prompt from {D.SQL_D4}),
i as (select *, row_number() over (order by prompt_name) - 1 idx from p)
select cast(idx as bigint) idx, prompt_name, printf('benchmark_%02d.txt', idx) bench_name from i where prompt <> ''""")
def eval_pairing(spark, sf_dir):
    """J2 + W6: prompt files in name order, each paired with the benchmark at
    its index; a missing benchmark aborts the run."""
    prompts, benches = _eval_inputs(spark, sf_dir)
    j = CE.pair_eval(prompts, benches, order=["prompt_name"])
    # the filter evaluates the missing-benchmark check on every row (it never drops one)
    return j.filter(F.col("bench").isNotNull()).select(
        "idx", "prompt_name", F.format_string("benchmark_%02d.txt", F.col("idx")).alias("bench_name"))


def _q(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


@query("compile_flags", f"""with e as (select regexp_extract(command, '-c (\\S+)$', 1) file, command, p_partkey pos from {D.SQL_D6}),
f as (select file, arg_min(command, pos) command from e group by file)
select file, array_to_string(list_filter(list_transform(regexp_extract_all(command, {_q(CE.SHELL_WORD)}),
    lambda w: array_to_string(list_transform(regexp_extract_all(w, {_q(CE.SHELL_PIECE)}), lambda p:
      case when p[1] = '''' then p[2:-2] when p[1] = '"' then regexp_replace(p[2:-2], '\\\\(["\\\\])', '\\1', 'g')
      else regexp_replace(p, '\\\\(.)', '\\1', 'g') end), '')), lambda t: starts_with(t, '-I')
  or starts_with(t, '-D') or starts_with(t, '-std=') or t = '-fopenmp'), ' ') flags from f""")
def compile_flags(spark, sf_dir):
    """P9 + J5: per source file, the flags of its first compile entry."""
    d6 = D.d6_ast_dumps(spark, sf_dir)
    entries = d6.select(F.regexp_extract("command", r"-c (\S+)$", 1).alias("file"), "command",
                        F.col("p_partkey").alias("pos"))
    files = entries.select("file").distinct()
    return CE.flags_for_file(files, entries).select("file", F.array_join("flags", " ").alias("flags"))


@query("ast_fields", f"""select p_partkey, array_to_string(list_transform(
  regexp_extract_all(dump, 'Binding for "f":\\s*\\n([^\\n]+)', 1),
  lambda f: concat(regexp_replace(regexp_replace({S.strip("regexp_replace(f, '^<FieldDecl[^>]*>\\s*', '')")}, ';+$', ''),
                                  '{WS}+', ' ', 'g'), ';')), chr(10)) fields from {D.SQL_D6}""")
def ast_fields(spark, sf_dir):
    """F25 on the D6 dumps."""
    d6 = D.d6_ast_dumps(spark, sf_dir)
    return d6.select("p_partkey", F.array_join(CE.ast_fields("dump"), "\n").alias("fields"))


def _sql_line_offset(text: str, line: str) -> str:
    lines, breaks, before = S.splitlines(text), f"regexp_extract_all({text}, '{S.LINE_BREAK}')", f"({line} - 1)"
    return (f"(case when {before} between 0 and len({lines}) then coalesce(list_sum(list_transform(range(1, {before} + 1), "
            f"lambda i: len({lines}[i]) + coalesce(len({breaks}[i]), 0))), 0) end)")


_SPAN = "<(.+?):(\\d+):(\\d+),\\s*line:(\\d+):(\\d+)>"


@query("ast_span", f"""with s as (select p_partkey, regexp_extract(dump, '{_SPAN}', 1) file,
  cast(regexp_extract(dump, '{_SPAN}', 2) as integer) start_line, cast(regexp_extract(dump, '{_SPAN}', 3) as integer) start_col,
  cast(regexp_extract(dump, '{_SPAN}', 4) as integer) end_line, cast(regexp_extract(dump, '{_SPAN}', 5) as integer) end_col
  from {D.SQL_D6} where regexp_matches(dump, '{_SPAN}')),
o as (select s.*, d.text, cast({_sql_line_offset('d.text', 's.start_line')} + start_col - 1 as bigint) start_offset,
  cast({_sql_line_offset('d.text', 's.end_line')} + end_col - 1 + 1 as bigint) end_offset
  from s left join (select doc_id, row_number() over (order by doc_id) - 1 num, count(*) over () n from (select distinct doc_id from documents where doc_id is not null)) k
  on k.num = s.p_partkey % k.n left join documents d on d.doc_id = k.doc_id)
select p_partkey, file, start_line, start_col, end_line, end_col,
  start_offset is not null and end_offset is not null in_range,
  coalesce(start_offset, -1) start_offset, coalesce(end_offset, -1) end_offset,
  substr(text, start_offset + 1, end_offset - start_offset) snippet from o""")
def ast_span(spark, sf_dir):
    """F26 + W5: the dumped span located in the document whose number, in the order of doc_id,
    is ``p_partkey`` modulo their count (end made inclusive), with the code it covers.  A line past the end of
    the document (where the reference raises) gives ``in_range = false``,
    offsets -1 and no snippet; the row is kept."""
    d6 = D.d6_ast_dumps(spark, sf_dir)
    sp = d6.select("p_partkey", CE.ast_span("dump").alias("s")).filter(F.col("s").isNotNull()).select("p_partkey", "s.*")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", line_starts("text").alias("starts"))
    number, n = D.numbered(docs.select("doc_id").where("doc_id is not null"), "doc_id")
    # requests find their document by number; they alone are shuffled up to there
    of = sp.withColumn("num", F.col("p_partkey") % n).join(number, "num", "left").drop("num")
    j = of.join(docs, "doc_id", "left")
    so, eo = position("starts", "start_line", "start_col"), position("starts", "end_line", "end_col") + 1
    j = j.withColumn("start_offset", so).withColumn("end_offset", eo)
    ok = F.col("start_offset").isNotNull() & F.col("end_offset").isNotNull()
    return j.select("p_partkey", "file", "start_line", "start_col", "end_line", "end_col", ok.alias("in_range"),
                    F.coalesce("start_offset", F.lit(-1)).cast("bigint").alias("start_offset"),
                    F.coalesce("end_offset", F.lit(-1)).cast("bigint").alias("end_offset"),
                    F.when(ok, F.substring("text", F.col("start_offset") + 1,
                                           F.col("end_offset") - F.col("start_offset"))).alias("snippet"))


_SQL_REPORT = f"""with {_SQL_CANON_D4},
t as (select item_id idx, d.gen, d.bench, c1.g1, c1.b1, c3.gen_canon gn, c3.bench_canon bn
  from c3 join c1 using (item_id) join {D.SQL_D4} d using (item_id)),
gv as {S.sparse_hash('t', 'idx', 'gn', DIM)},
bv as {S.sparse_hash('t', 'idx', 'bn', DIM)},
gnrm as (select idx, sqrt(sum(cnt * cnt)) n from gv group by idx),
bnrm as (select idx, sqrt(sum(cnt * cnt)) n from bv group by idx),
dt as (select g.idx, sum(g.cnt * b.cnt) dot from gv g join bv b using (idx, bucket) group by g.idx),
c as (select t.*, case when coalesce(gnrm.n, 0) * coalesce(bnrm.n, 0) = 0 then -1.0
  else coalesce(dt.dot, 0) / (gnrm.n * bnrm.n) end cos
  from t left join gnrm using (idx) left join bnrm using (idx) left join dt using (idx))
select cast(idx as bigint) idx, round(cos, 9) cos,
  {" || ".join(f"'{CE.section_head(h)}' || {c} || chr(10)" for h, c in zip(CE.REPORT_SECTIONS, ("gen", "g1", "gn", "bench", "b1", "bn")))}
  || printf('Cosine similarity: %.4f', cos) || chr(10) report from c"""


@query("eval_report", _SQL_REPORT)
def eval_report(spark, sf_dir):
    """S9 + X1 + F1: both sides raw, cut out (F17), and normalised with canonical locals (F18, F19), with their cosine."""
    d4 = D.d4_eval_pairs(spark, sf_dir)
    # one report an item: repeated ids are taken once, before any work on their texts
    t = _canonical(d4.withColumnRenamed("item_id", "idx").dropDuplicates(["idx"]), gn="gen", bn="bench")
    t = t.select("idx", "gen", "bench", F.col("gn_fn").alias("g1"), F.col("bn_fn").alias("b1"), "gn", "bn")
    t = _pair_cosine(t, "gn", "bn")
    rep = CE.report_text("gen", "g1", "gn", "bench", "b1", "bn", F.col("cos"))
    return t.select("idx", F.round("cos", 9).alias("cos"), rep.alias("report"))


@query("report_published", f"select idx, report from ({_SQL_REPORT})")
def report_published(spark, sf_dir):
    """S9 written and read back: all reports of a run appear at once, a run that comes second changes nothing."""
    path, rep = scratch_path(spark, "reports"), eval_report(spark, sf_dir)
    CE.publish_eval_reports(rep, path)
    CE.publish_eval_reports(rep.where("idx < 0"), path)
    return CE.read_eval_reports(spark, path)


@query("eval_score", f"""with {_SQL_CANON_D4},
p as (select printf('prompt_%06d.txt', item_id) prompt_name, item_id, {S.strip('gen')} prompt from {D.SQL_D4}),
i as (select *, row_number() over (order by prompt_name) - 1 idx from p),
pairs as (select i.idx, i.prompt_name, c3.gen_canon g, b.bench_canon bb from i join c3 using (item_id)
  join c3 b on b.item_id = i.idx where i.prompt <> ''),
gv as {S.sparse_hash('pairs', 'idx', 'g', DIM)},
bv as {S.sparse_hash('pairs', 'idx', 'bb', DIM)},
gn as (select idx, sqrt(sum(cnt * cnt)) n from gv group by idx),
bn as (select idx, sqrt(sum(cnt * cnt)) n from bv group by idx),
dt as (select g.idx, sum(g.cnt * b.cnt) dot from gv g join bv b using (idx, bucket) group by g.idx)
select cast(pairs.idx as bigint) idx, pairs.prompt_name, round(case when coalesce(gn.n, 0) * coalesce(bn.n, 0) = 0 then -1.0
  else coalesce(dt.dot, 0) / (gn.n * bn.n) end, 9) cos
from pairs left join gn using (idx) left join bn using (idx) left join dt using (idx)""")
def eval_score(spark, sf_dir):
    """X4 end to end: pairing (J2/W6) → clean (F17) → normalise (F18) →
    canonical locals (F19) on both sides → native embedding (X1) → cosine (F1)."""
    prompts, benches = _eval_inputs(spark, sf_dir)
    j = CE.pair_eval(prompts, benches, order=["prompt_name"])
    # a repeated benchmark is scored once
    t = _canonical(j.dropDuplicates(["idx", "prompt_name"]), g="prompt", b="bench").select("idx", "prompt_name", "g", "b")
    return _pair_cosine(t, "g", "b").select("idx", "prompt_name", F.round("cos", 9).alias("cos"))

