"""Registered queries for the corpus side: lines, chunks, embeddings, index, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions.text import clip_text
from codelake.operators import chunking as C
from codelake.operators import embed as E
from codelake.operators import retrieve as R
from codelake.plans import fixtures as D
from codelake.plans import sqltext as S
from codelake.plans.registry import query
from codelake.session import scratch_path
from codelake.sources import corpus as SC
from codelake.sources import index as IX
from codelake.sources.tables import read_table

DIM = E.DEFAULT_DIM
MENTION = P.DEFAULT_MENTION


# ------------------------------------------------------------------ Spark side
def cpp_fixed():
    """Fixed metadata of a D1 file: example, source_file, relative_path, language."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".cpp"))
    return {"example": F.col("source"), "source_file": name,
            "relative_path": F.concat(F.col("lang"), F.lit("/"), name), "language": F.lit(".cpp")}


def cpp_chunks(spark, sf_dir):
    ch = C.chunk_cpp_files(D.d1_cpp_files(spark, sf_dir), ["doc_id"], cpp_fixed())
    return ch.withColumn("example", F.col("metadata")["example"])


def fortran_chunks(spark, sf_dir):
    return C.chunk_fortran_files(D.d3_fortran_files(spark, sf_dir), ["doc_id"])


def chunk_index(spark, sf_dir):
    """The in-memory chunk index: C++ chunks of D1 with their native embedding."""
    ch = cpp_chunks(spark, sf_dir)
    keep = [c for c in ch.columns if c not in ("doc_id", "chunk_no")]
    return E.hash_embed_table(ch, ["doc_id", "chunk_no"], "embedding_text", DIM, keep=keep)


def mention_prompts(spark, sf_dir):
    d2 = D.d2_bodies(spark, sf_dir)
    p = P.mention_prompt(F.col("body"), MENTION)
    return d2.select("conv_id", "turn", p.alias("prompt")).filter(
        F.col("prompt").isNotNull() & (F.col("prompt") != ""))


# ------------------------------------------------------------------ SQL side
SQL_CPP = f"""cpp_a as (select doc_id, source, lang, line_no, line, {S.strip('line')} s from {D.SQL_D1}),
cpp_b as (select *, starts_with(s, '//') is_c, starts_with(s, '{C.CPP_MARKER}') is_m,
  sum(case when starts_with(s, '//') then 0 else 1 end) over (partition by doc_id order by line_no
      rows between unbounded preceding and current row) run from cpp_a),
cpp_c as (select *, is_m and is_c and line_no = min(case when is_m then line_no end) over (partition by doc_id, run) is_open from cpp_b),
cpp_d as (select *, sum(case when is_open then 1 else 0 end) over (partition by doc_id order by line_no
      rows between unbounded preceding and current row) chunk_no from cpp_c),
cpp_e as (select *, case when chunk_no = 0 then 'none' when is_open then 'marker'
      when run = min(case when is_open then run end) over (partition by doc_id, chunk_no) then 'meta' else 'code' end role from cpp_d),
cpp_m as (select doc_id, chunk_no, line_no, {S.strip("ltrim(s, '/')")} content from cpp_e where role = 'meta'),
cpp_m2 as (select *, instr(content, ':') > 0 has_colon,
  last_value(case when instr(content, ':') > 0 then content end ignore nulls) over (partition by doc_id, chunk_no
      order by line_no rows between unbounded preceding and 1 preceding) prev_colon from cpp_m),
cpp_m3 as (select *, (not has_colon) and coalesce(starts_with(prev_colon, 'user_intent:'), false) is_intent,
  has_colon and not starts_with(content, 'user_intent:') is_kv from cpp_m2),
cpp_kv as (select doc_id, chunk_no, line_no, {S.strip("substr(content, 1, instr(content, ':') - 1)")} key,
  {S.strip("substr(content, instr(content, ':') + 1)")} value from cpp_m3 where is_kv),
cpp_int as (select doc_id, chunk_no, string_agg(content, chr(10) order by line_no) intent from cpp_m3 where is_intent group by all),
cpp_code as (select doc_id, chunk_no, any_value(source) source, any_value(lang) lang,
  coalesce(list(line order by line_no) filter (where role = 'code'), []::VARCHAR[]) code_lines
  from cpp_e where role in ('marker', 'code') group by doc_id, chunk_no),
cpp_chunks as (select c.doc_id, c.source, c.lang, c.source example, cast(c.chunk_no as bigint) chunk_no,
  sha256(concat(cast(c.doc_id as varchar), ':', cast(c.chunk_no as varchar))) chunk_id,
  array_to_string({S.dedent_list('c.code_lines')}, chr(10)) code, c.code_lines,
  {S.strip("coalesce(i.intent, '')")} user_intent
  from cpp_code c left join cpp_int i using (doc_id, chunk_no)),
cpp_chunks2 as (select *, concat('USER INTENT:', chr(10), user_intent, chr(10), chr(10)) embedding_text from cpp_chunks)"""

SQL_FORTRAN = f"""f_a as (select doc_id, source, line_no, line, {S.strip('line')} s from {D.SQL_D3}),
f_b as (select *, starts_with(lower(s), '! purpose:') is_p, sum(case when starts_with(lower(s), '! purpose:') then 1 else 0 end)
  over (partition by doc_id order by line_no rows between unbounded preceding and current row) chunk_no from f_a),
f_c as (select *, min(case when not starts_with(s, '!') then line_no end) over (partition by doc_id, chunk_no) fc from f_b where chunk_no > 0),
f_d as (select *, min(case when lower(s) = '! end code chunk' and fc is not null and line_no >= fc then line_no end)
  over (partition by doc_id, chunk_no) fend, (fc is null or line_no < fc) hdr from f_c),
f_e as (select *, (not hdr) and (fend is null or line_no < fend) code,
  hdr and not is_p and starts_with(lower(s), '! keywords:') kw,
  hdr and not is_p and not starts_with(lower(s), '! keywords:') and starts_with(lower(s), '! context:') ctx from f_d),
f_f as (select *, hdr and not is_p and not kw and not ctx oth,
  coalesce(max(ctx::int) over (partition by doc_id, chunk_no order by line_no rows between unbounded preceding and 1 preceding), 0) = 1 ctx_seen,
  substr(s, instr(s, ':') + 1) after from f_e),
f_g as (select *, case when is_p then {S.strip('after')} when oth and not ctx_seen then {S.strip('substr(s, 2)')} end pp,
  case when ctx then {S.strip('after')} when oth and ctx_seen then {S.strip('substr(s, 2)')} end cp,
  case when kw then list_filter(list_transform(string_split(after, ','), lambda k: {S.strip('k')}), lambda k: k <> '') end kws from f_f),
f_chunks as (select doc_id, cast(chunk_no as bigint) chunk_no,
  coalesce(string_agg(pp, ' ' order by line_no), '') purpose, coalesce(string_agg(cp, ' ' order by line_no), '') context,
  coalesce(flatten(list(kws order by line_no) filter (where kws is not null)), []::VARCHAR[]) keywords,
  coalesce(list(line order by line_no) filter (where code), []::VARCHAR[]) code_lines from f_g group by doc_id, chunk_no),
f_chunks2 as (select *, list_filter(code_lines, lambda l: instr(lower(l), 'module procedure') > 0)[1] proc_line from f_chunks),
f_chunks3 as (select doc_id, chunk_no, purpose, context, array_to_string(keywords, ', ') keywords,
  string_split_regex({S.strip("replace(proc_line, '&', '')")}, '{S.WS_SQL}+')[-1] procedure,
  array_to_string(code_lines, chr(10)) code, cast(len(code_lines) as bigint) n_code_lines,
  concat('PURPOSE:', chr(10), purpose, chr(10), chr(10), 'KEYWORDS:', chr(10), array_to_string(keywords, ', '),
         chr(10), chr(10), 'CONTEXT:', chr(10), context, chr(10), chr(10), 'CODE:', chr(10),
         array_to_string(code_lines, chr(10))) embedding_text from f_chunks2)"""

SQL_SPLITLINES = f"""sl as (select doc_id, {S.splitlines('text')} p from documents),
sl2 as (select doc_id, unnest(range(len(p))) line_no, unnest(p) line from sl)"""


# ------------------------------------------------------------------ queries
@query("explode_lines", f"""with {SQL_SPLITLINES}
select doc_id, cast(line_no as bigint) line_no, line from sl2""")
def explode_lines(spark, sf_dir):
    """Every document split into lines, ``str.splitlines()`` semantics."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.explode_lines(docs, "text", ["doc_id"])


_CRLF = "case when doc_id % 2 = 1 then replace(replace(text, chr(10), concat(chr(13), chr(10))), '. ', concat('.', chr(12))) else text end"


@query("line_offsets", f"""with t as (select doc_id, {_CRLF} x from documents),
l as (select doc_id, {S.splitlines('x')} p, regexp_extract_all(x, '{S.LINE_BREAK}') b from t),
n as (select doc_id, unnest(range(len(p))) line_no, unnest(list_transform(range(1, len(p) + 1),
  lambda i: len(p[i]) + coalesce(len(b[i]), 0))) w from l)
select doc_id, cast(line_no as bigint) line_no,
  cast(coalesce(sum(w) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) "offset"
from n""")
def line_offsets(spark, sf_dir):
    """Start offset of every line of every document; odd ones get ``\\r\\n`` and form-feed breaks."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_CRLF.replace("chr(", "char(")).alias("text"))
    return C.file_line_offsets(docs, "text", ["doc_id"])


@query("clip_text", f"""select doc_id, left({S.strip('text')}, 3000) clipped from documents""")
def clip_text_q(spark, sf_dir):
    """the embedder's input clip (strip, first 3000 characters)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", clip_text("text").alias("clipped"))


@query("chunk_cpp", f"""with {SQL_CPP}
select doc_id, chunk_no, chunk_id, code, user_intent, embedding_text from cpp_chunks2""")
def chunk_cpp(spark, sf_dir):
    """W1 + F2 + A2 + A8 + F5 on the annotated C++ lines of D1."""
    return cpp_chunks(spark, sf_dir).select("doc_id", "chunk_no", "chunk_id", "code", "user_intent",
                                            "embedding_text")


@query("metadata_kv", f"""with {SQL_CPP},
ent as (select doc_id, chunk_no, 'example' key, source value, 0 prio, 0 line_no from cpp_code
  union all select doc_id, chunk_no, 'source_file', concat('doc', cast(doc_id as varchar), '.cpp'), 0, 1 from cpp_code
  union all select doc_id, chunk_no, 'relative_path', concat(lang, '/doc', cast(doc_id as varchar), '.cpp'), 0, 2 from cpp_code
  union all select doc_id, chunk_no, 'language', '.cpp', 0, 3 from cpp_code
  union all select doc_id, chunk_no, key, value, 1, line_no from cpp_kv
  union all select doc_id, chunk_no, 'user_intent', user_intent, 2, 0 from cpp_chunks),
r as (select *, row_number() over (partition by doc_id, chunk_no, key order by prio desc, line_no desc) rk from ent)
select doc_id, cast(chunk_no as bigint) chunk_no, key, value from r where rk = 1""")
def metadata_kv(spark, sf_dir):
    """F2 + P7: the chunk metadata map (fixed keys, parsed keys override, user_intent)."""
    ch = cpp_chunks(spark, sf_dir)
    return ch.select("doc_id", "chunk_no", F.explode("metadata").alias("key", "value"))


@query("dedent_chunks", f"""with {SQL_CPP},
ind as (select doc_id, chunk_no, list_transform(code_lines, lambda l, i: concat(repeat(' ', (i - 1) % 3), l)) ls from cpp_chunks where len(code_lines) > 0)
select doc_id, chunk_no, array_to_string({S.dedent_list('ls')}, chr(10)) code from ind""")
def dedent_chunks(spark, sf_dir):
    """``textwrap.dedent`` of each D1 chunk's code lines, re-indented by position."""
    from codelake.functions.text import dedent_lines

    d1 = D.d1_cpp_lines(spark, sf_dir)
    marked = C.mark_cpp_lines(d1, ["doc_id"]).filter(F.col("role") == "code")
    lines = marked.groupBy("doc_id", "chunk_no").agg(
        C._sorted_list(F.lit(True), F.col("line")).alias("ls"))
    ls = F.transform("ls", lambda l, i: F.concat(F.repeat(F.lit(" "), i % 3), l))
    return lines.select("doc_id", "chunk_no", F.array_join(dedent_lines(ls), "\n").alias("code"))


@query("chunk_fortran", f"""with {SQL_FORTRAN}
select doc_id, chunk_no, procedure, purpose, keywords, context, code, n_code_lines from f_chunks3""")
def chunk_fortran(spark, sf_dir):
    """W2 + F3 + F4 on the annotated Fortran lines of D3."""
    ch = fortran_chunks(spark, sf_dir)
    return ch.select("doc_id", "chunk_no", "procedure", "purpose",
                     F.array_join("keywords", ", ").alias("keywords"), "context", "code", "n_code_lines")


@query("procedure_name", f"""with {SQL_FORTRAN}
select doc_id, chunk_no, procedure from f_chunks3""")
def procedure_name(spark, sf_dir):
    """the module procedure named in each Fortran chunk (or null)."""
    return fortran_chunks(spark, sf_dir).select("doc_id", "chunk_no", "procedure")


@query("embedding_text", f"""with {SQL_FORTRAN}, {SQL_CPP}
select doc_id, chunk_no, 'fortran' kind, embedding_text from f_chunks3
union all select doc_id, chunk_no, 'cpp' kind, embedding_text from cpp_chunks2""")
def embedding_text(spark, sf_dir):
    """the text each chunk is embedded from (Fortran D3 and C++ D1)."""
    f = fortran_chunks(spark, sf_dir).select("doc_id", "chunk_no", F.lit("fortran").alias("kind"),
                                             "embedding_text")
    c = cpp_chunks(spark, sf_dir).select("doc_id", "chunk_no", F.lit("cpp").alias("kind"), "embedding_text")
    return f.unionByName(c)


@query("scan_filter", f"""with seg as (select page_id, path, list_filter(string_split(path, '/'), lambda s: s <> '') segs from {D.SQL_D7}),
nm as (select *, segs[-1] name, regexp_extract(segs[-1], '^.+(\\.[^.]+)$', 1) suffix from seg)
select page_id, path, name, suffix from nm
where (suffix in ('.cpp', '.cc', '.H', '.h', '.f90', '.F90', '.html') or name in ('inputs'))
  and not list_has_any(segs, ['.git', 'build', 'CMakeFiles', 'fr'])""")
def scan_filter(spark, sf_dir):
    """S1's path rule on D7: kept suffixes or names, excluded segments."""
    paths = D.d7_paths(spark, sf_dir)
    rule = SC.PathRule(suffixes=SC.CODE_SUFFIXES + (".html",), names=SC.CODE_NAMES,
                       exclude_segments=SC.EXCLUDE_SEGMENTS + ("fr",))
    return SC.apply_path_rule(paths, "path", rule).select("page_id", "path", "name", "suffix")


@query("corpus_scan", """with f as (select source, lang, doc_id // 1000 part, string_agg(text, chr(10) order by doc_id) || chr(10) body
  from documents where lang <> 'fr' group by all)
select concat('example=', source) example, '.txt' "language", cast(len(body) as bigint) n_chars, sha256(body) text_sha256 from f""")
def corpus_scan(spark, sf_dir):
    """S1 on a real tree: documents of one source, language and thousand of ids are written as a
    text file in the source's folder, French ones under ``build/``; the scan finds the others."""
    docs = read_table(spark, sf_dir, "documents")
    root = scratch_path(spark, "code-tree")
    part = F.expr("doc_id div 1000").alias("part")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    files = docs.groupBy(F.col("source").alias("example"), "lang", part).agg(F.array_join(F.transform(parts, lambda d: d["text"]), "\n").alias("value"))
    write = lambda df, path: df.select("example", "value").write.option("maxRecordsPerFile", 1).partitionBy("example").text(path)
    write(files.where("lang <> 'fr'"), root)
    write(files.where("lang = 'fr'"), f"{root}/build")
    found = SC.scan_code_corpus(spark, root, rule=SC.PathRule(suffixes=(".txt",)))
    return found.select("example", "language", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("embed_hash", f"""select doc_id, cast(bucket as bigint) bucket, cnt
from {S.sparse_hash('documents', 'doc_id', 'text', DIM)}""")
def embed_hash(spark, sf_dir):
    """X1 native embedder on every whole document, as sparse ``(bucket, cnt)`` rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    v = E.hash_embed_table(docs, ["doc_id"], "text", DIM, out_col="v")
    return E.sparse("v", ["doc_id"], v)


@query("index_summary", f"""with {SQL_CPP}
select example, count(*) n_chunks, count(*) filter (where {S.strip('embedding_text')} <> '') num_chunks
from cpp_chunks2 group by example""")
def index_summary(spark, sf_dir):
    """A1: chunks per example and how many of them were embedded."""
    return IX.index_summary(chunk_index(spark, sf_dir))


@query("index_load", f"""with {SQL_CPP}
select example, chunk_id, cast({DIM} as bigint) dims from cpp_chunks2""")
def index_load(spark, sf_dir):
    """S4 then S3: write the chunk index in the interchange JSON layout to the
    shared folder, read it back in index order, drop unembedded chunks."""
    from codelake.session import scratch_path

    idx = chunk_index(spark, sf_dir)
    path = scratch_path(spark, "chunk-index")
    IX.write_chunk_index_json(idx, path, order_keys=["doc_id", "chunk_no"])
    back = IX.read_chunk_index(spark, path)
    return back.select(F.col("metadata")["example"].alias("example"), F.col("id").alias("chunk_id"),
                       F.size("embedding").cast("bigint").alias("dims"))


@query("rag_context", f"""with {SQL_CPP},
ch as (select doc_id, chunk_no, code, {S.strip('embedding_text')} et from cpp_chunks2),
chv as {S.sparse_hash('ch', 'doc_id, chunk_no', 'et', DIM)},
chn as (select doc_id, chunk_no, sqrt(sum(cnt * cnt)) n from chv group by all),
pr as (select conv_id, turn, {S.strip(f"substr(body, instr(lower(body), '{MENTION}') + {len(MENTION)})")} prompt
  from {D.SQL_D2} where instr(lower(body), '{MENTION}') > 0),
pr2 as (select * from pr where prompt <> ''),
prv as {S.sparse_hash('pr2', 'conv_id, turn', 'prompt', DIM)},
prn as (select conv_id, turn, sqrt(sum(cnt * cnt)) n from prv group by all),
dots as (select p.conv_id, p.turn, c.doc_id, c.chunk_no, sum(p.cnt * c.cnt) dot from prv p join chv c using (bucket) group by all),
sims as (select d.conv_id, d.turn, d.doc_id, d.chunk_no, d.dot / (pn.n * cn.n) sim
  from dots d join prn pn using (conv_id, turn) join chn cn using (doc_id, chunk_no)),
rk as (select *, row_number() over (partition by conv_id, turn order by sim desc, doc_id, chunk_no) r from sims where sim >= 0.3),
top as (select rk.conv_id, rk.turn, rk.r, concat(chr(10), repeat(' ', 12), ch.code, chr(10), repeat(' ', 12)) t
  from rk join ch using (doc_id, chunk_no) where r <= 5),
ctx as (select conv_id, turn, string_agg(t, chr(10) || chr(10) order by r) context, count(*) n_chunks from top group by all)
select pr2.conv_id, pr2.turn, coalesce(ctx.context, '') context, cast(coalesce(ctx.n_chunks, 0) as bigint) n_chunks
from pr2 left join ctx using (conv_id, turn)""")
def rag_context(spark, sf_dir):
    """Flagship, end to end: D1 files → chunks → native embeddings (the index)
    → every mention prompt of D2 embedded → top-5 chunks with cos >= 0.3 →
    rendered code context in rank order (empty when nothing qualifies)."""
    from codelake.session import scratch_path

    # the index is built once and written to the shared folder; scoring and
    # the payload join both read it (no second build, lineage cut here)
    path = scratch_path(spark, "chunk-index")
    chunk_index(spark, sf_dir).select("doc_id", "chunk_no", "code", "embedding").write.parquet(path)
    idx = spark.read.parquet(path)
    prompts = mention_prompts(spark, sf_dir)
    q = E.hash_embed_table(prompts, ["conv_id", "turn"], "prompt", DIM) \
        .select(F.struct("conv_id", "turn").alias("qid"), "embedding")
    top = R.retrieve_topk(q, idx, k=R.DEFAULT_K, min_sim=R.DEFAULT_MIN_SIM, query_key="qid",
                          chunk_keys=["doc_id", "chunk_no"])
    ranked = R.attach_payload(top, idx.select("doc_id", "chunk_no", "code"), ["doc_id", "chunk_no"])
    ranked = ranked.withColumn("ctx_text", P.render_context(F.col("code"), "code"))
    ctx = R.build_context(ranked, query_key="qid")
    return (prompts.select(F.struct("conv_id", "turn").alias("qid"), "conv_id", "turn")
            .join(ctx, "qid", "left")
            .select("conv_id", "turn", F.coalesce("context", F.lit("")).alias("context"),
                    F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks")))
