"""Registered queries from prompt to rendered model request.

Each D2 body is classified (F14), its slots are taken out (F11) and its slot
lines dropped (P5), the rest is embedded (X1), the best chunks of the index
are retrieved (J1, W4, T1), rendered in the style its kind asks for (F12, A6)
and filled into the kind's template (F20).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions import templates as T
from codelake.operators import chunking as C
from codelake.operators import codeeval as CE
from codelake.operators import embed as E
from codelake.operators import retrieve as R
from codelake.plans import corpus_q as CQ
from codelake.plans import fixtures as D
from codelake.plans import prompts_q as PQ
from codelake.plans import sqltext as S
from codelake.plans.registry import query
from codelake.session import scratch_path

DIM = E.DEFAULT_DIM

# Per rule set: intent -> (template, context style or none); no intent -> ask the model for one.
KINDS = {
    "cpp": {"compilation": ("compilation", None), "scaffolding": ("task_type", None), "codeadvising": ("codeadvising", "code"),
            "codemodification": ("add_method", "code"), "explaining": ("explaining", "features"), None: ("intent", None)},
    "fortran": {"compilation": ("compilation_fortran", None), "scaffolding": ("task_type", None),
                "codeadvising": ("codeadvising_fortran", "purpose"), "code_generation": ("agent_task", None),
                "explaining": ("explaining_fortran", "purpose"), None: ("intent", None)},
}


def _landed_index(idx, spark):
    """The index, built once and written to the shared folder; scoring and payload join read it."""
    path = scratch_path(spark, "chunk-index")
    idx.select("doc_id", "chunk_no", "code", "metadata", "embedding").write.parquet(path)
    return spark.read.parquet(path)


def _fortran_fixed() -> dict:
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".f90"))
    return {"example": F.col("source"), "source_file": name, "relative_path": F.concat(F.lit("src/"), name), "language": F.lit(".f90")}


def fortran_index(spark, sf_dir):
    """Fortran chunks of D3 with their metadata map (P7) and native embedding."""
    ch = C.chunk_fortran_files(D.d3_fortran_files(spark, sf_dir), ["doc_id"], _fortran_fixed())
    return E.hash_embed_table(ch, ["doc_id", "chunk_no"], "embedding_text", DIM, keep=["code", "metadata"])


def _requests(spark, sf_dir, rules: str):
    # exploding a one-element array keeps the body's expression from being copied into each of its many uses
    d2 = D.d2_bodies(spark, sf_dir).select("conv_id", "turn", F.explode(F.array("body")).alias("body"))
    d2 = d2.withColumn("intent", F.explode(F.array(P.classify_intent(F.col("body"), rules))))
    intent = F.col("intent")
    kind, style = F.lit(KINDS[rules][None][0]), F.lit(None).cast("string")
    for label, (k, s) in KINDS[rules].items():
        if label is not None:
            kind = F.when(intent == label, k).otherwise(kind)
            style = F.when(intent == label, F.lit(s)).otherwise(style)
    return d2.select("conv_id", "turn", "body", kind.alias("kind"), style.alias("style"), P.strip_slot_lines("body").alias("request"),
                     P.extract_class("body").alias("class_name"), P.extract_file("body").alias("file_name"))


def _landed_requests(spark, sf_dir, rules: str):
    """The requests, read from the texts once and written to the shared folder; embedding, styles and templates read them."""
    path = scratch_path(spark, "requests")
    _requests(spark, sf_dir, rules).write.parquet(path)
    return spark.read.parquet(path)


def _answers(spark, sf_dir, rules: str, idx):
    req = _landed_requests(spark, sf_dir, rules).withColumn("qid", F.struct("conv_id", "turn"))
    asks = req.where("style is not null")
    q = E.hash_embed_table(asks, ["conv_id", "turn"], "request", DIM).select(F.struct("conv_id", "turn").alias("qid"), "embedding")
    top = R.retrieve_topk(q, idx, query_key="qid", chunk_keys=["doc_id", "chunk_no"])
    ranked = R.attach_payload(top, idx.select("doc_id", "chunk_no", "code", "metadata"), ["doc_id", "chunk_no"]) \
        .join(asks.select("qid", "style"), "qid")
    text = F.lit(None).cast("string")
    for style in ("code", "features", "purpose"):
        text = F.when(F.col("style") == style, P.render_context(F.col("code"), style, F.col("metadata"))).otherwise(text)
    ctx = R.build_context(ranked.withColumn("ctx_text", text), query_key="qid")
    members = D.d6_ast_dumps(spark, sf_dir).select(F.col("p_partkey").alias("conv_id"),
                                                  F.array_join(CE.ast_fields("dump"), "\n").alias("members"))
    out = req.join(ctx, "qid", "left").join(members, "conv_id", "left")
    # the templates for retrieval and advice hold the request without its slot lines, the others the whole body
    body = F.when(F.col("style").isNotNull(), F.col("request")).otherwise(F.col("body"))
    return out.select("conv_id", "turn", "kind", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"),
                      T.render_by_kind(F.col("kind"), body=body, context=F.col("context"), class_name=F.col("class_name"),
                                       file_name=F.col("file_name"), members=F.col("members")).alias("prompt"))


def _sql_answers(rules: str, chunks: str) -> str:
    """DuckDB text; ``chunks`` ends the list of CTEs with ``ch(doc_id, chunk_no, et, t_code, t_features, t_purpose)``."""
    case = lambda part: "case intent " + " ".join(
        f"when '{label}' then {_lit(v[part])}" for label, v in KINDS[rules].items() if label is not None) + f" else {_lit(KINDS[rules][None][part])} end"
    strip = (f"array_to_string(list_filter({S.splitlines('body')}, lambda l: not (starts_with({S.strip('l')}, 'class:') "
             f"or starts_with({S.strip('l')}, 'file:') or starts_with({S.strip('l')}, 'function:'))), chr(10))")
    slots = dict(body="(case when style is not null then request else body end)", context="context", class_name="class_name",
                 file_name="file_name", members="members")
    prompt = "case kind " + " ".join(f"when '{k}' then {T.sql_render(k, **slots)}" for k in {v[0] for v in KINDS[rules].values()}) + " end"
    return f"""with {chunks},
chv as {S.sparse_hash('ch', 'doc_id, chunk_no', 'et', DIM)},
chn as (select doc_id, chunk_no, sqrt(sum(cnt * cnt)) n from chv group by all),
rq as (select conv_id, turn, body, {PQ._sql_classify('body', rules)} intent from {D.SQL_D2}),
req as (select *, {case(0)} kind, {case(1)} style, {strip} request,
  {PQ._sql_first_hit('body', P.CLASS_PATTERNS)} class_name, {PQ._sql_first_hit('body', P.FILE_PATTERNS)} file_name from rq),
asks as (select * from req where style is not null),
prv as {S.sparse_hash('asks', 'conv_id, turn', 'request', DIM)},
prn as (select conv_id, turn, sqrt(sum(cnt * cnt)) n from prv group by all),
dots as (select p.conv_id, p.turn, c.doc_id, c.chunk_no, sum(p.cnt * c.cnt) dot from prv p join chv c using (bucket) group by all),
sims as (select d.conv_id, d.turn, d.doc_id, d.chunk_no, d.dot / (pn.n * cn.n) sim
  from dots d join prn pn using (conv_id, turn) join chn cn using (doc_id, chunk_no)),
rk as (select *, row_number() over (partition by conv_id, turn order by sim desc, doc_id, chunk_no) r from sims where sim >= 0.3),
top as (select rk.conv_id, rk.turn, rk.r, case a.style when 'code' then t_code when 'features' then t_features else t_purpose end t
  from rk join ch using (doc_id, chunk_no) join asks a using (conv_id, turn) where r <= 5),
ctx as (select conv_id, turn, string_agg(t, chr(10) || chr(10) order by r) context, count(*) n_chunks from top group by all),
mem as (select p_partkey conv_id, {PQ._sql_fields('dump')} members from {D.SQL_D6})
select req.conv_id, req.turn, kind, cast(coalesce(n_chunks, 0) as bigint) n_chunks, {prompt} prompt
from req left join ctx using (conv_id, turn) left join mem using (conv_id)"""


def _lit(v) -> str:
    return "null" if v is None else f"'{v}'"


_CODE = "concat(chr(10), repeat(' ', 12), code, chr(10), repeat(' ', 12))"
_SQL_CPP_CHUNKS = f"""{CQ.SQL_CPP},
meta as (select doc_id, chunk_no, max(case when key = 'function' then value end) fn, max(case when key = 'features' then value end) ft,
  max(case when key = 'source_file' then value end) sf from (select *, row_number() over (partition by doc_id, chunk_no, key order by line_no desc) rk
  from cpp_kv) where rk = 1 group by all),
ch as (select c.doc_id, c.chunk_no, embedding_text et, {_CODE} t_code, '' t_purpose, concat(chr(10), 'FUNCTION: ', coalesce(fn, ''), chr(10),
  'FEATURES: ', coalesce(ft, ''), chr(10), 'FILE: ', coalesce(sf, concat('doc', cast(c.doc_id as varchar), '.cpp')), chr(10), chr(10), 'CODE:', chr(10),
  code, chr(10)) t_features from cpp_chunks2 c left join meta using (doc_id, chunk_no))"""
_SQL_FORTRAN_CHUNKS = f"""{CQ.SQL_FORTRAN},
ch as (select doc_id, chunk_no, embedding_text et, '' t_code, '' t_features, concat(chr(10), 'PURPOSE: ', purpose, chr(10), 'KEYWORDS: ', keywords, chr(10),
  'CONTEXT: ', context, chr(10), 'FILE: doc', cast(doc_id as varchar), '.f90', chr(10), chr(10), 'CODE:', chr(10), code, chr(10)) t_purpose
  from f_chunks3)"""


@query("answer_prompts", _sql_answers("cpp", _SQL_CPP_CHUNKS))
def answer_prompts(spark, sf_dir):
    """The whole chain with the C++ rules, index and templates."""
    return _answers(spark, sf_dir, "cpp", _landed_index(CQ.chunk_index(spark, sf_dir), spark))


@query("answer_prompts_fortran", _sql_answers("fortran", _SQL_FORTRAN_CHUNKS))
def answer_prompts_fortran(spark, sf_dir):
    """The whole chain with the Fortran rules, index and templates."""
    return _answers(spark, sf_dir, "fortran", _landed_index(fortran_index(spark, sf_dir), spark))


@query("fortran_metadata", f"""with {CQ.SQL_FORTRAN},
m as (select f.doc_id, f.chunk_no, unnest([('example', source), ('source_file', concat('doc', cast(f.doc_id as varchar), '.f90')),
  ('relative_path', concat('src/doc', cast(f.doc_id as varchar), '.f90')), ('language', '.f90'), ('procedure', coalesce(procedure, '')),
  ('purpose', purpose), ('keywords', keywords), ('context', context)]) e
  from f_chunks3 f join (select doc_id, source from documents) d using (doc_id))
select doc_id, chunk_no, e[1] "key", e[2] "value" from m""")
def fortran_metadata(spark, sf_dir):
    """P7 for Fortran chunks: the fixed entries and the chunk's own."""
    ch = C.chunk_fortran_files(D.d3_fortran_files(spark, sf_dir), ["doc_id"], _fortran_fixed())
    return ch.select("doc_id", "chunk_no", F.explode("metadata").alias("key", "value"))
