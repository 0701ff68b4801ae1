"""Registered queries for training-data preparation and batch inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions import templates as T
from codelake.operators import infer as I
from codelake.operators import traindata as TD
from codelake.plans import fixtures as D
from codelake.plans import sqltext as S
from codelake.plans.registry import query
from codelake.session import scratch_path
from codelake.sources import jsonl as JL
from codelake.sources.tables import read_table

SQL_PAIRS = f"""l as (select doc_id, line_no, {S.rstrip('line')} l from {D.SQL_D8}),
a as (select *, starts_with(l, 'instruction:') ins, starts_with(l, 'response:') res,
  greatest(sum(case when starts_with(l, 'instruction:') then 1 else 0 end) over (partition by doc_id order by line_no
    rows between unbounded preceding and current row), 1) pair_no from l),
b as (select *, max(case when res then line_no end) over (partition by doc_id, pair_no) last_res from a),
pairs as (select doc_id, cast(pair_no as bigint) pair_no,
  max(case when ins then {S.strip('substr(l, 13)')} end) instruction,
  {S.strip("coalesce(string_agg(l, chr(10) order by line_no) filter (where not ins and not res and (last_res is null or line_no > last_res)), '')")} response
  from b group by doc_id, pair_no having bool_or(ins))"""

SQL_TOKENS = f"""t as (select conv_id, turn, regexp_extract_all(text, '{TD.TOKEN_RE}', 0) toks from conversations),
x as (select conv_id, turn, unnest(range(len(toks))) pos, unnest(toks) token from t),
v as (select token, count(*) c from x group by token),
vi as (select token, cast(row_number() over (order by c desc, token) - 1 + {TD.FIRST_TOKEN_ID} as integer) id from v),
enc as (select conv_id, turn, list(vi.id order by pos) ids from x join vi using (token) group by conv_id, turn),
te as (select t.conv_id, t.turn, coalesce(enc.ids, []::INTEGER[]) ids from t left join enc using (conv_id, turn))"""


def _pairs(spark, sf_dir):
    return TD.parse_pairs_files(D.d8_pair_files(spark, sf_dir), ["doc_id"])


@query("parse_pairs", f"""with {SQL_PAIRS}
select doc_id, pair_no, instruction, response from pairs""")
def parse_pairs(spark, sf_dir):
    """W3 on the D8 pair-file lines."""
    return _pairs(spark, sf_dir).select("doc_id", "pair_no", "instruction", "response")


@query("sft_jsonl_roundtrip", f"""with {SQL_PAIRS}
select instruction, response from pairs""")
def sft_jsonl_roundtrip(spark, sf_dir):
    """W3 → S6 (JSON Lines in the shared folder) → S5 read back."""
    path = scratch_path(spark, "pairs-jsonl")
    JL.write_jsonl(_pairs(spark, sf_dir), path)
    return JL.read_jsonl(spark, path)


@query("sft_prompt", f"""with {SQL_PAIRS}
select doc_id, pair_no, concat('Instruction:', chr(10), instruction, chr(10), chr(10), 'Response:', chr(10), response) prompt
from pairs""")
def sft_prompt(spark, sf_dir):
    """F27 for every parsed pair."""
    return _pairs(spark, sf_dir).select("doc_id", "pair_no", TD.sft_prompt("instruction", "response").alias("prompt"))


def _encoded(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    coded = TD.code_texts(conv, ["conv_id", "turn"], "text")
    return TD.encode_coded(coded, ["conv_id", "turn"], TD.vocabulary(coded))


@query("sft_tokenize", f"""with {SQL_TOKENS}
select conv_id, turn, cast(len(ids) as bigint) n_tokens, array_to_string(ids, ' ') ids from te""")
def sft_tokenize(spark, sf_dir):
    """Corpus vocabulary over all conversation turns, each turn encoded."""
    enc = _encoded(spark, sf_dir)
    return enc.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join("ids", " ").alias("ids"))


@query("encode_fixed", f"""with {SQL_TOKENS},
f as (select conv_id, turn, list_resize(ids[1:{TD.MAX_LEN}], {TD.MAX_LEN}, {TD.PAD_ID}) input_ids,
  cast(least(len(ids), {TD.MAX_LEN}) as bigint) n_kept from te)
select conv_id, turn, n_kept, array_to_string(input_ids, ' ') input_ids,
  array_to_string(list_transform(input_ids, lambda x: case when x = {TD.PAD_ID} then {TD.IGNORE_INDEX} else x end), ' ') labels
from f""")
def encode_fixed(spark, sf_dir):
    """X3 → F28 → F29: fixed-length input ids and masked labels per turn."""
    enc = _encoded(spark, sf_dir)
    ids = TD.encode_fixed(F.col("ids"))
    return enc.select("conv_id", "turn",
                      F.least(F.size("ids"), F.lit(TD.MAX_LEN)).cast("bigint").alias("n_kept"),
                      F.array_join(ids, " ").alias("input_ids"),
                      F.array_join(TD.mask_labels(ids), " ").alias("labels"))


@query("sft_encode", f"""with {SQL_PAIRS},
pt as (select doc_id, pair_no, regexp_extract_all(concat('Instruction:', chr(10), instruction, chr(10), chr(10), 'Response:', chr(10), response),
  '{TD.TOKEN_RE}', 0) toks from pairs),
px as (select doc_id, pair_no, unnest(range(len(toks))) pos, unnest(toks) token from pt),
pv as (select token, cast(row_number() over (order by count(*) desc, token) - 1 + {TD.FIRST_TOKEN_ID} as integer) id from px group by token),
pe as (select doc_id, pair_no, list(pv.id order by pos) ids from px join pv using (token) group by doc_id, pair_no),
pw as (select doc_id, pair_no, ids, unnest(range((len(ids) - 1) // {TD.MAX_LEN} + 1)) w from pe),
pf as (select doc_id, pair_no, w, list_resize(ids[w * {TD.MAX_LEN} + 1:(w + 1) * {TD.MAX_LEN}], {TD.MAX_LEN}, {TD.PAD_ID}) input_ids from pw)
select doc_id, pair_no, cast(w as integer) "window", array_to_string(input_ids, ' ') input_ids,
  array_to_string(list_transform(input_ids, lambda x: case when x = {TD.PAD_ID} then {TD.IGNORE_INDEX} else x end), ' ') labels from pf""")
def sft_encode(spark, sf_dir):
    """Pairs (W3) → rendered prompts (F27) → ids (X3) → fixed windows over the whole text (F28) → masked labels."""
    keys = ["doc_id", "pair_no"]
    prompts = _pairs(spark, sf_dir).select(*keys, TD.sft_prompt("instruction", "response").alias("prompt"))
    coded = TD.code_texts(prompts, keys, "prompt")     # parsed and split once, counted and encoded from there
    enc = TD.encode_coded(coded, keys, TD.vocabulary(coded))
    win = enc.select(*keys, F.posexplode(TD.window_texts(F.col("ids"))).alias("window", "w"))
    return win.select(*keys, "window", "w.input_ids", "w.labels")


MODELS = ("small-model", "large-model", "missing-model")


@query("prompt_matrix", f"""with p as (select conv_id, turn, {T.sql_render("intent", body="body")} prompt from {D.SQL_D2})
select conv_id, turn, model, prompt from p, (values {", ".join(f"('{m}')" for m in MODELS)}) m(model)""")
def prompt_matrix(spark, sf_dir):
    """Every rendered D2 prompt with each model of a list."""
    prompts = D.d2_bodies(spark, sf_dir).select("conv_id", "turn", T.render_prompt("intent", body=F.col("body")).alias("prompt"))
    return I.prompts_by_models(prompts, list(MODELS)).select("conv_id", "turn", "model", "prompt")
