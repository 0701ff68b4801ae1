"""Registered queries for prompt triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions import templates as T
from codelake.functions.text import pystrip
from codelake.plans import fixtures as D
from codelake.plans import sqltext as S
from codelake.plans.registry import query
from codelake.session import scratch_path
from codelake.sources import prompts as SP
from codelake.sources.tables import read_table

D2 = D.SQL_D2


def _sql_any_contains(text: str, needles) -> str:
    return "(" + " or ".join(f"instr({text}, '{n}') > 0" for n in needles) + ")"


def _sql_rlike(text: str, pats) -> str:
    return f"regexp_matches({text}, '" + "|".join(f"(?:{p})" for p in pats) + "')"


def _sql_classify(text: str, ruleset: str) -> str:
    low = f"lower({text})"
    out = "case"
    for label, pats in P.RULESETS[ruleset]:
        cond = _sql_any_contains(low, P.COMPILER_MARKERS) if pats is None else _sql_rlike(low, pats)
        out += f" when {cond} then '{label}'"
    return out + " end"


def _sql_first_hit(text: str, pats) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in pats) + ")"


SQL_MENTION = S.strip(f"substr(body, instr(lower(body), '{P.DEFAULT_MENTION}') + {len(P.DEFAULT_MENTION)})")


def sql_mention(b: str) -> str:
    """F8 as DuckDB text."""
    return (f"case when instr(lower({b}), '{P.DEFAULT_MENTION}') > 0 then "
            + S.strip(f"substr({b}, instr(lower({b}), '{P.DEFAULT_MENTION}') + {len(P.DEFAULT_MENTION)})") + " end")


def sql_agent_instruction(b: str) -> str:
    """F9 as DuckDB text."""
    ls = S.splitlines(b)
    rest = S.strip(f"array_to_string(({ls})[2:], chr(10))")
    return (f"case when starts_with(lower({S.strip(f'({ls})[1]')}), '{P.CODER_COMMAND}') then "
            f"case when {rest} = '' then '{P.NO_INSTRUCTION}' else {rest} end end")


def sql_compiler_block(b: str) -> str:
    """F10 as DuckDB text."""
    ls = S.splitlines(b)
    f = f"coalesce(list_position(list_transform({ls}, lambda l: instr(lower(l), '{P.REVIEW_COMMAND}') > 0), true), 0)"
    blk = S.strip(f"array_to_string(list_filter({ls}, lambda l, i: {f} > 0 and i > {f} and not "
                  f"(instr(lower(l), '{P.REVIEW_COMMAND}') > 0)), chr(10))")
    return f"case when {blk} <> '' then {blk} end"


@query("compiler_triage", f"""select conv_id, turn, {_sql_any_contains('lower(body)', P.COMPILER_MARKERS)} has_marker
from {D2}""")
def compiler_triage(spark, sf_dir):
    """P4 on every D2 body."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.has_compiler_marker("body").alias("has_marker"))


@query("strip_slots", f"""with b as (select conv_id, turn, {S.splitlines('body')} ls from {D2})
select conv_id, turn, array_to_string(list_filter(ls, lambda l: not (starts_with({S.strip('l')}, 'class:')
  or starts_with({S.strip('l')}, 'file:') or starts_with({S.strip('l')}, 'function:'))), chr(10)) stripped from b""")
def strip_slots(spark, sf_dir):
    """P5: prompt without its slot lines."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.strip_slot_lines("body").alias("stripped"))


@query("call_error_class", f"""select conv_id, turn, case when instr(lower(body), 'model') > 0 and
  {_sql_any_contains('lower(body)', P.MODEL_ERROR_WORDS)} then 'model_unavailable' else 'other' end cls from {D2}""")
def call_error_class(spark, sf_dir):
    """P6 on every D2 body treated as an error message."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.classify_call_error("body").alias("cls"))


@query("mention_prompt", f"""select conv_id, turn, case when instr(lower(body), '{P.DEFAULT_MENTION}') > 0
  then {SQL_MENTION} end prompt from {D2}""")
def mention_prompt(spark, sf_dir):
    """F8."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.mention_prompt("body").alias("prompt"))


@query("agent_instruction", f"""with b as (select conv_id, turn, {S.splitlines('body')} ls from {D2}),
c as (select *, {S.strip("array_to_string(ls[2:], chr(10))")} rest from b)
select conv_id, turn, case when starts_with(lower({S.strip('ls[1]')}), '{P.CODER_COMMAND}')
  then case when rest = '' then '{P.NO_INSTRUCTION}' else rest end end instruction from c""")
def agent_instruction(spark, sf_dir):
    """F9."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.agent_instruction("body").alias("instruction"))


@query("compiler_block", f"""with b as (select conv_id, turn, {S.splitlines('body')} ls from {D2}),
c as (select *, coalesce(list_position(list_transform(ls, lambda l: instr(lower(l), '{P.REVIEW_COMMAND}') > 0), true), 0) f from b),
d as (select conv_id, turn, {S.strip(f"array_to_string(list_filter(ls, lambda l, i: f > 0 and i > f and not (instr(lower(l), '{P.REVIEW_COMMAND}') > 0)), chr(10))")} blk from c)
select conv_id, turn, case when blk <> '' then blk end block from d""")
def compiler_block(spark, sf_dir):
    """F10."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.compiler_block("body").alias("block"))


@query("extract_slots", f"""select conv_id, turn,
  {_sql_first_hit('body', P.CLASS_PATTERNS)} class_name,
  {_sql_first_hit('body', P.FILE_PATTERNS)} file_name,
  {_sql_first_hit('body', P.FUNCTION_PATTERNS)} function_name,
  nullif(regexp_extract(body, '{P.TARGET_FILE_PATTERN}', 1), '') target_file from {D2}""")
def extract_slots(spark, sf_dir):
    """F11 + F13: class, file and function slots and the target file."""
    return D.d2_bodies(spark, sf_dir).select(
        "conv_id", "turn", P.extract_class("body").alias("class_name"), P.extract_file("body").alias("file_name"),
        P.extract_function("body").alias("function_name"), P.target_file("body").alias("target_file"))


@query("classify_intent", f"""select conv_id, turn, {_sql_classify('body', 'fortran')} intent_fortran,
  {_sql_classify('body', 'cpp')} intent_cpp from {D2}""")
def classify_intent(spark, sf_dir):
    """F14 with both rule sets."""
    return D.d2_bodies(spark, sf_dir).select(
        "conv_id", "turn", P.classify_intent("body", "fortran").alias("intent_fortran"),
        P.classify_intent("body", "cpp").alias("intent_cpp"))


@query("clean_task_label", f"""select conv_id, turn, case when upper(string_split_regex({S.strip('body')}, '[:\\s]')[1])
  in ({", ".join(f"'{x}'" for x in P.TASK_LABELS)}) then upper(string_split_regex({S.strip('body')}, '[:\\s]')[1])
  else '{P.DEFAULT_TASK}' end task from {D2}""")
def clean_task_label(spark, sf_dir):
    """F15 on every D2 body as a raw model reply."""
    return D.d2_bodies(spark, sf_dir).select("conv_id", "turn", P.clean_task_label("body").alias("task"))


_LABELS7 = "['scaffolding', 'compilation', 'codeadvising', 'explaining', 'code_generation', 'refactor', 'bogus']"


@query("parse_reply", f"""with r as (
  select 'body' src, conv_id id, turn, body raw from {D2}
  union all select 'props', event_id, 0, props from events
  union all select 'reply', event_id, 0, concat('{{"intent": "', {_LABELS7}[event_id % 7 + 1], '"}}') from events
  union all select 'tail', event_id, 0, concat('{{"intent": "compilation"}}', case event_id % 4 when 0 then ' trailing' when 1 then ', {{}}'
    when 2 then '' else chr(10) end) from events
  union all select 'quote', event_id, 0, '{{''intent'': ''compilation''}}' from events where event_id % 4 = 0),
r2 as (select src, id, turn, case when json_valid(raw) then json_extract_string(raw, '$.intent') end v from r)
select src, id, cast(turn as bigint) turn, case when v in
  ({", ".join(f"'{x}'" for x in P.INTENT_LABELS)}) then v else '{P.DEFAULT_INTENT}' end intent
from r2""")
def parse_reply(spark, sf_dir):
    """F16 on D2 bodies (not JSON), event props (JSON without intent), JSON
    replies built from events (six labels and one unknown), replies with text
    after the JSON value, and single-quoted ones."""
    b = D.d2_bodies(spark, sf_dir).select(F.lit("body").alias("src"), F.col("conv_id").alias("id"), "turn",
                                          F.col("body").alias("raw"))
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    p = ev.select(F.lit("props").alias("src"), F.col("event_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
                  F.col("props").alias("raw"))
    labels = F.array(*[F.lit(x) for x in ("scaffolding", "compilation", "codeadvising", "explaining",
                                          "code_generation", "refactor", "bogus")])
    r = ev.select(F.lit("reply").alias("src"), F.col("event_id").alias("id"), F.lit(0).cast("bigint").alias("turn"),
                  F.concat(F.lit('{"intent": "'), F.element_at(labels, (F.col("event_id") % 7 + 1).cast("int")),
                           F.lit('"}')).alias("raw"))
    zero = F.lit(0).cast("bigint").alias("turn")
    tails = F.array(F.lit(" trailing"), F.lit(", {}"), F.lit(""), F.lit("\n"))
    tail = ev.select(F.lit("tail").alias("src"), F.col("event_id").alias("id"), zero, F.concat(
        F.lit('{"intent": "compilation"}'), F.get(tails, (F.col("event_id") % 4).cast("int"))).alias("raw"))
    quote = ev.where("event_id % 4 = 0").select(F.lit("quote").alias("src"), F.col("event_id").alias("id"), zero,
                                                F.lit("{'intent': 'compilation'}").alias("raw"))
    return b.unionByName(p).unionByName(r).unionByName(tail).unionByName(quote) \
        .select("src", "id", "turn", P.parse_intent_reply("raw").alias("intent"))


def _kind_sql() -> str:
    return (f"case {_sql_classify('body', 'fortran')} when 'compilation' then 'compilation_fortran' "
            f"when 'codeadvising' then 'codeadvising_fortran' when 'explaining' then 'explaining_fortran' "
            f"when 'code_generation' then 'agent_task' when 'scaffolding' then 'task_type' else 'intent' end")


def _kind_col():
    i = P.classify_intent("body", "fortran")
    return (F.when(i == "compilation", "compilation_fortran").when(i == "codeadvising", "codeadvising_fortran")
            .when(i == "explaining", "explaining_fortran").when(i == "code_generation", "agent_task")
            .when(i == "scaffolding", "task_type").otherwise("intent"))


@query("render_prompt", "with k as (select conv_id, turn, body, " + _kind_sql() + " kind from " + D2 + """)
select conv_id, turn, kind, case kind """ + " ".join(
    f"when '{k}' then {T.sql_render(k, body='body')}" for k in
    ("compilation_fortran", "codeadvising_fortran", "explaining_fortran", "agent_task", "task_type", "intent"))
    + " end prompt from k")
def render_prompt(spark, sf_dir):
    """F14 → F20: each D2 body routed by intent and rendered into its template."""
    k = D.d2_bodies(spark, sf_dir).withColumn("kind", _kind_col())
    return k.select("conv_id", "turn", "kind", T.render_by_kind(F.col("kind"), body=F.col("body")).alias("prompt"))


@query("prompt_scan", f"""with p as (select conv_id, turn, {S.strip('text')} prompt from conversations),
i as (select *, row_number() over (order by conv_id, turn) - 1 idx from p)
select cast(idx as bigint) idx, conv_id, turn, prompt from i where prompt <> ''""")
def prompt_scan(spark, sf_dir):
    """S7 + W6: turns as prompt files in name order; stripped; empty ones
    skipped but still holding their index."""
    c = read_table(spark, sf_dir, "conversations") \
        .select("conv_id", "turn", pystrip("text").alias("prompt"))
    return SP.index_prompts(c, ["conv_id", "turn"]).select("idx", "conv_id", "turn", "prompt")


@query("prompt_hash", f"""select conv_id, turn, sha256(body) prompt_hash,
  {_sql_classify('body', 'fortran')} intent from {D2} where {_sql_classify('body', 'fortran')} = 'scaffolding'""")
def prompt_hash(spark, sf_dir):
    """S10's state record key: the SHA-256 of each scaffolding prompt."""
    d = D.d2_bodies(spark, sf_dir).withColumn("intent", P.classify_intent("body", "fortran"))
    return SP.state_records(d.filter(F.col("intent") == "scaffolding"), "body").select(
        "conv_id", "turn", "prompt_hash", "intent")


@query("state_once", f"""select conv_id, turn, sha256(body) prompt_hash, 'example' scaffold_type, true scaffolded
  from {D2} where {_sql_classify('body', 'fortran')} = 'scaffolding'""")
def state_once(spark, sf_dir):
    """S10 written and read back: the first writer's records are published, a second writer's are not."""
    d = D.d2_bodies(spark, sf_dir)
    kind = P.classify_intent("body", "fortran")
    path = scratch_path(spark, "state")
    SP.write_state_once(SP.state_records(d.where(kind == "scaffolding"), "body"), path)
    SP.write_state_once(SP.state_records(d, "body", scaffold_type="second"), path)
    return SP.read_state(spark, path, "conv_id bigint, turn bigint, prompt_hash string, scaffold_type string, scaffolded boolean")


def _sql_fields(dump: str) -> str:
    """F25 as DuckDB text: the member declarations of a dump, one per line."""
    from codelake.functions.text import WS

    decl = S.strip("regexp_replace(f, '^<FieldDecl[^>]*>\\s*', '')")
    one = f"concat(regexp_replace(regexp_replace({decl}, ';+$', ''), '{WS}+', ' ', 'g'), ';')"
    return (f"array_to_string(list_transform(regexp_extract_all({dump}, "
            f"'Binding for \"f\":\\s*\\n([^\\n]+)', 1), lambda f: {one}), chr(10))")


@query("add_method_prompt", f"""with b as (select conv_id, turn, body from {D2}
  where {_sql_classify('body', 'cpp')} = 'codemodification'),
s as (select b.*, {_sql_first_hit('body', P.CLASS_PATTERNS)} class_name, {_sql_first_hit('body', P.FILE_PATTERNS)} file_name,
  array_to_string(list_filter({S.splitlines('body')}, lambda l: not (starts_with({S.strip('l')}, 'class:')
    or starts_with({S.strip('l')}, 'file:') or starts_with({S.strip('l')}, 'function:'))), chr(10)) request from b),
m as (select p_partkey, {_sql_fields('dump')} members from {D.SQL_D6})
select s.conv_id, s.turn, s.class_name, s.file_name,
  {T.sql_render('add_method', class_name='s.class_name', file_name='s.file_name', members='m.members', body='s.request')} prompt
from s left join m on m.p_partkey = s.conv_id""")
def add_method_prompt(spark, sf_dir):
    """F14 (C++ rules) → F11 slots → P5 → F25 member list → F20 add-method
    prompt; retrieval and the function body are disabled here, so those
    parts render empty, as in the reference."""
    from codelake.operators import codeeval as CE

    d2 = D.d2_bodies(spark, sf_dir).filter(P.classify_intent(F.col("body"), "cpp") == "codemodification")
    s = d2.select("conv_id", "turn", P.extract_class("body").alias("class_name"),
                  P.extract_file("body").alias("file_name"), P.strip_slot_lines("body").alias("request"))
    m = D.d6_ast_dumps(spark, sf_dir).select(F.col("p_partkey").alias("conv_id"),
                                            F.array_join(CE.ast_fields("dump"), "\n").alias("members"))
    j = s.join(m, "conv_id", "left")
    return j.select("conv_id", "turn", "class_name", "file_name",
                    T.render_prompt("add_method", class_name=F.col("class_name"), file_name=F.col("file_name"),
                                    members=F.col("members"), body=F.col("request")).alias("prompt"))
