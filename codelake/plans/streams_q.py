"""Registered streaming queries (ST1-ST5): each runs a Structured Streaming
query over the landed ``events`` file until the available input is
consumed, writes Parquet in the shared checkpoint folder and returns that
table.  The oracle is the batch SQL: a stream must end where the batch is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions import templates as T
from codelake.operators import conversation as CV
from codelake.plans import fixtures as D
from codelake.plans.conversation_q import SQL_COMMENTS, SQL_LATEST, sql_ts, ts_text
from codelake.plans.prompts_q import _sql_classify, _sql_first_hit, sql_agent_instruction, sql_compiler_block, sql_mention
from codelake.plans.registry import query
from codelake.session import scratch_path
from codelake.sources.tables import SCHEMAS, read_table
from codelake.streaming import comments as ST
from codelake.streaming import upserts as U


def _stream_comments(spark, sf_dir, redeliver: bool = False):
    ev = ST.comment_stream(spark, sf_dir, SCHEMAS["events"], glob="events.parquet")
    pages = D.d9_from_events(ev)
    if redeliver:
        # the reference re-reads the whole conversation every poll: review
        # comments arrive twice here, and must be answered once
        pages = pages.withColumn("_copy", F.explode(F.sequence(
            F.lit(1), F.when(F.col("feed") == "review", F.lit(2)).otherwise(F.lit(1))))).drop("_copy")
    return CV.union_comments(pages)


def _run(spark, df, name, mode="append"):
    out = scratch_path(spark, f"stream-{name}")
    ST.run_to_parquet(df, out, scratch_path(spark, f"stream-{name}-ckpt"), mode=mode)
    return spark.read.parquet(out)


@query("stream_mentions", f"""with {SQL_COMMENTS}
select uid, pr, prompt from (select uid, pr, {sql_mention('body')} prompt from comments)
where prompt is not null and prompt <> ''""")
def stream_mentions(spark, sf_dir):
    """ST1 + F8: mention prompts from the comment stream."""
    s = ST.mentions(_stream_comments(spark, sf_dir)).select("uid", "pr", "prompt")
    return _run(spark, s, "mentions")


@query("stream_dedupe", f"""with {SQL_COMMENTS}
select distinct uid, pr, {sql_ts('created_at')} from comments""")
def stream_dedupe(spark, sf_dir):
    """ST2: re-delivered comments are processed once (checkpointed state)."""
    s = ST.dedupe_seen(_stream_comments(spark, sf_dir, redeliver=True)).select("uid", "pr", "created_at")
    return _run(spark, s, "dedupe").withColumn("created_at", ts_text("created_at"))


def _slices(spark, sf_dir, parts: int = 4):
    """``events`` landed in slices of event time, oldest first; yields the landing folder, the length of a slice
    in seconds, and a function that lands slice ``i`` (with ``again``, the slice before once more)."""
    ev = read_table(spark, sf_dir, "events")
    root = scratch_path(spark, "landed-events")
    r = ev.agg(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")).first()
    lo, hi = (x.timestamp() if x else 0.0 for x in (r["lo"], r["hi"]))
    step = (hi - lo) / parts + 1
    nth = F.least(F.lit(parts - 1), F.floor((F.col("ts").cast("timestamp").cast("double") - lo) / step)).cast("int")
    ev = ev.withColumn("_nth", F.coalesce(nth, F.lit(0)))

    def land(i: int, again: bool) -> None:
        first = max(0, i - 1) if again else i
        ev.where(F.col("_nth").between(first, i)).drop("_nth").write.mode("append").parquet(root)

    return root, step, land


@query("stream_latest", f"""with {SQL_COMMENTS}
{SQL_LATEST}""")
def stream_latest(spark, sf_dir):
    """ST3: newest comment per pull request, kept up to date in update mode over four landings; each run
    starts from the checkpoint of the one before and writes the requests that changed.  Folded once on the way."""
    ST.disk_state(spark)
    root, _, land = _slices(spark, sf_dir)
    out, check = scratch_path(spark, "stream-latest"), scratch_path(spark, "stream-latest-ckpt")
    for i in range(4):
        land(i, False)
        feed = CV.union_comments(D.d9_from_events(ST.comment_stream(spark, root, SCHEMAS["events"])))
        ST.finished(U.sink_upserts(ST.latest_per_pr(feed), out, check))
        if i == 1:
            U.compact(spark, out, ["pr"])
    return U.read_upserts(spark, out, ["pr"]).withColumn("created_at", ts_text("created_at"))


@query("stream_seen", f"""with {SQL_COMMENTS}
select distinct uid, pr, {sql_ts('created_at')} from comments""")
def stream_seen(spark, sf_dir):
    """ST2 with bounded state: four landings, each with the one before delivered again, and a watermark that
    passes, so that old uids are evicted.  Every run restarts from the checkpoint; a comment is processed once."""
    ST.disk_state(spark)
    root, step, land = _slices(spark, sf_dir)
    out, check = scratch_path(spark, "stream-seen"), scratch_path(spark, "stream-seen-ckpt")
    for i in range(4):
        land(i, True)
        feed = CV.union_comments(D.d9_from_events(ST.comment_stream(spark, root, SCHEMAS["events"])))
        seen = ST.dedupe_seen(feed, watermark=f"{max(1, int(step / 2))} seconds").select("uid", "pr", "created_at")
        ST.run_to_parquet(seen, out, check)
    return spark.read.parquet(out).withColumn("created_at", ts_text("created_at"))


def _sql_mention_kind(intent: str) -> str:
    return (f"case {intent} when 'compilation' then 'compilation_fortran' when 'codeadvising' then 'codeadvising_fortran' "
            f"when 'explaining' then 'explaining_fortran' when 'code_generation' then 'agent_task' "
            f"when 'scaffolding' then 'task_type' else 'intent' end")


_MENTION_KINDS = ("compilation_fortran", "codeadvising_fortran", "explaining_fortran", "agent_task", "task_type",
                  "intent")
SQL_TRIAGE = f"""with {SQL_COMMENTS},
d as (select distinct uid, pr, body from comments),
k as (select uid, pr, {sql_compiler_block('body')} blk, {sql_agent_instruction('body')} ins, {sql_mention('body')} men from d),
k2 as (select uid, pr, case when blk is not null then 'review' when ins is not null then 'agent'
  when men is not null and men <> '' then 'mention' end kind, blk, ins, men from k),
k3 as (select uid, pr, kind, case kind when 'review' then blk when 'agent' then ins else men end request from k2 where kind is not null),
k4 as (select *, case when kind = 'mention' then {_sql_classify('request', 'fortran')} end intent from k3),
k5 as (select *, {_sql_mention_kind('intent')} mkind from k4),
t as (select uid, pr, kind, request, intent,
  {_sql_first_hit('request', P.CLASS_PATTERNS)} class_name,
  {_sql_first_hit('request', P.FILE_PATTERNS)} file_name,
  {_sql_first_hit('request', P.FUNCTION_PATTERNS)} function_name,
  case when kind = 'review' then {T.sql_render('review', errors='request')}
       when kind = 'agent' then {T.sql_render('agent_task', body='request')}
       else case mkind {" ".join(f"when '{m}' then {T.sql_render(m, body='request')}" for m in _MENTION_KINDS)} end
  end prompt
from k5)
select *, concat('### Assistant reply (', kind, ')', chr(10), chr(10), '```', chr(10), prompt, chr(10), '```') reply
from t"""


@query("stream_triage", SQL_TRIAGE)
def stream_triage(spark, sf_dir):
    """ST2 → ST4 → ST5: each comment once, routed (review command, agent
    command, mention), classified, slots extracted, prompt rendered."""
    s = ST.triage(ST.dedupe_seen(_stream_comments(spark, sf_dir, redeliver=True)))
    s = s.select("uid", "pr", "kind", "request", "intent", "class_name", "file_name", "function_name", "prompt",
                 ST.reply_text(F.col("kind"), F.col("prompt")).alias("reply"))
    # ST5: replies land through foreachBatch, one folder per epoch (idempotent on replay)
    out = scratch_path(spark, "stream-replies")
    ST.finished(ST.sink_responses(s, out, scratch_path(spark, "stream-replies-ckpt")))
    return spark.read.parquet(out).drop("epoch")


@query("stream_landed", f"""with {SQL_COMMENTS}
select distinct uid, pr % 50 pr, {sql_ts('created_at')} from comments""")
def stream_landed(spark, sf_dir):
    """S8 + ST2: comments landed as JSON pages (review pages a second time), read back
    as a stream of several micro-batches, each comment processed once (bounded state).
    User numbers modulo 50 stand for pull requests, so that a page holds many comments."""
    from codelake.sources.comments import read_comment_pages

    root = scratch_path(spark, "landed-pages")
    pages = D.d9_comment_pages(spark, sf_dir).withColumn("pr", F.col("pr") % 50)
    out = None
    for feed, copies in (("issue", 1), ("review", 2), ("submission", 1)):
        stamp = "submitted_at" if feed == "submission" else "created_at"
        one = F.struct("id", F.col("created").alias(stamp), "body", F.struct(F.col("author").alias("login")).alias("user"))
        # a page holds the comments of one request among 100,000 consecutive ids: a size of its own, whatever the table's
        page = pages.where(F.col("feed") == feed).groupBy("pr", F.expr("id div 100000").alias("page")) \
            .agg(F.to_json(F.collect_list(one)).alias("value")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        page.select("pr", "value").repartition("pr").write.option("maxRecordsPerFile", 1).partitionBy("pr").text(f"{root}/{feed}")
        files = spark.read.text(f"{root}/{feed}").select(F.count_distinct("_metadata.file_path")).first()[0]
        s = read_comment_pages(spark, root, feed, stream=True, files_per_trigger=max(1, -(-files // 3)))
        out = s if out is None else out.unionByName(s)
    s = ST.dedupe_seen(CV.union_comments(out), watermark="3650 days").select("uid", "pr", "created_at")
    return _run(spark, s, "landed").withColumn("created_at", ts_text("created_at"))


@query("stream_replayed", SQL_TRIAGE.replace("select *, concat('### Assistant reply", "select uid, pr, kind, concat('### Assistant reply"))
def stream_replayed(spark, sf_dir):
    """ST5 after a failure: the sink stops once its first epoch is written but not yet committed; the service
    starts again from the checkpoint, the epoch is replayed, and every reply stands there once."""
    s = ST.triage(ST.dedupe_seen(_stream_comments(spark, sf_dir, redeliver=True)))
    s = s.select("uid", "pr", "kind", ST.reply_text(F.col("kind"), F.col("prompt")).alias("reply"))
    out, check = scratch_path(spark, "stream-replayed"), scratch_path(spark, "stream-replayed-ckpt")

    def stops(batch, path, epoch):
        ST.write_epoch(batch, path, epoch)
        raise InterruptedError("stopped before the commit")

    try:
        ST.finished(ST.sink_responses(s, out, check, write=stops))
    except Exception as e:  # noqa: BLE001 - only the stop above is expected
        if "stopped before the commit" not in str(e):
            raise
    ST.finished(ST.sink_responses(s, out, check))
    return spark.read.parquet(out).drop("epoch")
