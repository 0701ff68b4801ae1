"""ST1-ST5: the comment watcher as Structured Streaming queries.

The reference polls a pull request every few seconds, re-reads the whole
conversation, answers the newest comment once and remembers answered ids
in memory.  Here landed comment pages are a file source; each trigger
processes only new files:

* ST1 ``comment_stream``: ``readStream`` over landed pages (schema fixed),
  ``processingTime`` trigger in service, ``availableNow`` in tests.
* ST2 ``dedupe_seen``: ``dropDuplicates(["uid"])`` before the mention
  filter, so comments without a mention are marked seen too; the state is
  checkpointed (survives restarts and lost executors).  With a watermark the
  state holds the uids of the last ``delay`` of event time only: older ones
  are evicted, and a comment from before the watermark, delivered again or
  for the first time, is dropped as late.  ``disk_state`` keeps state on
  executors' disks with checkpoints in the shared folder, not in their heaps.
* ST3 ``latest_per_pr``: streaming ``max_by`` per pull request, in update
  mode kept up to date by ``upserts.sink_upserts``: a trigger writes the
  requests that changed, nothing else.
* ST4 ``triage``: the batch Column functions, unchanged, on the stream.
* ST5 ``sink_responses``: ``foreachBatch`` writing each micro-batch to its
  own epoch folder with ``overwrite``, so a replayed batch is idempotent.

Outputs go to Parquet in the shared checkpoint folder, never to driver
memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions import prompts as P
from codelake.functions import templates as T
from codelake.operators.conversation import union_comments

DEFAULT_STATE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Poll intervals (fixed values): assistant 2 s, tool 10 s.
ASSISTANT_POLL = "2 seconds"
TOOL_POLL = "10 seconds"


def comment_stream(spark: SparkSession, landed_dir: str, schema: str, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: a streaming DataFrame over landed files (Parquet)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(landed_dir)


def dedupe_seen(comments: DataFrame, watermark: str | None = None) -> DataFrame:
    """ST2: each uid once.  With ``watermark`` the state is bounded by event time."""
    if watermark is None:
        return comments.dropDuplicates(["uid"])
    return (comments.withColumn("_wm", F.col("created_at").cast("timestamp"))
                    .withWatermark("_wm", watermark)
                    .dropDuplicatesWithinWatermark(["uid"]).drop("_wm"))


def mentions(comments: DataFrame, marker: str = P.DEFAULT_MENTION) -> DataFrame:
    """F8 on the stream: comments that address the assistant, with the prompt."""
    p = P.mention_prompt(F.col("body"), marker)
    return comments.withColumn("prompt", p).filter(F.col("prompt").isNotNull() & (F.col("prompt") != ""))


def latest_per_pr(comments: DataFrame) -> DataFrame:
    """ST3: newest comment per pull request (update or complete mode); ties as in ``latest_comment``."""
    key = F.struct(F.col("created_at"), -F.col("feed_order"), -F.col("id"))
    rec = F.struct("uid", "created_at", "body", "author", "source")
    return comments.groupBy("pr").agg(F.max_by(rec, key).alias("c")).select("pr", "c.*")


def disk_state(spark: SparkSession) -> None:
    """State of queries started from now on lives on disk (set only where the cluster names no provider)."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, DEFAULT_STATE) == DEFAULT_STATE:
        spark.conf.set(name, DISK_STATE)


def _mention_kind(intent: Column) -> Column:
    return (F.when(intent == "compilation", "compilation_fortran").when(intent == "codeadvising", "codeadvising_fortran")
            .when(intent == "explaining", "explaining_fortran").when(intent == "code_generation", "agent_task")
            .when(intent == "scaffolding", "task_type").otherwise("intent"))


def triage(comments: DataFrame, marker: str = P.DEFAULT_MENTION) -> DataFrame:
    """ST4: review command, then agent command, then mention; others dropped.

    Adds ``kind, request, intent, class_name, file_name, function_name, prompt``.
    """
    block = P.compiler_block(F.col("body"))
    instr = P.agent_instruction(F.col("body"))
    ment = P.mention_prompt(F.col("body"), marker)
    kind = (F.when(block.isNotNull(), "review").when(instr.isNotNull(), "agent")
            .when(ment.isNotNull() & (ment != ""), "mention"))
    request = F.when(kind == "review", block).when(kind == "agent", instr).otherwise(ment)
    df = comments.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("request", request)
    intent = F.when(F.col("kind") == "mention", P.classify_intent(F.col("request"), "fortran"))
    df = df.withColumn("intent", intent)
    prompt = (F.when(F.col("kind") == "review", T.render_prompt("review", errors=F.col("request")))
              .when(F.col("kind") == "agent", T.render_prompt("agent_task", body=F.col("request")))
              .otherwise(T.render_by_kind(_mention_kind(F.col("intent")), body=F.col("request"))))
    return df.select("*", P.extract_class("request").alias("class_name"),
                     P.extract_file("request").alias("file_name"),
                     P.extract_function("request").alias("function_name"), prompt.alias("prompt"))


def reply_text(kind: Column, text: Column) -> Column:
    """ST5: the posted reply: a heading and a fenced body."""
    return F.concat(F.lit("### Assistant reply ("), kind, F.lit(")\n\n```\n"), text, F.lit("\n```"))


def write_epoch(batch: DataFrame, path: str, epoch: int) -> None:
    """The rows of one epoch in a folder of its own; an epoch replayed after a failure replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def sink_responses(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, write=write_epoch):
    """ST5: ``foreachBatch`` → one Parquet folder per epoch, overwritten on replay."""
    w = df.writeStream.foreachBatch(lambda batch, epoch: write(batch, path, epoch)).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                   trigger: dict | None = None) -> list[dict]:
    """Run a stream until the available input is consumed; results in ``path``.  Returns the progress of its triggers.

    ``append``: the file sink (exactly once via its commit log).
    ``complete``: ``foreachBatch`` overwriting ``path`` with the full result.
    """
    trig = trigger or {"availableNow": True}
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trig).start())
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
               .outputMode(mode).trigger(**trig).start())
    return finished(q)


def finished(q) -> list[dict]:
    """Wait for a query that ends by itself; the progress of its triggers, or its failure."""
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return list(q.recentProgress)


def start_watcher(spark: SparkSession, landed_root: str, replies_path: str, checkpoint: str,
                  marker: str = P.DEFAULT_MENTION, poll: str = ASSISTANT_POLL,
                  dedupe_watermark: str | None = None):
    """The service: landed comment pages (S8) → union (U1) → each uid once
    (ST2) → triage (ST4) → replies (ST5), polling every ``poll``.

    ``checkpoint`` must be on the shared filesystem (``spark.checkpoint.dir``);
    a restarted or moved driver resumes from it without answering twice.
    """
    from codelake.sources.comments import read_comment_pages

    disk_state(spark)
    feeds = [read_comment_pages(spark, landed_root, f, stream=True) for f in ("issue", "review", "submission")]
    pages = feeds[0].unionByName(feeds[1]).unionByName(feeds[2])
    replies = triage(dedupe_seen(union_comments(pages), dedupe_watermark), marker)
    replies = replies.withColumn("reply", reply_text(F.col("kind"), F.col("prompt")))
    return sink_responses(replies, replies_path, checkpoint, trigger={"processingTime": poll})
