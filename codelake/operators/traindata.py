"""Training-data preparation.

W3 is the reference's line loop rewritten as a set rule over a line table;
X3 replaces a per-row tokenizer with a corpus vocabulary built by Spark
(count, rank, join back), so ids are stable for the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.functions.text import pyrstrip, pystrip
from codelake.operators.ordering import global_index

# Markers and sizes (fixed values).
INSTRUCTION = "instruction:"
RESPONSE = "response:"
PAIR_HEAD = rf"(?md)^{INSTRUCTION}[^\n]*"
UP_TO_RESPONSE = rf"(?sd)^(?:.*\n)?{RESPONSE}[^\n]*"     # all up to the last response line
MAX_LEN = 2048
IGNORE_INDEX = -100
# Vocabulary layout (ours): 0 unknown, 1 end of sequence; padding reuses
# the end-of-sequence id, as the reference sets pad = eos.
UNK_ID = 0
EOS_ID = 1
PAD_ID = EOS_ID
FIRST_TOKEN_ID = 2
# Texts whose windows are Python objects at a time
WINDOW_TEXTS = 64
# Tokens of texts that share a dictionary (a longer text has one of its own)
BLOCK_TOKENS = 1 << 20
# Token rule (ours): ASCII word runs, or any single other non-space character.
TOKEN_RE = (r"[A-Za-z0-9_]+|[^A-Za-z0-9_\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def parse_pairs(lines: DataFrame, file_keys: list[str]) -> DataFrame:
    """``(*file_keys, pair_no, instruction, response)`` from text lines.

    A pair opens at a line starting ``instruction:``; a ``response:`` line
    drops what was collected so far (its own inline text too); the response
    is the other lines after the last ``response:`` of the pair, stripped.
    Lines before the first instruction belong to pair 1.
    """
    w = Window.partitionBy(*file_keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = pyrstrip(F.col("line"))
    df = (lines.withColumn("_l", line)
               .withColumn("_ins", F.startswith(F.col("_l"), F.lit(INSTRUCTION)))
               .withColumn("_res", F.startswith(F.col("_l"), F.lit(RESPONSE)))
               .withColumn("pair_no", F.greatest(F.sum(F.col("_ins").cast("int")).over(w), F.lit(1)).cast("bigint")))
    wp = Window.partitionBy(*file_keys, "pair_no")
    df = df.withColumn("_last_res", F.max(F.when(F.col("_res"), F.col("line_no"))).over(wp))
    is_body = ~F.col("_ins") & ~F.col("_res") & (F.col("_last_res").isNull() | (F.col("line_no") > F.col("_last_res")))
    parts = F.array_sort(F.collect_list(F.when(is_body, F.struct("line_no", F.col("_l").alias("v")))))
    instr = F.first(F.when(F.col("_ins"), pystrip(F.substring(F.col("_l"), len(INSTRUCTION) + 1, 1 << 30))),
                    ignorenulls=True)
    g = df.groupBy(*file_keys, "pair_no").agg(
        instr.alias("instruction"),
        F.max(F.col("_ins").cast("int")).alias("_has"),
        pystrip(F.array_join(F.transform(parts, lambda s: s["v"]), "\n")).alias("response"))
    return g.filter(F.col("_has") == 1).drop("_has")


def parse_pairs_files(files: DataFrame, file_keys: list[str], lines_col: str = "lines") -> DataFrame:
    """W3 in each file's row, from its lines as an array; the rows of ``parse_pairs``."""
    text = F.array_join(F.transform(lines_col, lambda l: pyrstrip(l)), "\n")
    # one-element arrays are exploded so that no later use repeats the expressions before them
    df = files.select(*file_keys, F.explode(F.array(text)).alias("_t"))
    heads, pieces = F.regexp_extract_all("_t", F.lit(PAIR_HEAD), F.lit(0)), F.split("_t", PAIR_HEAD, -1)
    df = df.select(*file_keys, F.explode(F.array(F.struct(heads.alias("h"), pieces.alias("p")))).alias("_f"))
    # lines before the first instruction belong to pair 1
    bodies = F.transform(F.slice("_f.p", 2, 1 << 30), lambda p, i: F.when(
        i == 0, F.concat(F.regexp_replace(F.get("_f.p", F.lit(0)), r"(?d)\n\z", ""), p)).otherwise(p))
    df = df.select(*file_keys, F.posexplode(F.arrays_zip(F.col("_f.h").alias("h"), bodies.alias("b"))).alias("_i", "_c"))
    return df.select(*file_keys, (F.col("_i") + 1).cast("bigint").alias("pair_no"),
                     pystrip(F.substring("_c.h", len(INSTRUCTION) + 1, 1 << 30)).alias("instruction"),
                     pystrip(F.regexp_replace("_c.b", UP_TO_RESPONSE, "")).alias("response"))


def sft_prompt(instruction, response) -> Column:
    """F27."""
    return F.concat(F.lit("Instruction:\n"), F.col(instruction) if isinstance(instruction, str) else instruction,
                    F.lit("\n\nResponse:\n"), F.col(response) if isinstance(response, str) else response)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def code_texts(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """X3, first step: texts as token numbers, with a dictionary per block of texts.

    A block is what a task has at hand, up to ``BLOCK_TOKENS`` tokens (or one text).  One row per text,
    ``(*keys, block, codes)``, where codes are numbers in the block's dictionary (null text: no code), and one
    row per block with its distinct tokens and their counts.  Texts are split into tokens here and nowhere else;
    the table is written once to the shared folder, since both the vocabulary and the encoding read it."""
    from codelake.session import scratch_path

    spark = texts.sparkSession
    path = scratch_path(spark, "coded-texts")
    tokenised = texts.select(*keys, F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("_tokens"))
    own = texts.select(*keys).schema
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in own.fields), T.StructField("block", T.StringType()), T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = 0
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(n_keys))).astype(np.int64)
            ends, i = np.cumsum(sizes), 0
            while i < batch.num_rows:
                before = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right")))
                part = batch.slice(i, j - i)
                coded = part.column(n_keys).flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                n, seen = part.num_rows, len(coded.dictionary)
                name = f"{TaskContext.get().partitionId()}-{block}"
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(np.int32), pa.array(codes, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n_keys], pa.array([name] * n), lists, pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=schema.names)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, c.type) for c in part.columns[:n_keys]), pa.array([name]), pa.nulls(1, pa.list_(pa.int32())),
                     pa.array([coded.dictionary.cast(pa.string()).to_pylist()], pa.list_(pa.string())),
                     pa.array([np.bincount(codes, minlength=seen).tolist()], pa.list_(pa.int64()))], names=schema.names)
                i, block = j, block + 1

    tokenised.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _entries(coded: DataFrame) -> DataFrame:
    """``(block, code, token, count)`` of all blocks' dictionaries."""
    return coded.where("tokens is not null").select("block", F.posexplode(F.arrays_zip("tokens", "counts")).alias("code", "e")) \
        .select("block", "code", F.col("e.tokens").alias("token"), F.col("e.counts").alias("count"))


def vocabulary(coded: DataFrame) -> DataFrame:
    """X3 vocabulary: ``(token, id, count)`` by descending count then token.

    Counts are added up over blocks, a partial aggregate; numbering uses the distributed ``global_index`` (no
    single-task window).  The result is checkpointed to the shared folder (lineage cut)."""
    from codelake.session import checkpoint_dir

    counts = _entries(coded).groupBy("token").agg(F.sum("count").alias("count"))
    ranked = global_index(counts, [F.col("count").desc(), F.col("token").asc()], "rank")
    vocab = ranked.select("token", (F.col("rank") + FIRST_TOKEN_ID).cast("int").alias("id"), "count")
    # built once: every use reads the checkpoint in the shared folder
    checkpoint_dir(vocab.sparkSession)
    return vocab.checkpoint(eager=True)


def encode_coded(coded: DataFrame, keys: list[str], vocab: DataFrame) -> DataFrame:
    """``(*keys, ids array<int>)`` in token order (unknown tokens → ``UNK_ID``).

    Only dictionary entries meet the vocabulary: a token once a block, however often it occurs there.  A
    block's ids then meet the block's texts, which are translated by array look-up; no row is ever one token."""
    found = _entries(coded).join(vocab.select("token", "id"), "token", "left").select(
        F.col("block").alias("of"), "code", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    rows = coded.where("tokens is null").select(*keys, "block", "codes")
    out = rows.select(*keys).schema.add("ids", T.ArrayType(T.IntegerType()))

    def translate(key: tuple[pa.Scalar, ...], texts: pa.Table, entries: pa.Table) -> pa.Table:
        ids = np.full(entries.num_rows, UNK_ID, np.int32)
        ids[entries.column("code").to_numpy()] = entries.column("id").to_numpy()
        codes = texts.column("codes").combine_chunks()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        flat = ids[codes.flatten().to_numpy(zero_copy_only=False)]
        edges = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(codes)))]).astype(np.int32)
        return pa.table({**{k: texts.column(k) for k in keys}, "ids": pa.ListArray.from_arrays(edges, pa.array(flat, pa.int32()))})

    # a group is one block: bounded
    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(translate, out)


def build_vocab(texts: DataFrame, text_col: str) -> DataFrame:
    """``vocabulary`` of a table of texts."""
    return vocabulary(code_texts(texts, [], text_col))


def encode(texts: DataFrame, keys: list[str], text_col: str, vocab: DataFrame) -> DataFrame:
    """``encode_coded`` of a table of texts with a given vocabulary."""
    return encode_coded(code_texts(texts, keys, text_col), keys, vocab)


def encode_fixed(ids: Column, n: int = MAX_LEN, pad_id: int = PAD_ID) -> Column:
    """ids truncated to ``n``, padded to ``n`` with ``pad_id``."""
    full = F.slice(ids, 1, n)
    return F.concat(full, F.array_repeat(F.lit(pad_id), F.lit(n) - F.size(full)))


def encode_windows(ids: Column, n: int = MAX_LEN, pad_id: int = PAD_ID) -> Column:
    """The whole sequence as windows of ``n`` ids, the last one padded (an empty one gives one window)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(ids) - 1) / n).cast("int")))
    return F.transform(starts, lambda w: encode_fixed(F.slice(ids, w * n + 1, n), n, pad_id))


def mask_labels(ids: Column, pad_id: int = PAD_ID) -> Column:
    """labels = ids with every ``pad_id`` (by value) set to -100."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def window_texts(ids: Column, n: int = MAX_LEN, pad_id: int = PAD_ID) -> Column:
    """F28 and F29 as text: ``array<struct<input_ids, labels>>``, one entry for each of ``encode_windows``, its ids and
    its masked labels joined by blanks.  Only the ids a text has are turned into text, padding is cut from one constant."""
    pads = [f" {pad_id}" * n, f" {IGNORE_INDEX}" * n]
    kind = pa.list_(pa.struct([("input_ids", pa.string()), ("labels", pa.string())]))

    def rows(lists: pa.Array) -> pa.Array:
        out = []
        for codes in lists.to_pylist():
            if codes is None:
                out.append(None)
                continue
            windows = []
            for at in range(0, max(1, len(codes)), n):
                part = codes[at:at + n]
                own = list(map(str, part))
                masked = [str(IGNORE_INDEX) if x == pad_id else t for x, t in zip(part, own)] if pad_id in part else own
                rest = n - len(part)
                windows.append({name: (" ".join(words) + pad[:rest * (len(pad) // n)]).lstrip(" ")
                                for name, words, pad in zip(("input_ids", "labels"), (own, masked), pads)})
            out.append(windows)
        return pa.array(out, kind)

    @F.arrow_udf("array<struct<input_ids: string, labels: string>>")
    def run(lists: pa.Array) -> pa.Array:
        parts = [rows(lists.slice(i, WINDOW_TEXTS)) for i in range(0, len(lists), WINDOW_TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(ids)
