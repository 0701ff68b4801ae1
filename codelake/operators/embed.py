"""Text → embedding.

Two embedders share one contract (text column in, ``array<double>`` out,
``null`` when the text is blank or the embedder fails, row kept):

* ``hash_embed`` — native and JVM-side: a hashed bag of words.  A token
  is a whitespace-separated piece of the lower-cased text; its bucket is
  the first 8 hex digits of its MD5 read as an integer, modulo ``dim``.
  The vector is built row-locally with one ``aggregate`` over the token
  buckets (each MD5 computed once), so embedding adds no shuffle.
* ``embed_with`` — a user's own embedding function, run batch-wise
  through ``mapInPandas``; each partition embeds its rows, with the
  reference's retry policy (2 attempts, 1 s apart, 60 s per call).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.functions.text import WS, clip_text, pystrip
from codelake.operators.calls import limited

# Embedder settings (fixed values): 2 attempts, 1 s apart, 60 s per call.
EMBED_ATTEMPTS = 2
RETRY_SLEEP_S = 1.0
CALL_TIMEOUT_S = 60.0
DEFAULT_DIM = 64
CALL_TEXTS = 64          # texts in one call of a plug-in embedder


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    return F.filter(F.split(F.lower(_c(text)), WS + "+", -1), lambda t: t != F.lit(""))


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_embed(text, dim: int = DEFAULT_DIM, max_chars: int | None = None) -> Column:
    """Native hashed bag-of-words vector as a column expression; ``null`` for blank text.

    ``max_chars`` clips like the reference's embedder input (strip, then the
    first ``max_chars`` characters); ``None`` embeds the whole text.

    Row-local and shuffle-free, but its per-token update of the ``dim``
    counts is a higher-order lambda, which Spark does not compile: use it for
    single values and short texts.  For tables use ``hash_embed_table``
    (generated code, same vectors).
    """
    t = _c(text)
    src = clip_text(t, max_chars) if max_chars else t
    zeros = F.array_repeat(F.lit(0.0).cast("double"), dim)
    vec = F.aggregate(
        F.transform(tokens(src), lambda tok: token_bucket(tok, dim)), zeros,
        lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    return F.when(t.isNull() | (pystrip(t) == F.lit("")), F.lit(None).cast("array<double>")).otherwise(vec)


# Vector components, and tokens, that the table embedder holds at a time (32 MB, and about 30 MB).
EMBED_CELLS = 1 << 22
EMBED_TOKENS = 1 << 19


def _count_vectors(words: pa.Array, dim: int) -> pa.Array:
    """The bucket counts of lists of words; no word: null.  A slice shares its offsets with the array it is of."""
    n = len(words)
    offsets = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    bucket = np.array([-1 if not t else int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                       for t in coded.dictionary.to_pylist()] or [-1])
    lengths = np.where(np.asarray(words.is_valid()), np.diff(offsets), 0)
    b = bucket[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
    cell = (np.repeat(np.arange(n), lengths) * dim + b)[b >= 0]
    counts = np.bincount(cell, minlength=n * dim).astype(float).reshape(n, dim)
    some = counts.any(axis=1)
    ends = np.concatenate([[0], np.cumsum(np.where(some, dim, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(counts[some].ravel()), mask=pa.array(~some))


def hash_embed_arrow(text, dim: int = DEFAULT_DIM, max_chars: int | None = None) -> Column:
    """X1 as an Arrow function of a text column, same vectors as ``hash_embed``.

    The JVM splits the text into words; Python gets them and nothing else of the row.  Rows are taken
    in slices of at most ``EMBED_TOKENS`` words (or one text), so memory follows the longest text, not the batch."""
    src = clip_text(_c(text), max_chars) if max_chars else _c(text)
    rows = max(1, EMBED_CELLS // dim)

    @F.arrow_udf("array<double>")
    def run(words: pa.Array) -> pa.Array:
        ends, parts, i = np.asarray(words.offsets).astype(np.int64)[1:], [], 0
        before = int(words.offsets[0].as_py()) if len(words) else 0
        while i < len(words):
            j = int(np.searchsorted(ends, before + EMBED_TOKENS, side="right"))
            j = max(i + 1, min(j, i + rows))
            parts.append(_count_vectors(words.slice(i, j - i), dim))
            before, i = ends[j - 1], j
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run(F.split(F.lower(src), WS + "+", -1))


def hash_embed_table(df: DataFrame, keys: list[str], text_col: str, dim: int = DEFAULT_DIM,
                     out_col: str = "embedding", max_chars: int | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """X1 for a whole table: ``(*keys, *keep, out_col)``; same vectors as ``hash_embed``.

    A text is one row, so it is embedded in place, without a shuffle: the JVM
    splits it into tokens, and an Arrow function counts their buckets for some
    rows at a time, hashing each distinct token of them once.  Other columns stay in the JVM.
    """
    return df.select(*keys, *(keep or []), hash_embed_arrow(text_col, dim, max_chars).alias(out_col))


def sparse(vec_col: str, keep: list[str], df: DataFrame) -> DataFrame:
    """``(keep..., bucket, cnt)`` for the non-zero entries of a vector column."""
    return (df.select(*keep, F.posexplode(vec_col).alias("bucket", "cnt"))
              .filter(F.col("cnt") != 0.0)
              .withColumn("bucket", F.col("bucket").cast("bigint")))


def embed_with(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float] | None]],
               out_col: str = "embedding", attempts: int = EMBED_ATTEMPTS,
               sleep_s: float = RETRY_SLEEP_S, timeout_s: float = CALL_TIMEOUT_S,
               call_texts: int = CALL_TEXTS, max_chars: int | None = None) -> DataFrame:
    """Plug-in embedder: ``fn`` maps a list of texts to a list of vectors.

    Null and blank texts get a null vector and are never sent.  Other texts
    are stripped, clipped to ``max_chars`` if given (F6), and sent at most
    ``call_texts`` at a time; the time limit holds for each call.  A call that
    fails ``attempts`` times is repeated text by text; a text that still fails
    gets a null vector.  Every row is kept.  A call that hangs is given up
    after the limit; its thread is a daemon and ends with the worker.
    """
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def call(texts: list[str]):
        for k in range(attempts):
            try:
                return limited(fn, timeout_s, texts)
            except Exception:  # noqa: BLE001 - the reference logs and moves on
                if k + 1 < attempts:
                    time.sleep(sleep_s)
        return None

    def run(batches: Iterator):
        for pdf in batches:
            texts = [None if t is None or t != t else t.strip()[:max_chars] for t in pdf[text_col]]
            vecs: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t]
            for a in range(0, len(some), call_texts):
                part = some[a:a + call_texts]
                got = call([texts[i] for i in part])
                if got is None and len(part) > 1:
                    got = [(call([texts[i]]) or [None])[0] for i in part]
                for i, v in zip(part, got or []):
                    vecs[i] = None if v is None else [float(x) for x in v]
            pdf[out_col] = vecs
            yield pdf

    return df.mapInPandas(run, out_schema)
