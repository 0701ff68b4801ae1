"""Exact vector retrieval: J1 score_pairs, W4 rank_chunks, T1 retrieve_topk, A6 context.

The result is that of brute force, as in the reference: every query against
every chunk, ``cos >= min_sim``, then the ``k`` best per query ordered by
``(-sim, chunk order key)``.

Physical plan (checked with ``explain``):

* the **query side** is the small side.  Its rows and bytes (rows x dim x
  8) are checked first; within the bounds it is broadcast and the scoring is a
  ``BroadcastNestedLoopJoin`` whose condition holds the threshold, so pairs
  under ``min_sim`` are never materialised.  The corpus is scanned once,
  in place, with no shuffle.
* above that bound ``retrieve_topk`` turns to ``cells``: the corpus in parts
  with upper bounds, read a fixed number of times for any number of queries.
  ``score_pairs`` meets blocks of queries with salted parts of the corpus in an
  equi-join.  The same scores, no unbounded broadcast.
* top-k is ``row_number() <= k`` over the query, which Spark plans as a
  partial ``WindowGroupLimit`` before the shuffle and a final one after, so
  a query that matches a third of the corpus ships only ``k`` rows per
  map task.
* norms are computed once per row (Catalyst does not hoist them), and only
  ``(key, embedding)`` travels through the join: payload columns are joined
  back for the ``k`` winners (late materialisation).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.functions import vectors as V
from codelake.operators.cells import SLACK, score_topk_cells

# Reference defaults (fixed values): k = 5, similarity threshold 0.3.
DEFAULT_K = 5
DEFAULT_MIN_SIM = 0.3
# Largest query side that is broadcast, in rows and in bytes of float64
# vectors (rows x dim x 8); beyond either bound the blocked equi-join runs.
MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
TILE_QUERIES = 1024            # queries of a tile
TILE_ROWS = 512                # rows of a tile: its similarities (2 MB) stay in the cache
EXACT_PAIRS = 1 << 12          # candidates scored exactly at a time (2 MB a side at 64 components)
WAITING_PAIRS = 1 << 14        # scored candidates held before only the best are kept


def query_side_fits(q: DataFrame, emb: str, max_rows: int = MAX_BROADCAST_QUERIES,
                    max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[bool, int]:
    """The size check for broadcasting the query side: ``(fits, rows)``.

    One aggregate job returns the row count and the largest vector length,
    so the byte estimate holds for any embedding width."""
    r = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(emb)).alias("d")).first()
    n, d = int(r["n"]), int(r["d"] or 0)
    return (n <= max_rows and n * max(d, 1) * 8 <= max_bytes), n


def _prep(df: DataFrame, emb: str, prefix: str) -> DataFrame:
    v = V.as_double(emb)
    return (df.filter(F.col(emb).isNotNull())          # P2: unembedded rows never score
              .withColumn(f"{prefix}vec", v)
              .withColumn(f"{prefix}norm", V.norm(F.col(f"{prefix}vec"))))


def score_pairs(queries: DataFrame, chunks: DataFrame, *, query_key: str = "qid",
                chunk_keys: list[str] | tuple[str, ...] = ("chunk_id",),
                query_emb: str = "embedding", chunk_emb: str = "embedding",
                min_sim: float = DEFAULT_MIN_SIM,
                max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """``(query_key, *chunk_keys, sim)`` for every pair with ``sim >= min_sim``."""
    chunk_keys = list(chunk_keys)
    q = _prep(queries.select(query_key, query_emb), query_emb, "q_").drop(query_emb)
    c = _prep(chunks.select(*chunk_keys, chunk_emb), chunk_emb, "c_").drop(chunk_emb)

    sim = V.cosine(F.col("q_vec"), F.col("c_vec"), F.col("q_norm"), F.col("c_norm"))
    fits, n_queries = query_side_fits(q, "q_vec", max_broadcast_queries)   # the size check
    if fits:
        joined = c.join(F.broadcast(q), sim >= F.lit(min_sim), "inner")
    else:
        per_block = max(1, min(max_broadcast_queries, MAX_BROADCAST_BYTES // (8 * max(
            1, q.agg(F.max(F.size("q_vec"))).first()[0] or 1))))
        blocks = -(-n_queries // per_block)
        qb = q.withColumn("qblock", F.pmod(F.xxhash64(query_key), F.lit(blocks)))
        # every query block meets the corpus in ``salts`` separate parts, so no key holds the whole corpus
        salts = max(1, int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        qb = qb.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        cb = c.withColumn("part", F.pmod(F.xxhash64(*chunk_keys), F.lit(salts))) \
              .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        joined = cb.join(qb, (cb["qblock"] == qb["qblock"]) & (cb["part"] == qb["part"]) & (sim >= F.lit(min_sim)), "inner")
    return joined.select(query_key, *chunk_keys, sim.alias("sim"))


def _lengths(M):
    """The length of each row, its squares summed in component order."""
    import numpy as np

    total = np.zeros(len(M))
    for d in range(M.shape[1]):
        total += M[:, d] * M[:, d]
    return np.sqrt(total)


def _exact(rows, cols, size):
    """Cosine of each row pair, whose lengths multiply to ``size``, summed in component
    order as the JVM form does: one pair's value depends on nothing but its two vectors."""
    import numpy as np

    dot = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        dot += rows[:, d] * cols[:, d]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size == 0, -1.0, dot / size)         # F1: zero norm scores -1.0


def _marked(S, limit):
    """Where ``S`` reaches its row's ``limit``: ``(row, column)`` in row order.  Rows without such a
    place are left out by their maximum, and of the others eight places are looked at together."""
    import numpy as np

    some = np.flatnonzero(S.max(1) >= limit)
    if not len(some):
        return some, some
    n = S.shape[1]
    hit = np.zeros((len(some), -(-n // 8) * 8), bool)
    np.greater_equal(S[some], limit[some, None], out=hit[:, :n])
    eight = np.flatnonzero(hit.view(np.uint64))
    at, nth = np.nonzero(hit.reshape(-1, 8)[eight])
    at, col = np.divmod(eight[at] * 8 + nth, hit.shape[1])
    return some[at], col


def _units(M):
    """Rows at length 1 in single precision, and which of them are zero."""
    import numpy as np

    size = np.sqrt((M * M).sum(1))
    return np.divide(M, size[:, None], out=np.zeros_like(M), where=size[:, None] > 0).astype(np.float32), size == 0


def first_copies(C, place, k: int):
    """The rows of ``C`` that can be among a query's ``k`` best, in row order: finite ones, and of equal vectors,
    which score alike, the ``k`` that come first."""
    import numpy as np

    if not C.size:
        return np.arange(len(C))
    copy = np.unique(np.ascontiguousarray(C).view(np.dtype((np.void, C.shape[1] * C.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((place, copy))
    begins = np.concatenate([[0], np.nonzero(np.diff(copy[order]))[0] + 1])
    nth = np.arange(len(C)) - np.repeat(begins, np.diff(np.append(begins, len(C))))
    kept = np.sort(order[nth < k])
    return kept[np.isfinite(C[kept]).all(1)]


def best_rows(C, Q, place, k: int, least, areas=None, bounds=None):
    """Per query the ``k`` best rows of ``C``, equal scores by ``place``: ``(query, row, cosine)`` arrays.

    Only scores that reach ``least``, a number per query, count; where ``k`` rows were found it is raised to
    a score they reach.  ``areas`` are ranges of rows and ``bounds(a, b)`` what the queries from ``a`` to ``b``
    can score there at most; an area is left out for queries whose bound is below what they have.

    A product in single precision picks candidates with a margin above its rounding; they alone are scored
    exactly.  Queries and rows are taken in tiles of ``TILE_QUERIES`` and ``TILE_ROWS``, so the product stays in
    the cache, and of the candidates only the best are kept after each ``WAITING_PAIRS``."""
    import numpy as np

    margin = (C.shape[1] + 8) * 2.0 ** -23
    (cu, cz), (qu, qz) = _units(C), _units(Q)
    c_size, q_size = _lengths(C), _lengths(Q)
    areas = [(0, len(C))] if areas is None else areas
    usable = np.isfinite(Q).all(1)
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    product = np.empty(TILE_QUERIES * TILE_ROWS, np.float32)
    found = []

    def merged(parts, cut):
        q, r, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < k
        q, r, s, nth = q[kept], r[kept], s[kept], nth[kept]
        last = nth == k - 1
        cut[q[last]] = np.maximum(cut[q[last]], s[last])
        return q, r, s

    for a in range(0, len(Q), TILE_QUERIES):
        b = min(a + TILE_QUERIES, len(Q))
        cut, fresh, held, waiting = least[a:b], np.ones(b - a, bool), [empty], 0
        bound = None if bounds is None else bounds(a, b)
        for j in range(len(areas)) if bound is None else np.argsort(-bound.mean(0), kind="stable"):
            lo, end = areas[j]
            ask = np.flatnonzero(usable[a:b] if bound is None else usable[a:b] & (bound[:, j] >= cut - SLACK))
            if not len(ask):
                continue
            asked, zero = qu[a:b][ask], qz[a:b][ask]
            for lo in range(lo, end, TILE_ROWS):
                hi = min(lo + TILE_ROWS, end)
                S = np.matmul(asked, cu[lo:hi].T, out=product[:len(ask) * (hi - lo)].reshape(len(ask), hi - lo))
                if cz[lo:hi].any():
                    S[:, cz[lo:hi]] = -1.0
                if zero.any():
                    S[zero] = -1.0
                new = fresh[ask]
                if hi - lo > k and new.any():                # k rows reach the k-th best of these
                    kth = np.partition(S[new], hi - lo - k, axis=1)[:, hi - lo - k]
                    cut[ask[new]] = np.maximum(cut[ask[new]], kth - margin)
                    fresh[ask[new]] = False
                at, row = _marked(S, (cut[ask] - 2 * margin).astype(np.float32))
                for i in range(0, len(at), EXACT_PAIRS):
                    q, r = ask[at[i:i + EXACT_PAIRS]], row[i:i + EXACT_PAIRS] + lo
                    s = _exact(C[r], Q[a + q], c_size[r] * q_size[a + q])
                    good = s >= cut[q]
                    held.append((q[good], r[good], s[good]))
                    waiting += int(good.sum())
                    if waiting > WAITING_PAIRS:
                        held, waiting = [merged(held, cut)], 0
        q, r, s = merged(held, cut)
        found.append((q + a, r, s))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else empty


def batch_topk(C, Q, keys_pdf, k: int, least, order_keys: list[str]):
    """The ``k`` best rows of a chunk batch per query, ties by the order keys, as ``best_rows`` (which raises ``least``)."""
    import numpy as np

    order = keys_pdf.reset_index(drop=True).sort_values(order_keys, kind="mergesort", na_position="first").index.to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kept = first_copies(C, place, k)
    q, r, s = best_rows(C[kept], Q, place[kept], k, least)
    if not len(q):
        return None
    top = keys_pdf.iloc[kept[r]].reset_index(drop=True)
    top.insert(0, "q_idx", q.astype("int64"))
    top["sim"] = s
    return top


def score_topk_numpy(queries: DataFrame, chunks: DataFrame, *, k: int, min_sim: float,
                     query_key: str = "qid", chunk_keys: list[str] | tuple[str, ...] = ("chunk_id",),
                     query_emb: str = "embedding", chunk_emb: str = "embedding",
                     max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """J1 + per-batch top-k, the queries in one block of bounded size.

    A block (at most ``max_broadcast_queries`` rows and ``MAX_BROADCAST_BYTES``)
    is fetched and broadcast, and the corpus is scored against it in place,
    without a shuffle.  More queries go through ``cells``, so the corpus is never
    read once per block.  The score of a pair is the same either way.  Only the
    ``k`` best rows of a batch per query leave a task; ``rank_topk`` merges them.
    """
    import numpy as np

    chunk_keys = list(chunk_keys)
    q = queries.select(query_key, query_emb).filter(F.col(query_emb).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    r = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_emb)).alias("d")).first()
    per_block = max(1, min(max_broadcast_queries, MAX_BROADCAST_BYTES // (8 * max(1, r["d"] or 1))))
    blocks = max(1, -(-r["n"] // per_block))
    if blocks > 1:
        out = score_topk_cells(q, chunks, k=k, min_sim=min_sim, query_key=query_key, chunk_keys=chunk_keys,
                               query_emb=query_emb, chunk_emb=chunk_emb)
        q.unpersist()
        return out
    spark = chunks.sparkSession
    out_schema = T.StructType([T.StructField("q_idx", T.LongType())] + list(chunks.select(*chunk_keys).schema.fields)
                              + [T.StructField("sim", T.DoubleType())])
    rows = q.collect()                                                   # bounded: one block
    q.unpersist()
    bq = spark.sparkContext.broadcast(np.array([r[query_emb] for r in rows], dtype=np.float64))

    def run(batches):
        least = np.full(len(bq.value), float(min_sim))       # raised from batch to batch
        for pdf in batches:
            pdf = pdf[pdf[chunk_emb].notna()]
            if len(pdf) == 0 or len(bq.value) == 0:
                continue
            C = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[chunk_emb]])
            if C.shape[1] != bq.value.shape[1]:
                raise ValueError("cosine: vectors of different length")
            top = batch_topk(C, bq.value, pdf[chunk_keys], k, least, chunk_keys)
            if top is not None:
                yield top[[f.name for f in out_schema.fields]]

    ids = spark.createDataFrame([(i, r[query_key]) for i, r in enumerate(rows)],
                                T.StructType([T.StructField("q_idx", T.LongType()), q.schema[query_key]]))
    # one row per query of the block: a bounded broadcast
    return chunks.select(*chunk_keys, chunk_emb).mapInPandas(run, out_schema).join(F.broadcast(ids), "q_idx").drop("q_idx")


def rank_topk(scored: DataFrame, k: int, *, query_key: str = "qid",
              order_keys: list[str] | tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """W4 + T1 slice: best ``k`` per query by ``(-sim, order_keys)``; adds ``rank``."""
    w = Window.partitionBy(query_key).orderBy(F.col("sim").desc(), *[F.col(c).asc() for c in order_keys])
    return (scored.withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= k)
                  .withColumn("rank", F.col("rank").cast("bigint")))


def retrieve_topk(queries: DataFrame, chunks: DataFrame, *, k: int = DEFAULT_K,
                  min_sim: float = DEFAULT_MIN_SIM, query_key: str = "qid",
                  chunk_keys: list[str] | tuple[str, ...] = ("chunk_id",),
                  query_emb: str = "embedding", chunk_emb: str = "embedding",
                  max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
                  strategy: str = "numpy") -> DataFrame:
    """T1 for a whole table of queries: threshold first, then k per query.

    ``chunk_keys`` is also the tie-break order (the reference's list
    position), so give ``(file, pos)`` for a loaded index.

    ``strategy="numpy"`` (default): queries that fit one block are broadcast,
    candidates by a matrix product per Arrow batch, exact scores for the
    candidates, final ``WindowGroupLimit``; more queries go the way of
    ``"cells"``.  ``"cells"``: parts of the corpus with upper bounds, each met
    by the queries that need it (``operators.cells``).  ``"native"``: the cosine
    as JVM higher-order functions (no Python workers; slower, since lambdas are
    interpreted).  All sum a pair's products in component order, so ranks are
    the same.
    """
    if strategy == "cells":
        scored = score_topk_cells(queries, chunks, k=k, min_sim=min_sim, query_key=query_key,
                                  chunk_keys=chunk_keys, query_emb=query_emb, chunk_emb=chunk_emb)
    elif strategy == "numpy":
        scored = score_topk_numpy(queries, chunks, k=k, min_sim=min_sim, query_key=query_key,
                                  chunk_keys=chunk_keys, query_emb=query_emb, chunk_emb=chunk_emb,
                                  max_broadcast_queries=max_broadcast_queries)
    else:
        scored = score_pairs(queries, chunks, query_key=query_key, chunk_keys=chunk_keys,
                             query_emb=query_emb, chunk_emb=chunk_emb, min_sim=min_sim,
                             max_broadcast_queries=max_broadcast_queries)
    return rank_topk(scored, k, query_key=query_key, order_keys=chunk_keys)


def retrieve_single(query_vec: Column, chunks: DataFrame, *, k: int = DEFAULT_K,
                    min_sim: float = DEFAULT_MIN_SIM,
                    chunk_keys: list[str] | tuple[str, ...] = ("chunk_id",),
                    chunk_emb: str = "embedding") -> DataFrame:
    """T1 for one query given as a column expression (a literal or a scalar subquery).

    Plans as a filter on the scan plus ``TakeOrderedAndProject``: one pass,
    each task keeps ``k`` rows.
    """
    chunk_keys = list(chunk_keys)
    c = _prep(chunks.select(*chunk_keys, chunk_emb), chunk_emb, "c_")
    qv = V.as_double(query_vec)
    sim = V.cosine(qv, F.col("c_vec"), V.norm(qv), F.col("c_norm"))
    scored = c.select(*chunk_keys, sim.alias("sim")).filter(F.col("sim") >= F.lit(min_sim))
    top = scored.orderBy(F.col("sim").desc(), *[F.col(x).asc() for x in chunk_keys]).limit(k)
    return top


def attach_payload(top: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Late materialisation: join payload columns back for the winners only.

    ``top`` grows with the number of queries, so the join strategy is left to
    the optimiser, which sees its size at run time.
    """
    return chunks.join(top, list(keys), "inner")


def build_context(ranked: DataFrame, *, query_key: str = "qid", text_col: str = "ctx_text",
                  sep: str = "\n\n") -> DataFrame:
    """Per query, the rendered chunks in rank order joined by a blank line.

    At most ``k`` rows per query are collected (bounded group).
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(text_col).alias("t"))))
    return ranked.groupBy(query_key).agg(
        F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias("context"),
        F.count("*").cast("bigint").alias("n_chunks"))
