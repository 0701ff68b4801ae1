"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and taken relative to their mean; a random
rotation spreads each over all coordinates, and the signs are its code, D
packed bits.  With two correction scalars (the length of the residual, and
the inner product of the code with what it stands for) a code gives an
unbiased estimate of an inner product with a known error bound.  A query is
rated against all codes; rows whose upper bound reaches the k-th largest
lower bound are rated exactly, in double precision on the original vectors.

Rows are dealt to blocks of about ``BLOCK_ROWS`` by their id, queries to
blocks of about ``BLOCK_QUERIES``, and a task takes one block of each, so
memory is bounded whatever the sizes; each query keeps k rows of each block,
and the best k of those.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most common
one (ties: the smaller), nor rows with a null vec_id; of rows with one vec_id
the smallest vector counts; a query's own vec_id is no candidate; with fewer
candidates than k all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2048
EPSILON = 2.0                  # width of the error bound, in its standard deviations; a neighbour is lost beyond about twice that
TILE = 128                     # queries rated at a time
SEED = 3


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _rows(col: pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)           # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray, turn: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed code, residual length, code quality and inner product with the centre of each vector."""
    u = _unit(v)
    rest = (u - centre) @ turn.T
    length = np.sqrt((rest * rest).sum(axis=1))
    quality = np.abs(rest).sum(axis=1) / (math.sqrt(v.shape[1]) * np.maximum(length, 1e-300))
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, quality, 1.0), u @ centre


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The cosine of each row with the query; one row's value does not depend on the other rows."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * math.sqrt((query * query).sum()))


def _once(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per id: the smallest vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, v
    keys = np.lexsort([*v.T[::-1], ids])
    ids, v = ids[keys], v[keys]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], v[first]


def nearest_in(ids: np.ndarray, v: np.ndarray, codes, q_ids: np.ndarray, q: np.ndarray, turn: np.ndarray, centre: np.ndarray, k: int):
    """(query, row, score) of each query's k nearest among some rows."""
    packed, length, quality, with_centre = codes
    d = v.shape[1]
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
    bound = EPSILON * np.sqrt(np.maximum(1 - quality ** 2, 0)) / (quality * math.sqrt(max(d - 1, 1)))
    out_q, out_r, out_s = [], [], []
    unit = _unit(q)
    turned = (unit - centre) @ turn.T
    size = np.sqrt((turned * turned).sum(axis=1))
    for a in range(0, len(q), TILE):
        b = min(a + TILE, len(q))
        part = (signs @ turned[a:b].T.astype(np.float32)) / (math.sqrt(d) * quality[:, None])
        rating = length[:, None] * part + with_centre[:, None] + (unit[a:b] @ centre - centre @ centre)
        slack = (length * bound)[:, None] * size[a:b] + 1e-5
        own = ids[:, None] == q_ids[a:b]
        low = np.where(own, -np.inf, rating - slack)
        kth = np.partition(low, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(b - a, -np.inf)
        near = (rating + slack >= kth) & ~own
        for j in range(b - a):
            rows = np.flatnonzero(near[:, j])
            s = exact(v[rows], q[a + j])
            best = np.lexsort((ids[rows], -s))[:k]
            out_q.append(np.full(len(best), q_ids[a + j]))
            out_r.append(ids[rows[best]])
            out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _centre(v: DataFrame, d: int) -> np.ndarray:
    """The mean of the unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d), 0
        for b in batches:
            if b.num_rows:
                total, n = total + _unit(_rows(b.column(0), d)).sum(axis=0), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n).tobytes()], pa.binary())], ["s"])

    s = np.sum([np.frombuffer(bytes(r[0])) for r in v.select("v").mapInArrow(run, "s binary").collect()], axis=0)  # one row per task
    return s[:d] / max(s[d], 1)


def search(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k nearest: query_id, rank (from 1), vec_id, score.  ``is_query`` is a condition on vec_id."""
    schema = "query_id bigint, vec_id bigint, score double"
    v = usable(vectors)
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")) \
        .orderBy(F.desc("n"), "d").first()
    if sizes is None:
        found = v.sparkSession.createDataFrame([], schema)
    else:
        d = sizes["d"]
        v = v.where(F.size("v") == d)
        turn, centre = rotation(d), _centre(v, d)
        rows_n, queries_n = max(1, -(-sizes["n"] // block_rows)), max(1, -(-sizes["q"] // block_queries))

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    packed, length, quality, with_centre = encode(_rows(b.column(1), d), turn, centre)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(length), pa.array(quality),
                         pa.array(with_centre)], ["vec_id", "v", "code", "length", "quality", "with_centre"])

        def block(n: int, salt: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).alias(salt)

        def every(n: int, name: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)

        index = v.mapInArrow(codes, "vec_id bigint, v array<double>, code binary, length double, quality double, with_centre double")
        index = index.select("*", block(rows_n, "rows"), every(queries_n, "queries"))
        asked = v.where(is_query).select("*", block(queries_n, "queries"), every(rows_n, "rows"))

        def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return none
            if len(np.unique(left.column("vec_id").to_numpy())) < left.num_rows:
                ids, vec = _once(left.column("vec_id").to_numpy(), _rows(left.column("v"), d))
                coded = encode(vec, turn, centre)
            else:
                ids, vec = left.column("vec_id").to_numpy(), _rows(left.column("v"), d)
                packed = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                coded = (packed, *(left.column(c).to_numpy() for c in ("length", "quality", "with_centre")))
            q_ids, q = _once(right.column("vec_id").to_numpy(), _rows(right.column("v"), d))
            a, b, s = nearest_in(ids, vec, coded, q_ids, q, turn, centre, k)
            return pa.table({"query_id": a, "vec_id": b, "score": s})

        found = index.groupBy("rows", "queries").cogroup(asked.groupBy("rows", "queries")).applyInArrow(
            lambda key, left, right: meet(key, left, right), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int, k: int = K) -> str:
    """DuckDB SQL for ``search`` of ``embeddings`` with every so-manieth vec_id as a query (exact search)."""
    return f"""
with v as (select vec_id, embedding::double[] v from embeddings where vec_id is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0),
d as (select len(v) d from v group by 1 order by count(*) desc, 1 limit 1),
u as (select vec_id, v from v, d where len(v)=d),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1,len(q.v)+1), lambda i: q.v[i]*c.v[i]))
      /(sqrt(list_sum(list_transform(c.v, lambda x: x*x)))*sqrt(list_sum(list_transform(q.v, lambda x: x*x)))) score
      from u q join u c on q.vec_id%{every}=0 and c.vec_id<>q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank<={k}"""
