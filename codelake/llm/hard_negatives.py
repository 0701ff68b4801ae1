"""Hard negatives by Kronecker-packed integer products.

Scores are integer inner products.  Several candidates share one wide
integer: each component, biased so that it is not negative, lies in a field
of its own, and the fields are so wide that a whole inner product fits into
one.  An anchor's component is multiplied with the wide integer once, for
all candidates in it; after the last component the fields hold the products,
from which the bias is taken off.  The scores are exact.

The width follows from the data (largest component, number of components).
Fields that fit into 53 bits are packed into the integers that a double
holds exactly, so that the multiply-adds are a matrix product; wider ones
into Python integers of as many 64-bit fields as a batch has candidates.

Anchors are a stated set, taken in blocks of bounded size: a block is
broadcast and the rows are scored where they are, without a shuffle.  A
first pass keeps each anchor's best rows of its label, its positives; a
second one the best rows of other labels within each positive's bounds.
Tasks keep the best per anchor (and positive) only, which are then ranked
over all tasks.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as padded with
zeros, an empty one scores 0; equal scores are ranked by id; an anchor's own
id is not among its positives; rows with one id are separate rows, and an
anchor id in several rows is mined for each; an anchor without positives, or
a positive without negatives, gives no row; an empty table gives an empty
result; long vectors make smaller blocks; other columns are ignored.  Scores
must fit in 62 bits: a table whose largest component allows more is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed
from codelake.operators.ordering import global_index
from codelake.session import scratch_path

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90             # percent of the positive's score
BLOCK_BYTES = 16 << 20         # anchors broadcast at a time, in bytes of their components
BLOCK_ANCHORS = 8192
TILE_CELLS = 1 << 20           # scores held at a time in a task
NONE = np.iinfo(np.int64).min  # below every score
_MINED = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def quantised(vector: Column, scale: int = 256) -> Column:
    """Each component x as the integer floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """The vector is there and all of its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


class Packing:
    """How candidates with components up to ``largest`` are packed, ``dim`` of them a vector."""

    def __init__(self, largest: int, dim: int) -> None:
        self.dim, self.bias = dim, largest
        self.bound = max(1, dim) * max(1, largest) * max(1, 2 * largest)         # of a biased product
        if 2 * self.bound >= 1 << 63:
            raise ValueError(f"scores of {dim} components up to {largest} do not fit in 62 bits")
        self.bits = self.bound.bit_length() + 1                                  # a field, with its sign
        self.fields = 53 // self.bits

    def pack(self, rows: np.ndarray):
        """Wide integers of the rows' components, by component and word."""
        biased = rows.T + self.bias
        if not self.fields:
            return [int.from_bytes(np.ascontiguousarray(c).astype("<u8").tobytes(), "little") for c in biased], biased.sum(0)
        n, w = rows.shape[0], self.fields
        full = np.zeros((self.dim, -(-n // w) * w), np.float64)
        full[:, :n] = biased
        return full.reshape(self.dim, -1, w) @ (2.0 ** (self.bits * np.arange(w)))

    def scores(self, anchors: np.ndarray, words, n: int) -> np.ndarray:
        """The inner products of anchors (integers, one a row) with the ``n`` packed rows."""
        own = self.bias * anchors.sum(1)
        if not self.fields:
            words, sums = words
            out = np.empty((len(anchors), n), np.int64)
            for i, a in enumerate((anchors + self.bias).tolist()):               # biased too, so that no field borrows
                total = sum(x * word for x, word in zip(a, words))
                out[i] = np.frombuffer(total.to_bytes(8 * n + 8, "little"), "<u8")[:n].astype(np.int64)
            return out - self.bias * sums[None, :] - own[:, None]
        left = anchors.astype(np.float64) @ words
        parts, one = [], 2.0 ** self.bits
        for _ in range(self.fields - 1):                                         # the lowest field, with its sign
            rest = np.floor(left / one + 0.5)
            parts.append(left - rest * one)
            left = rest
        out = np.stack([*parts, left], axis=2).reshape(len(anchors), -1)[:, :n].astype(np.int64)
        return out - own[:, None]


def _best(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best allowed scores of each row and their ids; ``ids`` ascend, the smaller one wins a tie."""
    n = scores.shape[1]
    if bound * n >= 1 << 62:
        scores_key = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.int64)
    else:
        scores_key = scores
    key = np.where(ok, scores_key * n + np.arange(n - 1, -1, -1), NONE)
    top = np.partition(key, n - k, axis=1)[:, n - k:] if n > k else key
    at = n - 1 - top % n
    there = top != NONE
    return np.where(there, np.take_along_axis(scores, at, 1), NONE), np.where(there, ids[at], 0)


class _Top:
    """The best ``k`` rows of each of ``n`` lists, over the batches of a task."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[lists], score], axis=1)
        ids = np.concatenate([self.id[lists], ids], axis=1)
        order = np.lexsort((ids, ~score), axis=1)[:, :self.k]
        self.score[lists] = np.take_along_axis(score, order, 1)
        self.id[lists] = np.take_along_axis(ids, order, 1)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """id, label and components of each batch's rows, by id; a batch's components take 32 MB at most."""
    size = max(1, (4 << 20) // max(1, dim))
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            order = np.argsort(part.column(0).to_numpy(), kind="stable")
            yield part.column(0).to_numpy()[order], part.column(1).to_numpy()[order], _matrix(part.column(2), dim)[order]


def _positives(rows: DataFrame, block, packing: Packing, k: int) -> DataFrame:
    """Each anchor's best rows of its label: anchor (number in the block), id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_id, a_label, a = block.value
        top = _Top(len(a_id), k)
        for ids, labels, x in _batches(batches, packing.dim):
            for label in np.intersect1d(labels, a_label):
                mine, of = np.flatnonzero(labels == label), np.flatnonzero(a_label == label)
                words, near = packing.pack(x[mine]), ids[mine]
                tile = max(1, TILE_CELLS // len(mine))
                for i in range(0, len(of), tile):
                    t = of[i:i + tile]
                    s = packing.scores(a[t], words, len(mine))
                    top.add(t, *_best(s, near != a_id[t][:, None], near, k, packing.bound))
        at, j = np.nonzero(top.score != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top.id[at, j]), pa.array(top.score[at, j])], ["anchor", "id", "score"])

    return rows.mapInArrow(run, "anchor bigint, id bigint, score bigint")


def _negatives(rows: DataFrame, block, positives, packing: Packing, k: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels within each positive's bounds: pair (its number), id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_id, a_label, a = block.value
        score = positives.value[0]                                               # anchors x positives, NONE where there are fewer
        n, each = score.shape
        some = score != NONE
        exact = np.where(some, score, 0).astype(object)                          # Python integers: a percentage needs more bits
        least = np.where(some, -(-low * exact // 100), 1).astype(np.int64)
        most = np.where(some, high * exact // 100, 0).astype(np.int64)
        top = _Top(n * each, k)
        for ids, labels, x in _batches(batches, packing.dim):
            words = packing.pack(x)
            tile = max(1, TILE_CELLS // len(ids))
            for i in range(0, n, tile):
                s = packing.scores(a[i:i + tile], words, len(ids))
                other = labels != a_label[i:i + tile, None]
                for j in range(each):
                    lists = np.arange(i, min(i + tile, n)) * each + j
                    floor = np.maximum(least[i:i + tile, j], top.score[lists, k - 1])   # what the task has already is as good
                    ok = other & (s >= floor[:, None]) & (s <= most[i:i + tile, j, None])
                    hit = np.flatnonzero(ok.any(1))
                    if len(hit):
                        top.add(lists[hit], *_best(s[hit], ok[hit], ids, k, packing.bound))
        at, j = np.nonzero(top.score != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top.id[at, j]), pa.array(top.score[at, j])], ["pair", "id", "score"])

    return rows.mapInArrow(run, "pair bigint, id bigint, score bigint")


def _ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``rows``: vec_id, label, vector (integers).  Rows where ``anchors`` holds are mined against all rows.

    One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    whole = rows.where("vec_id is not null and label is not null and vector is not null").select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.col("vector").cast("array<bigint>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = landed(whole, "integer-vectors")
    size = whole.agg(F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("largest"),
                     F.count_if("anchor").alias("anchors")).first()
    dim, of = size["dim"] or 0, size["anchors"] or 0
    packing = Packing(size["largest"] or 0, dim)
    all_rows = whole.select("id", "label", "v")
    picked = landed(whole.where("anchor").select("id", "label", "v", F.monotonically_increasing_id().alias("nth")), "anchors")
    picked = global_index(picked, ["id", "nth"], "place")

    path = scratch_path(spark, "llm-hard-negatives")
    spark.createDataFrame([], _MINED).write.parquet(path)
    step = max(1, min(block_anchors, BLOCK_BYTES // (8 * max(1, dim))))
    for first in range(0, of, step):
        at = picked.where((F.col("place") >= first) & (F.col("place") < first + step))
        got = at.select("id", "label", "v").orderBy("place").toArrow().combine_chunks()     # one block: bounded
        cols = [got.column(i).combine_chunks() for i in range(3)]
        a_id = cols[0].to_numpy(zero_copy_only=False)
        block = spark.sparkContext.broadcast((a_id, cols[1].to_numpy(zero_copy_only=False), _matrix(cols[2], dim)))
        best = _ranked(_positives(all_rows, block, packing, positives), "anchor", positives).toArrow()     # a few rows an anchor
        score, pid = np.full((len(a_id), positives), NONE), np.zeros((len(a_id), positives), np.int64)
        where = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
        score[where], pid[where] = best.column("score").to_numpy(), best.column("id").to_numpy()
        bounds = spark.sparkContext.broadcast((score, pid, a_id))
        found = _ranked(_negatives(all_rows, block, bounds, packing, negatives, low, high), "pair", negatives)
        _named(found, bounds, positives).write.mode("append").parquet(path)
        block.unpersist()
        bounds.unpersist()
    for t in (whole, picked):
        discard(t)
    return spark.read.schema(_MINED).parquet(path)


def _named(found: DataFrame, bounds, each: int) -> DataFrame:
    """Ranked rows with the ids and scores that a pair's number stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, pid, a_id = bounds.value
        for batch in batches:
            pair = batch.column(0).to_numpy()
            at = pair // each, pair % each
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_id[at[0]]), pa.array(pid[at]), batch.column(3), batch.column(1), pa.array(score[at]), batch.column(2)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.select("pair", "id", "score", "rank").mapInArrow(run, _MINED)


def oracle(every: int = 100) -> str:
    """DuckDB SQL for the query over ``embeddings``."""
    return f"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label+1) % 10 else label end label,
  [floor(256 * x::double) for x in embedding]::double[] v
  from embeddings where label is not null and embedding is not null
  and not list_bool_or(list_concat([false], [x is null or not isfinite(x) for x in embedding]))),
s as (select a.vec_id a, b.vec_id b, a.label = b.label same, list_dot_product(a.v, b.v)::bigint s
  from r a join r b on a.vec_id <> b.vec_id or a.label <> b.label where a.vec_id % {every} = 0),
p as (select a, b p, s ps from s where same qualify row_number() over (partition by a order by s desc, b) <= {POSITIVES}),
n as (select p.a, p, ps, b, s, row_number() over (partition by p.a, p order by s desc, b) k
  from p join s on s.a = p.a and not same and {LOW} * ps <= 100 * s and 100 * s <= {HIGH} * ps)
select a anchor_id, p positive_id, k::integer rank, b negative_id, ps positive_score, s negative_score from n where k <= {NEGATIVES}"""
