"""J1/T1 beyond one block of queries: exact top-k by cells of the corpus with upper bounds.

The corpus is cut into cells once: a row belongs to the nearest of some
centres (rows of the corpus itself) and, within it, to a range of angles to
that centre.  A cell knows the smallest and largest angle of its rows, so
the triangle inequality of angles bounds what any of them can score:

    angle(query, row) >= max(0, angle(query, centre) - largest, smallest - angle(query, centre)).

A first pass takes each query to its best centre's parts of one load; the k-th best score
there, or among the sampled rows, is a score that k rows of the corpus reach.
In the second pass it meets the cells whose bound reaches that and ``min_sim``,
and of these only rows that reach it leave a task; every other row is
provably not among its k best.  Centres, sample and first pass only steer the
pruning; the result is that of brute force whatever they give.

* the corpus is read a fixed number of times (sample, cells) and shuffled
  twice, for any number of queries;
* a cell of more than ``part_rows`` rows is split: by angle, and where one range
  of angles still holds more (copies of one vector), by a hash of the keys;
* a task holds a load, neighbouring parts of bounded size together, and streams a
  block of the queries that need one of them past it, sorted behind it on disk; a
  query is copied once a load, not once a part, and no side is broadcast or grouped whole;
* within a load a query leaves out the parts whose bound is below its k-th best so far;
* the routing table has one entry for each of at most ``MAX_CENTRES`` x ``BINS``
  cells, so it is bounded whatever the corpus.

Defined cases: rows and queries without a vector, or with a null or non-finite
component, score nothing; a zero vector scores -1.0 with everything; vectors of
different lengths raise; an empty side gives no rows; equal scores rank by the
chunk keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelake.session import scratch_path

CELL_ROWS = 4096               # rows a centre stands for, while there are fewer than MAX_CENTRES
MAX_CENTRES = 256
SAMPLE_ROWS = 1024             # rows whose scores give the first lower bound of the k-th best
BINS = 64                      # ranges of angles between 0 and pi
PART_ROWS = 4096               # rows of a part
PART_BYTES = 64 * 1024 * 1024  # vectors of the parts that a task holds together
TASKS_PER_CORE = 4
TASK_PAIRS = 1 << 22           # pairs that are worth a task
TILE = 1 << 20                 # bounds computed at a time
SLACK = 1e-6                   # above the rounding of an arc cosine near 1


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """The vectors of an array column, all of length ``d``, as rows."""
    if len(col) and set(np.unique(np.diff(np.asarray(col.offsets)))) != {d}:
        raise ValueError("cosine: vectors of different length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def usable(df: DataFrame, keys: list[str], emb: str) -> DataFrame:
    """``keys`` and ``vec`` of the rows whose vector is there and finite (by generated code, without lambdas)."""
    # false only without a NaN and without a null: with a null and no NaN the answer is null
    whole = ~F.array_contains("vec", float("nan"))
    finite = F.coalesce((F.array_max("vec") < float("inf")) & (F.array_min("vec") > float("-inf")), F.lit(True))
    return df.select(*keys, F.col(emb).cast("array<double>").alias("vec")).where(whole & finite)


class Cells:
    """Centres and, per cell, its angles and parts (the numbers ``first`` .. ``first + salts - 1``)."""

    def __init__(self, centres: np.ndarray, sample: np.ndarray, rows: list, part_rows: int) -> None:
        self.centres, self.sample = centres, sample
        self.of_bin: dict[tuple[int, int], int] = {}
        cells: list[list] = []                       # centre, smallest, largest angle, rows
        for centre, b, n, low, high in sorted(rows):
            c = cells[-1] if cells else None
            if c and c[0] == centre and c[3] + n <= part_rows:
                c[1], c[2], c[3] = min(c[1], low), max(c[2], high), c[3] + n
            else:
                cells.append([centre, low, high, n])
            self.of_bin[centre, b] = len(cells) - 1
        self.centre = np.array([c[0] for c in cells], np.int64)
        self.low, self.high = (np.array([c[i] for c in cells], float) for i in (1, 2))
        self.rows = np.array([c[3] for c in cells], np.int64)
        self.salts = -(-self.rows // part_rows)
        self.first = np.concatenate([[0], np.cumsum(self.salts)])[:-1].astype(np.int64)
        self.parts = int(self.salts.sum())

    def bounds(self, q: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The largest score that a row of each (or some) cell can have, per query (unit or zero rows)."""
        centre, low, high = self.centre[some], self.low[some], self.high[some]
        a = angles(q, self.centres)[:, np.maximum(centre, 0)]
        b = np.cos(np.minimum(np.maximum(0, np.maximum(a - high, low - a)), np.pi))
        b[:, centre < 0] = -1.0                      # the cell of zero vectors
        b[~q.any(1)] = -1.0
        return b

    def cell_of(self, part: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, part, side="right") - 1

    def loads(self, rows: int) -> np.ndarray:
        """Per part the number of its load: neighbouring parts of about ``rows`` rows together."""
        size = np.repeat(-(-self.rows // self.salts), self.salts)
        return np.unique((np.cumsum(size) - size) // rows, return_inverse=True)[1].ravel()

    def reach(self, q: np.ndarray, k: int, min_sim: float) -> np.ndarray:
        """The score that a row must have to matter to each query."""
        if len(self.sample) < k:
            return np.full(len(q), min_sim)
        s = q @ self.sample.T
        s[:, ~self.sample.any(1)] = -1.0
        s[~q.any(1)] = -1.0
        return np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], min_sim)

    def home(self, q: np.ndarray) -> np.ndarray:
        """One part of each query's best cell."""
        cell = self.bounds(q).argmax(1)
        return self.first[cell] + np.arange(len(q)) % self.salts[cell]

    def wanted(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``q``, part) of all that can hold a score of ``floor``."""
        row, cell = np.nonzero(self.bounds(q) >= (floor - SLACK)[:, None])
        n = self.salts[cell]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(row, n), np.repeat(self.first[cell], n) + at


def placed(c: DataFrame, keys: list[str], centres: np.ndarray, d: int) -> DataFrame:
    """``c`` with centre (-1: zero vector), angle to it and its bin, and a hash of the keys."""
    schema = T.StructType([*c.schema.fields]).add("hash", "long").add("centre", "integer").add("angle", "double").add("bin", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(matrix(b.column("vec"), d))
            near = (s := u @ centres.T).argmax(1) if len(u) else np.zeros(0, int)
            angle = np.arccos(np.clip(s[np.arange(len(u)), near], -1.0, 1.0)) if len(u) else np.zeros(0)
            near, angle = np.where(u.any(1), near, -1), np.where(u.any(1), angle, 0.0)
            bins = np.minimum((angle / np.pi * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near.astype(np.int32)), pa.array(angle), pa.array(bins)], schema.names)

    return c.select("*", F.xxhash64(*keys).alias("hash")).mapInArrow(run, schema)


def score_topk_cells(queries: DataFrame, chunks: DataFrame, *, k: int, min_sim: float, query_key: str = "qid",
                     chunk_keys: list[str] | tuple[str, ...] = ("chunk_id",), query_emb: str = "embedding",
                     chunk_emb: str = "embedding", cell_rows: int = CELL_ROWS,
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """``(query_key, *chunk_keys, sim)``: of each part of the corpus that a query needs, its ``k`` best rows
    with ``sim >= min_sim``.  ``retrieve.rank_topk`` merges them."""
    from codelake.operators.retrieve import best_rows, first_copies

    keys, spark = list(chunk_keys), chunks.sparkSession
    c = usable(chunks, keys, chunk_emb)
    q = usable(queries, [query_key], query_emb)
    out_schema = T.StructType([q.schema[query_key], *(c.schema[x] for x in keys), T.StructField("sim", T.DoubleType())])
    # bounded: SAMPLE_ROWS rows, chosen by a hash of their keys
    sample = np.array([r["vec"] for r in c.orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE_ROWS).collect()], dtype=float)
    if not len(sample):
        return spark.createDataFrame([], out_schema)
    sample = unit(sample)
    d, n = sample.shape[1], chunks.count()           # unusable rows count too: the number only steers sizes
    full = sample[sample.any(1)]
    centres = full[:max(1, min(MAX_CENTRES, -(-n // cell_rows)))] if len(full) else np.zeros((1, d))

    path = scratch_path(spark, "cells")
    placed(c, keys, centres, d).write.parquet(path)
    p = spark.read.parquet(path)
    asking = scratch_path(spark, "cell-queries")     # both passes read them
    q.select(query_key, "vec").write.parquet(asking)
    q = spark.read.parquet(asking)
    # at most MAX_CENTRES x BINS rows, one per cell
    rows = p.groupBy("centre", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("angle"), F.max("angle")).collect()
    load_rows = max(1, part_bytes // (8 * d))
    cells = Cells(centres, sample, [tuple(r) for r in rows], min(load_rows, PART_ROWS))
    # loads and blocks of queries in balance: few copies of rows (one a block) and of queries (one a load), and tasks for all cores
    asking_rows = q.count()
    wanted_tasks = max(1, min(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-n * asking_rows // TASK_PAIRS)))
    wanted_loads = min(wanted_tasks, int(np.ceil(np.sqrt(wanted_tasks * n / max(1, asking_rows)))))
    load = cells.loads(-(-n // max(-(-n // load_rows), wanted_loads)))
    loads = int(load.max()) + 1
    blocks = -(-wanted_tasks // loads)

    part_cols = [T.StructField("load", T.LongType()), T.StructField("part", T.LongType())]
    kept = T.StructType([*part_cols, *(c.schema[x] for x in keys), c.schema["vec"]])

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.array([cells.of_bin[at] for at in zip(b.column("centre").to_pylist(), b.column("bin").to_pylist())], np.int64)
            h = b.column("hash").to_numpy()
            part = cells.first[cell] + h % cells.salts[cell] if len(cell) else cell
            yield pa.RecordBatch.from_arrays([pa.array(load[part]), pa.array(part), *(b.column(x) for x in keys), b.column("vec")], kept.names)

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, TILE // max(cells.parts, len(sample)))
            for b in batches:
                for i in range(0, b.num_rows, step):
                    some = b.slice(i, step)
                    u = unit(matrix(some.column(1), d))
                    floor = np.maximum(some.column(2).to_numpy(zero_copy_only=False), cells.reach(u, k, min_sim) - SLACK)
                    if first:
                        row, part = np.arange(len(u)), cells.home(u)
                        to = load[part]
                    else:                            # once for each load that holds a part it needs
                        row, part = cells.wanted(u, floor)
                        row, to = np.divmod(np.unique(row * loads + load[part]), loads)
                        part = np.full(len(row), -1)
                    for j in range(0, len(row), 8192):
                        at = pa.array(row[j:j + 8192])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to[j:j + 8192]), pa.array(part[j:j + 8192]), some.column(0).take(at), some.column(1).take(at),
                             pa.array(floor[row[j:j + 8192]])], floored.names)

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []              # the rows of one load
        ready = None
        for b in batches:
            corpus = int((b.column("side").to_numpy() == 0).sum())
            if corpus:
                held.append(b.slice(0, corpus))
            some = b.slice(corpus)
            if not some.num_rows or not held:
                continue
            if ready is None:
                whole = pa.Table.from_batches(held)
                ids, m = whole.select(keys), np.concatenate([matrix(x.column("vec"), d) for x in held])
                order = pc.sort_indices(ids, sort_keys=[(x, "ascending") for x in keys], null_placement="at_start").to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                part = whole.column("part").to_numpy()
                of = first_copies(m, place, k)
                begins = np.concatenate([[0], np.nonzero(np.diff(part[of]))[0] + 1])
                held = held[:1]                      # the matrix and the keys stand for them
                ready = m[of], place[of], ids.take(pa.array(of)).combine_chunks(), part[of[begins]], list(zip(begins, [*begins[1:], len(of)]))
            m, place, ids, parts, areas = ready
            asked, home = matrix(some.column("vec"), d), some.column("part").to_numpy()
            u, centre = unit(asked), cells.centre[cells.cell_of(home)]

            def bounds(a: int, b: int) -> np.ndarray:
                cell = cells.cell_of(parts)
                near = (home[a:b, None] < 0) | (centre[a:b, None] == cells.centre[cell])
                return np.where(near, cells.bounds(u[a:b], cell), -np.inf)

            at, row, sim = best_rows(m, asked, place, k, np.array(some.column("floor")), areas, bounds)
            if len(at):
                yield from pa.Table.from_arrays([some.column("qkey").take(pa.array(at)), *ids.take(pa.array(row)).columns, pa.array(sim)],
                                                out_schema.names).to_batches()

    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    qkey = T.StructField("qkey", q.schema[query_key].dataType)
    floored = T.StructType([*part_cols, qkey, c.schema["vec"], T.StructField("floor", T.DoubleType())])

    def passed(asked: DataFrame, first: bool) -> DataFrame:
        """``asked``: key, vector and a score that ``k`` rows are known to reach."""
        task = lambda block: (F.col("load") * blocks + block).cast("int").alias("task")
        left = p.mapInArrow(to_parts, kept).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
            task(F.col("block")), "part", F.lit(0).alias("side"), *keys, none(qkey), "vec", F.lit(None).cast("double").alias("floor"))
        right = asked.mapInArrow(route(first), floored).select(
            task(F.pmod(F.xxhash64("qkey", "vec"), F.lit(blocks))), "part", F.lit(1).alias("side"), *[none(c.schema[x]) for x in keys],
            "qkey", "vec", "floor")
        return left.unionByName(right).repartitionById(loads * blocks, F.col("task")).sortWithinPartitions("side", "part") \
            .drop("task").mapInArrow(score, out_schema)

    least = F.lit(float(min_sim))
    near = passed(q.select(query_key, "vec", least.alias("floor")), True)
    reached = near.groupBy(query_key).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("s")).where(F.col("n") >= k)
    asked = q.join(reached, query_key, "left").select(query_key, "vec", F.coalesce("s", least).alias("floor"))
    return passed(asked, False)
