"""Registered queries for vector math and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelake.functions import vectors as V
from codelake.operators import retrieve as R
from codelake.plans.registry import query
from codelake.sources.tables import read_table

# DuckDB text shared by the oracles: double vectors, norms, cosine with the -1.0 rule.
_SQL_VEC = """e as (select vec_id, embedding::DOUBLE[] v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) n
           from embeddings where embedding is not null)"""
_SQL_COS = "case when a.n * b.n = 0 then -1.0 else list_dot_product(a.v, b.v) / (a.n * b.n) end"


def centroid(emb_df, col: str = "embedding"):
    """Mean vector of a table, as an ``array<double>`` (a two-step aggregate)."""
    per_dim = (emb_df.filter(F.col(col).isNotNull())
               .select(F.posexplode(V.as_double(col)).alias("d", "x"))
               .groupBy("d").agg(F.avg("x").alias("m")))
    return per_dim.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))),
                                   lambda s: s["m"]).alias("c"))


@query("cosine_pairs", f"""with {_SQL_VEC}
select a.vec_id, b.vec_id next_id, round({_SQL_COS}, 9) cos
from e a join e b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    """F1 on every vector and its successor by id (an equi-join)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = e.filter(F.col("embedding").isNotNull()).alias("a")
    b = e.filter(F.col("embedding").isNotNull()).alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    cos = V.cosine(V.as_double(F.col("a.embedding")), V.as_double(F.col("b.embedding")))
    return j.select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("next_id"),
                    F.round(cos, 9).alias("cos"))


def _each_vector(spark, sf_dir, strategy: str):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = R.retrieve_topk(e.withColumnRenamed("vec_id", "qid"), e, k=R.DEFAULT_K, min_sim=R.DEFAULT_MIN_SIM,
                          query_key="qid", chunk_keys=["vec_id"], strategy=strategy)
    return top.select("qid", "vec_id", "rank", F.round("sim", 9).alias("sim"))


_SQL_TOPK = f"""with {_SQL_VEC},
s as (select a.vec_id qid, b.vec_id, {_SQL_COS} sim from e a, e b),
r as (select *, row_number() over (partition by qid order by sim desc, vec_id) rk from s where sim >= 0.3)
select qid, vec_id, cast(rk as bigint) rank, round(sim, 9) sim from r where rk <= 5"""


@query("retrieve_topk", _SQL_TOPK)
def retrieve_topk(spark, sf_dir):
    """Every vector is a query; its 5 nearest (cos >= 0.3) in the table."""
    return _each_vector(spark, sf_dir, "numpy")


@query("retrieve_cells", _SQL_TOPK)
def retrieve_cells(spark, sf_dir):
    """T1/J1 as ``retrieve_topk``, by cells of the table with upper bounds: the way of query tables beyond a block."""
    return _each_vector(spark, sf_dir, "cells")


@query("retrieve_single", f"""with {_SQL_VEC},
d as (select unnest(range(len(v))) d, unnest(v) x from e),
c as (select list(m order by d) v from (select d, avg(x) m from d group by d)),
q as (select c.v, sqrt(list_dot_product(c.v, c.v)) n from c),
s as (select e.vec_id, case when e.n * q.n = 0 then -1.0 else list_dot_product(q.v, e.v) / (e.n * q.n) end sim from e, q)
select vec_id, cast(row_number() over (order by sim desc, vec_id) as bigint) rank, round(sim, 9) sim
from s where sim >= 0.3 order by sim desc, vec_id limit 5""")
def retrieve_single(spark, sf_dir):
    """T1 for one query: the table centroid, against the whole table."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # one bounded row (dim values) comes back: the query vector, as a literal
    qvec = F.lit(centroid(e).first()["c"]).cast("array<double>")
    top = R.retrieve_single(qvec, e, k=R.DEFAULT_K, min_sim=R.DEFAULT_MIN_SIM, chunk_keys=["vec_id"])
    # k rows at most: the rank is numbered after the TakeOrderedAndProject
    return top.select("vec_id", F.row_number().over(
        Window.orderBy(F.col("sim").desc(), "vec_id"))
        .cast("bigint").alias("rank"), F.round("sim", 9).alias("sim"))
