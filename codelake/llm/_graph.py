"""Connected components of an undirected graph, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm._tables import discard, landed


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (longs).  One row per node of an edge: id, comp (the smallest node it reaches).

    Each round every node takes the smallest label among its own and its
    neighbours', then its label's label.  Minima are combined before the
    shuffle, so a node with very many edges costs one row per task.
    """
    both = landed(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = landed(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("a"), "comp"), "a") \
            .groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("heard"))
        stepped = labels.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "heard").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("comp").alias("up"))
        new = landed(stepped.join(up, "next", "left").select("id", "old", F.least("next", "up").alias("comp")), "labels")
        changed = new.where("comp <> old").limit(1).count()
        discard(labels)
        labels = new.select("id", "comp")
        labels._codelake_path = new._codelake_path
        if not changed:
            discard(both)
            return labels
