"""Vector math as native higher-order functions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    """Embeddings arrive as ``array<float>``; all arithmetic is float64."""
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Dot product; unequal lengths raise (``zip_with`` would null-pad)."""
    a, b = _c(a), _c(b)
    prod = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), prod).otherwise(
        F.raise_error(F.lit("cosine: vectors of different length")))


def norm(v) -> Column:
    v = _c(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """F1: dot / (|a| |b|); a zero norm or a null vector gives -1.0.

    Pass precomputed norms to avoid recomputing them for every pair.
    """
    a, b = _c(a), _c(b)
    na = norm(a) if norm_a is None else _c(norm_a)
    nb = norm(b) if norm_b is None else _c(norm_b)
    denom = na * nb
    return (F.when(a.isNull() | b.isNull(), F.lit(-1.0))
            .when(denom == 0.0, F.lit(-1.0))
            .otherwise(dot(a, b) / denom))
