"""Columns that are computed once however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """``df`` with further columns (aliased).

    The optimiser copies a projected expression into every later use; lambdas
    then repeat it per element.  Exploding a one-element array stops that at no
    cost but the array."""
    return df.withColumn("_once", F.explode(F.array(F.struct(*cols)))).select("*", "_once.*").drop("_once")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value within one expression: it names the value as often as it likes, the value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)
