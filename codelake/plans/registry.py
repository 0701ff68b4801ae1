"""The registered queries: one per operator of the inventory.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the given
tables.  Most carry an equivalent DuckDB SQL text (the oracle); the few
that are not SQL-expressible carry none and are checked by tests against a
brute-force reference on small inputs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelake.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle SQL text."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)          # semantic settings (UTC, map key policy)
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # importing the plan modules registers their queries
    from codelake.plans import (  # noqa: F401
        answers_q, codeeval_q, conversation_q, corpus_q, prompts_q, retrieval_q, streams_q, traindata_q,
    )


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
