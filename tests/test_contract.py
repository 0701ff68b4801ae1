"""The driver contract: entry, queries, oracle SQL, checked against DuckDB at sf0.001."""

import math

import pytest

import __spark_entry__ as E
from inputs import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["conv_id", "turn", "context", "n_chunks"]


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    try:
        import pandas as pd
        if v is not None and not isinstance(v, (str, bytes, list, tuple, dict)) and pd.isna(v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime().replace(tzinfo=None)
    except (TypeError, ValueError):
        pass
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


def _types(pdf):
    """Column types; whole numbers with nulls come as float64 from one engine and Int64 from the other."""
    return {c: "nullable number" if pdf[c].isna().any() and t in ("float64", "Int64") else t for c, t in pdf.dtypes.astype(str).items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    d = duck.execute(E.oracle_sql()[name]).df()
    assert _rows(s) == _rows(d)
    # same column types as the oracle (the driver compares schemas too)
    assert _types(s) == _types(d)


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0
