"""Every query of the core runs on the smallest data; those with SQL give DuckDB's rows."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

CATALOGUES = [importlib.import_module(f"tidewright.plans.{m}").catalogue for m in ("problems", "news_panel", "studies", "streams")]
QUERIES = {n: q for c in CATALOGUES for n, q in c.queries.items()}
SQL = {n: s for c in CATALOGUES for n, s in c.sql.items()}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in os.listdir(data):
        c.execute(f"create view {p.split('.')[0]} as select * from '{data}/{p}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, pd.Timestamp):
        return str((x.tz_localize(None) if x.tz else x)).replace(" 00:00:00", "")
    return x if isinstance(x, (int, bool)) else str(x)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name not in SQL:
        assert df.count() >= 0
        return
    assert rows(df.toPandas()) == rows(duck.execute(SQL[name]).df())


def test_names_are_taken_once():
    assert len(QUERIES) == sum(len(c.queries) for c in CATALOGUES)
    with pytest.raises(ValueError):
        CATALOGUES[0].add("p1_found")(lambda s, d: None)
