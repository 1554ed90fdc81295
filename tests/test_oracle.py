"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["events", "documents", "pages", "benchmark", "labels", "conversations"]
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def test_every_query_has_oracle_or_is_listed():
    # the corpus operators' own tests cover those that SQL does not express
    assert {q for q in set(QUERIES) - set(SQL) if q.startswith("q_")} == set()
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(q for q in SQL if q.startswith("q_")))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        assert TYPES.get(t, t) == duck_types[f.name], (f.name, t, duck_types[f.name])
    idx = [rel.columns.index(c) for c in df.columns]
    drows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    assert sorted(srows, key=_key) == sorted(drows, key=_key)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["timestamp", "subreddit", "sum_sentiment_score", "sum_sentiment_score_sma"]
    assert df.count() > 0


def test_series_arrays_rows(spark):
    df = QUERIES["q_series_arrays"](spark, SF_SMALL)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["series"], r["position"])):
        got.setdefault(r["series"], []).append(r)
    assert {"nasdaq_index", "bitcoin_index"} <= set(got)
    for points in got.values():
        assert [p["position"] for p in points] == list(range(len(points)))
        assert [p["timestamp"] for p in points] == sorted(p["timestamp"] for p in points)
    assert got["nasdaq_index"][0]["visible"] is True
    assert os.path.isdir(SF_SMALL)
