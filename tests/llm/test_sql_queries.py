"""Queries that SQL expresses equal DuckDB's rows."""

import duckdb
import pytest

from moodcast.llm import queries as Q
from moodcast.llm.oracle import ORACLE
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()), key=str)
    assert want and sorted(map(tuple, df.collect()), key=str) == want
