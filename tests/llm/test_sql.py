"""Queries that DuckDB can answer too, on the smallest tables."""

import os

import duckdb
import pytest

from cohortflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    assert got.columns == [d[0] for d in cur.description]
    rows = cur.fetchall()
    assert rows and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [kinds[t] for _, t in got.dtypes] == [str(d[1]) for d in cur.description]
