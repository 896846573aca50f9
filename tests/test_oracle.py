"""Every registered query against its DuckDB SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from cohortflow.plans.queries import QUERIES as LIBRARY_QUERIES  # noqa: E402
from fixture_paths import SF_MID, SF_SMALL  # noqa: E402
from oracle_check import TABLES, _rows  # noqa: E402

QUERIES = dict(LIBRARY_QUERIES)
DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
              "TIMESTAMP": "timestamp_ntz"}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


# the smallest tables leave a test of this report to simulation
MIDDLE = {"table1_customers_two_group"}


@pytest.fixture(scope="module")
def cons():
    out = {}
    for d in (SF_SMALL, SF_MID):
        out[d] = duckdb.connect()
        for t in TABLES:
            p = f"{d}/{t}.parquet"
            if os.path.exists(p):
                out[d].sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return out


def test_every_query_has_an_oracle_or_is_random():
    no_oracle = set(QUERIES) - set(ORACLES)
    # p-values from random simulation
    assert no_oracle <= {"chisq_monte_carlo_nation"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, cons, name):
    folder = SF_MID if name in MIDDLE else SF_SMALL
    con, sdf = cons[folder], QUERIES[name](spark, folder)
    srows = [r.asDict() for r in sdf.collect()]
    rel = con.sql(ORACLES[name])
    orows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(rel.columns)
    duck = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: f.dataType.simpleString() for f in sdf.schema.fields} == duck
    cols = sorted(sdf.columns)
    assert _rows(srows, cols) == _rows(orows, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["time", "n_risk", "n_event"]
