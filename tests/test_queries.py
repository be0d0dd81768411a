"""Every query against its SQL in another engine."""

from __future__ import annotations

import duckdb
import pytest

from tessera.plans.catalog import ORACLE_SQL, QUERIES
from tessera.sources.adapters import TABLES
from tests.compare import normal_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal_rows(got.columns, map(tuple, got.collect())) == normal_rows(names, want.fetchall())
