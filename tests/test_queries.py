"""Every registered texture query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from texloom.plans import codec_queries as texture_queries

SF = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "orders"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    at = [names.index(n) for n in sorted(names)]
    return sorted(str(tuple(r[i] for i in at)) for r in found)


@pytest.mark.parametrize("name", sorted(texture_queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = texture_queries.QUERIES[name](spark, SF)
    want = duck.execute(texture_queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())

