"""Every query against its SQL on the smallest tables; queries without SQL must run twice alike."""

from __future__ import annotations

import duckdb
import pytest

from voxlake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    return sorted(map(repr, map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_alike(spark, name):
    first, second = (queries.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    columns = sorted(first.columns)
    assert len(first) and rows_of(first, columns) == rows_of(second, columns)
