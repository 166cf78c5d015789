"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lyrebird.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r) for r in df.select(*expected.columns).collect()), key=key)
    wanted = sorted(expected.fetchall(), key=key)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a == b
