"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.catalog import TABLES
from brindle.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.oracles))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([canon(x) for x in r]) for r in df.select(cols).collect())
    found = duck.execute(registry.oracles[name])
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == cols
    assert got == sorted(repr([canon(r[at[c]]) for c in cols]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
