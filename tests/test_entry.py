"""Every query of the base engine equals its DuckDB statement on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return own


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    answer = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in answer.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in answer.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
