"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallyloom.plans import oracles
from tallyloom.plans import queries as core


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.7g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_sql(spark, db, folder, name):
    df = core.QUERIES[name](spark, folder)
    got = rows(df.columns, df.collect())
    r = db.execute(oracles.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(oracles.SQL)))
def test_runs_without_sql(spark, folder, name):
    assert core.QUERIES[name](spark, folder).columns
