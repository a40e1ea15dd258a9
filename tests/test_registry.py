"""Every query with an oracle against DuckDB on the smallest tables; the others by their rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from strataflow.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= (0 if name == "lineament_extract" else 1)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["radius", "n", "auc"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
