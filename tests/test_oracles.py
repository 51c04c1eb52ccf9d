"""Every core query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from curvestat.catalog import CORE
from curvestat.plans import load_all

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.builders))
def test_query(spark, duck, name):
    df = CORE.builders[name](spark, DIR)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in CORE.oracles:
        assert rows
        return
    rel = duck.sql(CORE.oracles[name])
    assert sorted(rel.columns) == columns
    other = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    plain = lambda r: tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r)
    key = lambda r: tuple(map(str, r))
    left, right = sorted(map(plain, rows), key=key), sorted(map(plain, other), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6) if all(isinstance(v, float | int) and not isinstance(v, bool) for v in a) else a == b
