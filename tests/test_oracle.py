"""Every registered query of the engine against its SQL in DuckDB."""

import datetime as dt
import glob
import math

import duckdb
import pytest

from tarnwell import feature_queries, queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {p.rsplit('/', 1)[1][:-8]} as from '{p}'")
    return con


def plain(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda k: cols[k])
    shown = lambda x: f"{x:.2f}" if isinstance(x, float) else repr(x)
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=lambda r: [shown(x) for x in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    got, expected = rows(df.columns, df.collect()), rows(cols, want.fetchall())
    assert len(got) == len(expected)
    for g, w in zip(got, expected, strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-4) if isinstance(a, float) and b is not None else a == b for a, b in zip(g, w, strict=True)), (g, w)
