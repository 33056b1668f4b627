"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from saldo.plans.figures import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    key = lambda r: tuple((str(type(x)), round(x, 2) if isinstance(x, float) else x) for x in r)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(same(float(p) if hasattr(p, "as_tuple") else p, float(q) if hasattr(q, "as_tuple") else q) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
