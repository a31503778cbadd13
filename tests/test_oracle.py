"""Every registered query with SQL agrees with DuckDB on the smallest tables (the training-data ones have own tests)."""

import math

import duckdb
import pytest

from weft import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def order(row):
    """Exact values first, then floats: engines sum in different orders, so floats are compared with a tolerance."""
    return [str(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"mv_manifest"}))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).columns
