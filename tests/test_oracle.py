"""Every registered query with SQL gives DuckDB's rows over the same tables."""

import glob

import duckdb
import pytest

from tesserae import registry

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, BASE)
    names = sorted(df.columns)
    got = plain(tuple(r[c] for c in names) for r in df.collect())
    r = duck.execute(registry.SQL[name])
    at = {d[0]: k for k, d in enumerate(r.description)}
    assert sorted(at) == names
    assert got == plain(tuple(x[at[c]] for c in names) for x in r.fetchall())
