"""Every catalogued query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from folioforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([fix(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        assert got
        return
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, out.fetchall())
    assert got == want
