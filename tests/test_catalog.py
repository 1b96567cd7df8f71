"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os
from decimal import Decimal

import pytest

from siteweave.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(float(v), 9) + 0.0 if isinstance(v, (float, Decimal)) else None if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows), key=str)
    res = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in res.fetchall()), key=str)
