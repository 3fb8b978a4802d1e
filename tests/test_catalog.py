"""Every registered query outside the optional subpackage against its SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

from rulelake import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}{'/*.parquet' if os.path.isdir(f'{DATA}/{f}') else ''}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert rows
        return
    found = db.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
