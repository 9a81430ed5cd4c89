import glob
import math
import os

import duckdb
import pytest

from groupwise.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple("NULL" if x is None else 0.0 if isinstance(x, float) and x == 0 else float(x) if isinstance(x, float) else x for x in r) for r in rows), key=str)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = plain([[r[k] for k in order] for r in cursor.fetchall()])
    mine = plain(df.select(*columns).collect())
    assert len(mine) == len(theirs) > 0
    for a, b in zip(mine, theirs, strict=True):
        assert all(map(close, a, b)), (a, b)
