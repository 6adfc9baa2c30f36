"""Every registered query with a SQL twin gives the twin's rows; the others give rows."""

import math
import os

import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple("null" if x is None or x != x else f"{float(x):.4f}" if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out)


def close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-4)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for p, q in zip(a, b) for x, y in zip(p, q))
