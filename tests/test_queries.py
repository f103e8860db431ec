"""Every registered query with SQL against that SQL, on the smallest tables."""

import os

import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert mine == sorted(tuple(str(row[order.index(c)]) for c in columns) for row in result.fetchall())


def test_registry_is_whole():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) >= 60
