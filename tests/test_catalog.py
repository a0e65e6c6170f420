import duckdb
import pytest

from rooftide.operators.components import components
from rooftide.plans import catalog
from rooftide.plans.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle()))
def test_same_rows_in_both_engines(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = db.execute(catalog.oracle()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(repr(None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r)
    assert sorted(key(r) for r in got.select(*names).collect()) == sorted(key(r) for r in want.fetchall())


def test_components_of_chains_stars_and_odd_rows(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
