import duckdb
import pytest

import __spark_entry__ as entry
from pairforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = tables.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(x, str) for x in a) else a == b


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["k", "n", "radius", "width"]
    assert got.count() > 0
