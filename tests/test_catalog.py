"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cellspan.plans import catalog

SF = os.environ.get("CELLSPAN_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "labels")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ALL) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    """Their operators are held against plain Python in test_models, test_greedy, test_crops, test_images, test_fields, test_tails, test_sampling and test_sections."""
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    want = oracle.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(r) for r in want.select(*columns).fetchall()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) for v in x) else all(p == (pytest.approx(q, abs=2e-6) if isinstance(q, float) else q) for p, q in zip(x, y, strict=True))
