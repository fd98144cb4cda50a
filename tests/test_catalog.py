import os

import pytest

import __spark_entry__ as entry
from strandwise.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings datasets reads km_abundance km_known read_match read_match_bound subject_areas subject_labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables aren't here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def rows_of(columns, rows):
    clean = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(clean, v)) if isinstance(v, (list, tuple)) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_those_of_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = c.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
