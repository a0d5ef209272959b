"""Each query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from inkgraph.plans import catalog, diagrams  # noqa: F401  diagrams adds its queries to the catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    cur = db.execute(catalog.ORACLE_SQL[name])
    want, names = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
