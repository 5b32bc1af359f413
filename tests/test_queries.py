import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows, columns = got.collect(), got.columns
    cursor = duck.execute(registry.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(theirs)
    order = [theirs.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str(tuple(w[k] for k in order)) for w in want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).collect()[0].chunks > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_known_totals(spark):
    """Sums that were found by other means at the next scale."""
    r = registry.QUERIES["chunk_dedup_report"](spark, "/root/testdata/sf0.01").first()
    assert (r.chunks, r.distinct_chunks, r.bytes, r.stored_bytes) == (2278, 2124, 2472458, 2308358)
