import duckdb
import numpy as np
import pytest

from siltstone.llm import queries, vectors
from tests.llm.test_vectors import clustered, frame


def same(got, con, sql):
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(theirs)
    order = [theirs.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(w[k] for k in order)) for w in want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    same(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name])


def test_links_equal_sql(spark, tmp_path):
    """The test vectors are far from one another: the same query and SQL over vectors that aren't."""
    x, labels = clustered(11, 400, [2] * 40 + [5] * 10 + [60], dim=24)
    x[7] = 0
    rows = frame(spark, x, np.where(np.arange(len(x)) % 97 == 0, 0, labels)).selectExpr("vec_id", "embedding", "if(vec_id = 70, null, label) as label")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = queries.QUERIES["op9_vectors"](spark, str(tmp_path)).cache()
    assert got.agg({"n_links": "sum"}).first()[0] > 1000 and vectors.Search().least_recall >= 0.95
    same(got, con, queries.ORACLES["op9_vectors"])
