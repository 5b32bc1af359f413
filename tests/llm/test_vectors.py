import numpy as np

from siltstone.llm import queries, vectors
from siltstone.llm.vectors import Search


def brute(ids, x, labels, threshold=0.93):
    """Links by all pairs: how many each row has, and the smallest id it reaches."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = [], []
    for k in range(0, len(u), 1024):
        i, j = np.nonzero((u[k : k + 1024] @ u.T >= threshold) & (labels[k : k + 1024, None] == labels[None, :]))
        a.append(i[i + k != j] + k)
        b.append(j[i + k != j])
    a, b = np.concatenate(a), np.concatenate(b)
    least, changed = np.array(ids), True
    while changed:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        changed, least = not np.array_equal(new, least), new
    return np.bincount(a, minlength=len(u)), least


def clustered(seed, n, groups, dim=32, noise=0.12):
    """Isotropic vectors, and groups of copies around some of them."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((n, dim))]
    for g in groups:
        x.append(rng.standard_normal(dim) + noise * rng.standard_normal((g, dim)))
    x = np.concatenate(x)
    labels = rng.integers(0, 3, len(x))
    at = n
    for g in groups:
        labels[at : at + g] = labels[at]
        at += g
    order = rng.permutation(len(x))
    return x[order].astype(np.float32), labels[order]


def frame(spark, x, labels):
    return spark.createDataFrame([(int(k * 7), [float(v) for v in r], int(c)) for k, (r, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int")


def recall(spark, x, labels, s):
    got = sorted(vectors.near_duplicates(frame(spark, x, labels), s=s).collect(), key=lambda r: r.vec_id)
    n, least = brute([k * 7 for k in range(len(x))], x.astype(np.float64), labels)
    links = np.array([r.n_links for r in got])
    assert (links <= n).all() and links.sum() % 2 == 0 and all(r.kept == (r.vec_id == r.component_id) for r in got)
    return links.sum() / max(1, n.sum()), np.mean([r.component_id == c for r, c in zip(got, least)])


def test_recall_against_all_pairs(spark):
    x, labels = clustered(1, 1500, [2] * 60 + [3] * 30 + [40, 250])
    links, same = recall(spark, x, labels, Search())
    assert links > 0.97 and same > 0.99


def test_recall_over_many_small_shards(spark):
    """Many divisions, a second level of them, and a group far larger than a shard."""
    x, labels = clustered(2, 1500, [2] * 60 + [30, 400])
    links, same = recall(spark, x, labels, Search(shard_rows=20, fanout=12, centroid_bytes=40 * 64 * 4))
    assert links > 0.9 and same > 0.97


def test_dense_group_larger_than_its_shards(spark):
    """Near copies that are many times a divided shard: every link of theirs counts."""
    x, labels = clustered(5, 1500, [1800], noise=0.1)
    links, same = recall(spark, x, labels * 0, Search(shard_rows=64, block_rows=300))
    assert links > 0.99 and same > 0.99


def test_many_vectors_with_a_poor_search(spark):
    """24,000 vectors, most of them in groups, and a search that finds too little at first: it is widened, and links stay symmetric."""
    x, labels = clustered(7, 4000, [20] * 500 + [4] * 2000 + [2000], dim=16)
    links, same = recall(spark, x, labels, Search(shard_rows=64, overlap=1, beam=2, degree=3, pool=4, medoids=1))
    assert len(x) == 24_000 and links > 0.93 and same > 0.98


def test_failed_audits_end_in_all_pairs(spark):
    x, labels = clustered(6, 300, [2] * 20 + [90])
    assert recall(spark, x, labels, Search(shard_rows=40, least_recall=1.01, block_rows=50)) == (1.0, 1.0)


def test_search_finds_what_the_graph_holds():
    x, _ = clustered(3, 300, [2] * 30 + [90])
    u = vectors.unit(x.astype(np.float64)).astype(np.float32)
    lists = vectors.adjacency(u, Search())
    assert max(map(len, lists)) <= Search().degree and all(k not in v for k, v in enumerate(lists))
    src, to = np.repeat(np.arange(len(u)), [len(v) for v in lists]), np.concatenate(lists)
    src, to = np.concatenate([src, to]), np.concatenate([to, src])
    order = np.argsort(src, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(u)))])
    q, v = map(np.concatenate, zip(*vectors.search(u, first, to[order], np.arange(len(u)), 0.93, Search())))
    true = set(zip(*np.nonzero(u @ u.T >= 0.93)))
    assert len(true & set(zip(q.tolist(), v.tolist()))) / len(true) > 0.99


def test_audit_tells_the_recall(spark):
    x, labels = clustered(4, 200, [20])
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(f"{c}|32", k, 1, bytearray(np.asarray(r, "<f8").tobytes())) for k, (r, c) in enumerate(zip(x, labels))], "cell string, node long, weight long, vector binary")
    n, _ = brute(list(range(len(x))), x.astype(np.float64), labels)
    full = spark.createDataFrame([(k, int(v), None) for k, v in enumerate(n)], "a long, n long, b long")
    assert vectors.audit(nodes, full, 0.93, 1000, "<f8") == (1.0, int(n.sum()))
    assert abs(vectors.audit(nodes, full.withColumn("n", F.col("n") - F.when(F.col("n") > 0, F.col("n") / 2).otherwise(0).cast("long")), 0.93, 1000, "<f8")[0] - 0.5) < 0.1


def test_test_tables(spark, sf):
    e = queries.read(spark, sf, "embeddings").orderBy("vec_id").collect()
    n, least = brute([r.vec_id for r in e], np.array([r.embedding for r in e], np.float64), np.array([r.label for r in e]))
    got = sorted(queries.QUERIES["op9_vectors"](spark, sf).collect(), key=lambda r: r.vec_id)
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(r.vec_id, int(a), int(b)) for r, a, b in zip(e, n, least)]


def test_frames(spark):
    """Nulls, zero, empty and non-finite vectors, huge values, lengths that differ, copies, repeated ids, no rows."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, nan], 1), (9, [inf, 1.0], 1)]
    rows += [(10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1.0], 1), (13, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (14, [-0.0, 1.0], 3), (15, [0.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component_id", df_lit())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    want = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(1, 4, 1, True), (2, 4, 1, False), (12, 4, 1, False), (13, 4, 1, False), (13, 4, 1, False), (14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted(want)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("x")
