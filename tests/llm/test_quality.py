import zlib

import numpy as np

from siltstone.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality"](spark, sf).collect()}
    docs = queries.read(spark, sf, "documents").collect()
    assert got.keys() == {r.doc_id for r in docs} and len(docs) == len(got)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    marks = [(got[r.doc_id].score, r.quality) for r in queries.read(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    good, bad = (np.array([s for s, q in marks if q == k]) for k in (1, 0))
    assert np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2 > 0.97
    assert np.mean(good >= 0.7) > 0.97 and np.mean(bad < 0.7) > 0.8


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    rows = (rng.random((80, quality.WIDTH)) * (rng.random((80, quality.WIDTH)) < 0.05)).astype(np.float32)
    labels = (rng.random(80) < 0.6).astype(np.float32)
    m = quality.Model(rows, labels, 20, 7, 4.0)
    other = (rng.random((30, quality.WIDTH)) * (rng.random((30, quality.WIDTH)) < 0.05)).astype(np.float32)
    for x, s in zip(other, m.score(other)):
        v = (x * m.idf).astype(np.float64) @ m.axes.astype(np.float64)
        sims = [(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), k) for k, u in enumerate(m.vectors.astype(np.float64))]
        best = sorted(sims, reverse=True)[:7]
        w = [max(c, 0) ** 4 for c, _ in best]
        assert abs(s - sum(a * labels[k] for a, (_, k) in zip(w, best)) / sum(w)) < 1e-3


def test_shapes():
    assert [quality.shape(w) for w in ("Hello,", "ABC!!", "x%%%", "12.5", "", "ß-É")] == ["Aa,", "A!", "a%", "0.0", "", "a-A"]


def test_shapes_are_of_whole_words():
    assert quality.shape("x" * 64 + "1!") == "a0!"
    same = "語" * 100
    a, b = quality.Features().rows([same + "1", same + "!"])
    shapes = slice(quality.WORDS, quality.WORDS + quality.SHAPES)
    assert not np.array_equal(a[shapes], b[shapes])


def test_held_out_rows_are_not_learned(spark, sf):
    """The labels of held-out rows change nothing."""
    from pyspark.sql import functions as F

    docs, labels = (queries.read(spark, sf, t) for t in ("documents", "labels"))
    a = quality.fit(docs, labels)
    b = quality.fit(docs, labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels) and len(a.labels)


def test_frames(spark):
    """Nulls, empty and long texts, conflicting and missing labels, clashing columns, no rows."""
    rows = [(1, "good words here to read", 9), (2, "JUNK!! JUNK!!", 9), (3, None, 9), (4, "", 9), (5, "word " * 60_000, 9), (None, "x", 9), (1, "good words here to read", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, None), (None, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in quality.scores(docs, model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    assert {s for i, s in got if i in (3, 4)} == {model.base}
    empty = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.scores(docs, empty).collect()} == {0.5}
    assert quality.scores(docs.where("false"), model).count() == 0
