import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import queries, rules
from tests.llm.test_pii import plain
from tests.llm.test_simhash import joined, shingles, similar_pairs

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives on the test tables."""
    docs, out = queries.read(spark, SF01, "documents").cache(), []
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF01).cache()
        out.append((name, docs, got))
        docs = got
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality_rules", "quality_classifier", "near_dedup", "personal_data", "packed"]
    assert all(got.columns == docs.columns for _, docs, got in stages[:-1])


def test_rules_drop_what_they_reject(spark, stages):
    _, docs, got = stages[0]
    verdicts = {r.doc_id: r.kept for r in rules.judge(rules.statistics(docs)).collect()}
    before, after = texts(docs), texts(got)
    assert after == {i: t for i, t in before.items() if verdicts[i]} and 0 < len(after) < len(before)


def test_classifier_keeps_clean_and_drops_junk(spark, stages):
    labels = {r.doc_id: r.quality for r in queries.read(spark, SF01, "labels").collect()}
    _, docs, got = stages[1]
    before, after = texts(docs), texts(got)
    clean = [i in after for i in before if labels.get(i) == 1]
    assert np.mean(clean) > 0.98 and after.items() <= before.items()
    raw = queries.read(spark, SF01, "documents")
    kept = texts(corpus_pipeline.quality_classifier(spark, raw, SF01))
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.2


def test_one_document_of_each_class_stays(stages):
    _, docs, got = stages[2]
    before, after = texts(docs), texts(got)
    ids = sorted(before)
    pairs = similar_pairs([shingles(before[i]) for i in ids])
    label = joined(len(ids), pairs)
    first = {ids[k]: ids[label[k]] for k in range(len(ids))}
    # none goes without a similar one that stays, and hardly any similar one stays
    assert after.items() <= before.items() and set(first.values()) <= after.keys()
    assert len(after) - len(set(first.values())) <= 0.03 * (len(before) - len(set(first.values())))


def test_personal_data_goes(stages):
    _, docs, got = stages[3]
    before, after = texts(docs), {r.doc_id: r for r in got.collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not plain(after[i].text) and after[i].n_chars == len(after[i].text)
        if not plain(t) and after[i].text != t:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[i].text)


def test_all_documents_are_packed(stages):
    _, docs, got = stages[4]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(texts(docs)) and max(r.offset + r.length for r in rows) <= 4096
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_run_equals_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF01).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(stages[-1][2].select("doc_id", "piece", "start", "length", "ids_crc32").collect())


LONG = " ".join(f"Rivers{k} run{k} past hills{k} to the seas{k}." for k in range(40))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    """Nulls in any column, empty and long texts, copies, a repeated row, clashing extra columns; and no rows at all."""
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (None, LONG, "en", None, 9, 1, "x"), (4, LONG, None, "s", 9, 1, "x"), (4, LONG, None, "s", 9, 1, "x"), (5, LONG + " a@b.c", "en", "s", 9, 1, None), (6, "w " * 30_000, "en", "s", 9, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, kept string")
    name, f = corpus_pipeline.STAGES[k]
    got = f(spark, docs, "/root/testdata/sf0.001").collect()
    assert f(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    ids = sorted(r.doc_id or 0 for r in got)
    if name == "quality_rules":
        assert ids == [0, 4, 4, 5]
    elif name == "quality_classifier":
        assert set(ids) >= {0, 4, 5}
    elif name == "near_dedup":
        assert ids == [0, 1, 4, 6]
    elif name == "personal_data":
        assert ids == [0, 1, 2, 4, 4, 5, 6] and [r.text for r in got if r.doc_id == 5] == [LONG + " [EMAIL]"]
        assert [r.text for r in got if r.doc_id == 1] == [None]
    else:
        assert set(ids) == {0, 1, 2, 4, 5, 6} and sum(r.piece == 0 for r in got) == 7
