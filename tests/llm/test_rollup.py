import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe, durable, queries, rollup


def test_query_against_a_direct_count(spark, sf):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    seen, want = set(), {}
    for r in sorted(queries.read(spark, sf, "documents").collect(), key=lambda r: r.doc_id):
        if r.text in seen:
            continue
        seen.add(r.text)
        text = "\n".join(dict.fromkeys(r.text.split("\n")))
        for name, n in (("words", len(text.encode().split())), ("word_bpe_49k", len(lib.encode(text, add_special_tokens=False).ids))):
            d, t = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = d + 1, t + n
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.QUERIES["op6_token_counts"](spark, sf).collect()}
    assert got == want


def deltas(spark, *rows):
    return spark.createDataFrame(rows, rollup.SCHEMA)


def test_batches_count_once(spark, tmp_path):
    ledger = rollup.Ledger(spark, str(tmp_path / "l"))
    assert ledger.totals().count() == 0 and ledger.batches() == []
    one = deltas(spark, ("s", "en", "t", 1, 10), ("s", "en", "t", 1, 5), (None, None, "t", 1, 7))
    assert ledger.commit("b1", one) and not ledger.commit("b1", one)
    assert ledger.commit("b2", deltas(spark, ("s", "en", "t", -1, -10), (None, None, "t", -1, -7)))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "t", 1, 5)]
    # a batch that crashed before its mark doesn't count, and can be committed again
    (tmp_path / "l" / "batch-b2" / "_SUCCESS").unlink()
    assert ledger.batches() == ["b1"] and sum(r.n_tokens for r in ledger.totals().collect()) == 22
    assert ledger.commit("b2", deltas(spark, ("s", "en", "t", -1, -10)))
    before = sorted(map(str, ledger.totals().collect()))
    ledger.compact()
    assert sorted(map(str, ledger.totals().collect())) == before and ledger.batches() == ["b1", "b2"]
    assert not ledger.commit("b1", one) and ledger.commit("b3", deltas(spark, ("x", "de", "t", 1, 1)))
    ledger.compact()
    assert sorted(map(str, ledger.totals().collect())) == sorted([*before, str(deltas(spark, ("x", "de", "t", 1, 1)).first())])
    with pytest.raises(ValueError):
        ledger.commit("../x", one)


def test_snapshot_without_its_list_is_not_valid(spark, tmp_path):
    ledger = rollup.Ledger(spark, str(tmp_path / "l"))
    ledger.commit("a", deltas(spark, ("s", "en", "t", 1, 3)))
    ledger.totals().write.parquet(str(tmp_path / "l" / "snapshot-000000000"))
    assert [r.n_tokens for r in ledger.totals().collect()] == [3]
    ledger.compact()
    assert [r.n_tokens for r in ledger.totals().collect()] == [3]


def test_frames(spark):
    """Nulls everywhere, copies, empty texts, clashing columns, no rows."""
    rows = [(1, "a b\na b", "en", "s", 0), (2, None, None, None, 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "a b\na b", "en", "z", 0), (None, "q", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    got = rollup.maintained(docs, durable.scratch(spark, "t"), {"words": None}).totals().collect()
    assert sorted((str(r.source), r.n_docs, r.n_tokens) for r in got) == [("None", 1, 0), ("s", 3, 3)]
    assert rollup.maintained(docs.where("false"), durable.scratch(spark, "t"), {"words": None}).totals().count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = rollup.count_tokens(docs, {"bytes": (bpe.ByteLevel, path), "words": None}).collect()
    assert {r.doc_id: r.tokens for r in counted}[1] == {"bytes": 5, "words": 4}
