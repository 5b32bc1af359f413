import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, queries
from siltstone.llm.packing import Capacity, Places, plan


def test_query(spark, sf):
    """Ids, cuts and checksums as the library gives them; sequences without gaps, as few as can be."""
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    rows = queries.QUERIES["op8_packing"](spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    docs = queries.read(spark, sf, "documents").collect()
    assert by_doc.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array([*lib.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, a, min(4096, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 4096))]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in got]
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 4096) + 1


def check_places(rows, size):
    at = {}
    for s, o, n in sorted(rows):
        assert o == at.get(s, 0)
        at[s] = o + n
        assert at[s] <= size
    return at


def best_fit_one_by_one(lengths, c):
    """The plain form: every document by itself, the bin of best score."""
    whole = np.array([c.tokens, c.documents, c.cost], float)
    left = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        fit = [k for k, x in enumerate(left) if (x >= need).all()]
        if fit:
            score = [-((((left[k] - need) / whole) ** 2) @ np.array(c.weights)) if c.by == "norm" else (left[k] / whole * (need / whole)) @ np.array(c.weights) for k in fit]
            left[fit[int(np.argmax(score))]] -= need
        else:
            left.append(whole - need)
    return len(left)


@pytest.mark.parametrize("c", [Capacity(100), Capacity(100, 5), Capacity(100, 20, 3000), Capacity(100, 6, 4000, (1, 0.5, 0.5), "dot"), Capacity(100, 30, 10**6, (1, 0.2, 0.1))])
def test_every_constraint(c):
    rng = np.random.default_rng(2)
    lengths = [int(min(n, 54)) for n in rng.geometric(0.05, 3000)]
    counts = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True))}
    bins = plan(counts, c)
    held = {}
    for many, holds in bins:
        assert many > 0
        assert sum(n * k for n, k in holds) <= c.tokens and sum(k for _, k in holds) <= c.documents and sum(n * n * k for n, k in holds) <= c.cost
        for n, k in holds:
            held[n] = held.get(n, 0) + many * k
    assert held == counts
    assert sum(m for m, _ in bins) <= 1.05 * best_fit_one_by_one(lengths, c) + 1
    places, rows = Places.of(bins), []
    for n, k in counts.items():
        s, o = places.find(np.full(k, n), np.arange(k))
        rows += zip(s.tolist(), o.tolist(), [n] * k)
    assert len(check_places(rows, c.tokens)) == sum(m for m, _ in bins)


def test_tightened_capacities_bind_without_a_sequence_more():
    rng = np.random.default_rng(3)
    counts = {int(n): int(k) for n, k in zip(*np.unique(np.minimum(rng.geometric(0.02, 5000), 60), return_counts=True))}
    loose = Capacity(100, 100, 100**2)
    close, need = packing.tightened(counts, loose), sum(m for m, _ in plan(counts, loose))
    assert close.documents < loose.documents and sum(m for m, _ in plan(counts, close)) <= need
    assert all(sum(k for _, k in h) <= close.documents and sum(n * n * k for n, k in h) <= close.cost for _, h in plan(counts, close))
    for name in ("documents", "cost"):
        half = packing.replace(close, **{name: getattr(close, name) // 2})
        assert half.cost < max(counts) ** 2 or sum(m for m, _ in plan(counts, half)) > need
    assert packing.tightened({}, loose) == loose


def test_plan_is_bounded_by_the_lengths_not_the_documents():
    bins = plan({n: 10**9 + n for n in range(1, 1025)}, Capacity(1024, 1024, 1024**2))
    assert len(bins) <= 3 * 1024 and sum(m * sum(n * k for n, k in h) for m, h in bins) == sum(n * (10**9 + n) for n in range(1, 1025))
    with pytest.raises(ValueError):
        plan({11: 1}, Capacity(10))


def test_frames(spark):
    """Null, zero and negative lengths, copies, clashing columns, hot lengths over partitions, no rows."""
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "case when id % 3 = 0 then 40 when id = 1 then null when id = 2 then 0 when id = 4 then -5 else id % 97 + 1 end as length", "'x' as offset", "1 as part")
    rows = packing.pack(df, Capacity(100, 100, 10**6)).collect()
    assert len(rows) == 5000 and sorted(r.id for r in rows if r.sequence_id is None) == [1, 2, 4]
    check_places([(r.sequence_id, r.offset, r.length) for r in rows if r.sequence_id is not None], 100)
    assert packing.pack(df.where("false")).count() == 0
    texts = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b " * 6000, 5), (3, "a b " * 6000, 5)], "doc_id long, text string, piece int")
    got = packing.pieces(texts, public_tokenizers.path("word_bpe_49k.json"), size=1000).collect()
    assert [(r.piece, r.length) for r in got if r.doc_id in (1, 2)] == [(0, 1), (0, 1)] and all(bytes(r.ids) == b"\x01\0\0\0" for r in got if r.doc_id < 3)
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * 12001 and sum(r.doc_id == 3 for r in got) == 26
