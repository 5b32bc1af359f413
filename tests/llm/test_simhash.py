import time

import numpy as np
import pytest
import xxhash

from siltstone.llm import components, queries, simhash
from siltstone.llm.components import connected_components


def classes(rows, threshold=4):
    """Brute force: smallest id reachable, by comparing all pairs of fingerprints."""
    ids = [i for i, _ in rows]
    x = np.array([f for _, f in rows], np.uint64)
    label = dict(zip(ids, ids))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= threshold).tolist():
            a, b = find(k), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, i in enumerate(ids)} if label else {}


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint_matches_plain_form():
    for t in [None, "", " \n\t", "a", "A b\tC", "x y z w", "one two three four five ÄÖ É", "  a b", "la " * 5000, "é" * 10_000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op2_simhash"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in queries.read(spark, sf, "documents").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = classes(prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in prints)


def near_rows(seed, centres, each, flips):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64).tolist():
        for _ in range(each):
            x = c
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False).tolist():
                x ^= 1 << b
            out.append(x)
    return [(k * 3, x) for k, x in enumerate(out)]


def check_links(spark, rows, **kw):
    df = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in rows], "id long, fp long")
    found = connected_components(simhash.near_links(df.select("fp").distinct(), **kw))
    root = {r.node: r.component for r in found.collect()}
    groups, least = {}, {}
    for i, x in rows:
        s = x - 2**64 if x >= 2**63 else x
        groups[i] = root.get(s, s)
        least[groups[i]] = min(i, least.get(groups[i], i))
    assert {i: least[g] for i, g in groups.items()} == classes(rows)


def test_links_at_the_border(spark):
    """Pairs at 3, 4, 5 and 6 bits around random centres, single bits and whole clusters."""
    check_links(spark, near_rows(1, 150, 6, 4))
    check_links(spark, [(0, 0), (1, 0b1111), (2, 0b11111), (3, 0b1111 << 60), (4, 2**64 - 1), (5, (2**64 - 1) ^ 0b1111), (6, 0b111110000)])


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """One dense cluster far above the group size and the size of a numpy step."""
    check_links(spark, near_rows(2, 2, 1500, 3), group_rows=200)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    check_links(spark, near_rows(3, 3, 300, 3))


def test_forest_keeps_groups():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 250).astype(np.uint64), rng.integers(0, 300, 250).astype(np.uint64)
    x, y = simhash.forest(a, b)
    assert len(x) < 250 and len(set(x.tolist())) == len(x) and (x > y).all()


def test_edges_of_the_input(spark):
    """Nulls, blanks, copies, clashing columns, no rows."""
    rows = [(5, None, 1), (6, "", 2), (7, " \n", 3), (8, "a b c d e", 4), (9, "A B\tC d  e", 5), (None, "x", 6), (8, "other words stand here now", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def similar_pairs(sets, least=0.8):
    """Brute force over all pairs with a shingle in common."""
    holders, out = {}, set()
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > k}:
            if len(s & sets[j]) >= least * len(s | sets[j]) - 1e-9:
                out.add((k, j))
    return out


def joined(n, pairs):
    label = list(range(n))
    for _ in range(n):
        new = label[:]
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_jaccard_forest_equals_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.uint64) for _ in range(120)]
    for k in range(100):
        x = sets[k % 40].copy()
        sets.append(np.unique(np.where(rng.random(len(x)) < 0.1, rng.integers(100, 400, len(x)), x)).astype(np.uint64))
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= least * len(np.union1d(sets[i], sets[j])) - 1e-9}
        a, b = simhash.jaccard_forest(sets, least)
        got = list(zip(a.tolist(), b.tolist()))
        assert {(max(p), min(p)) for p in got} <= want and joined(len(sets), got) == joined(len(sets), want)


def test_jaccard_forest_of_many_sets_just_below_the_bound():
    """Sets of one family that mostly aren't similar enough: all true links, without going through all values of all pairs."""
    rng, n, size = np.random.default_rng(5), 3000, 178
    base, sets = rng.integers(0, 2**63, size, dtype=np.uint64), []
    for k in range(n):
        x = base.copy()
        at = rng.choice(size, 8 if k % 100 == 0 else 20, replace=False)
        x[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(x))
    held = np.stack([np.isin(base, x) for x in sets]).astype(np.float32)  # what is put in is in one set only
    common = held @ held.T
    of = np.array([len(x) for x in sets])
    want = list(zip(*(x.tolist() for x in np.nonzero(np.triu(common >= 0.8 * (of[:, None] + of[None, :] - common) - 1e-6, 1)))))
    began = time.process_time()
    a, b = simhash.jaccard_forest(sets, 0.8)
    took = time.process_time() - began
    got = list(zip(a.tolist(), b.tolist()))
    assert {(min(p), max(p)) for p in got} <= set(want) and len(want) > 20 and joined(n, got) == joined(n, want)
    assert took < 2.5  # 5 seconds and more if the values of all pairs are gone through


def copies(seed, originals, each, change):
    """Texts of 40 to 200 invented words, with copies of which some words are replaced."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(originals):
        words = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(40, 200))]
        out.append(" ".join(words))
        out += [" ".join(f"n{v}" if c < change * rng.random() else w for w, v, c in zip(words, rng.integers(0, 10**6, len(words)), rng.random(len(words)))) for _ in range(each)]
    return out


def check_similar(spark, texts, least):
    """No wrong link; of the links at least so many; the same classes but for what these lose."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    pairs = similar_pairs([shingles(t) for t in texts])
    want = joined(len(texts), pairs)
    assert all(want[got[k]] == want[k] for k in got)
    assert sum(got[a] == got[b] for a, b in pairs) >= least * len(pairs) > 0


def test_similar_texts_of_the_test_table(spark):
    texts = [r.text for r in queries.read(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    check_similar(spark, texts, 0.97)


def test_similar_texts_at_the_border(spark):
    check_similar(spark, copies(1, 150, 6, 0.05), 0.96)


def test_large_groups_of_similar_texts(spark, monkeypatch):
    """Groups far larger than an anchor's, a step's and a block's bounds."""
    monkeypatch.setattr(simhash, "WIDE_PAIRS", 2000)
    plain = simhash.wide_links, simhash.verified_links
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, wide: plain[0](nodes, wide, 60))
    monkeypatch.setattr(simhash, "verified_links", lambda members, similarity, width: plain[1](members, similarity, width, block_bytes=20_000))
    check_similar(spark, copies(2, 4, 250, 0.06), 0.97)


@pytest.mark.parametrize("most", [0, 10**6])
def test_survivors(spark, monkeypatch, most):
    """Nulls, blanks, copies, repeated ids, rows without an id, clashing columns, no rows."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, None, 1), (6, " ", 2), (8, "a b c", 4), (9, "A B\tC", 5), (None, "a b c", 6), (12, long, 1), (10, long + " x", 2), (11, long.replace("w30", "y"), 3), (13, "a b c", 1), (13, "a b c", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    assert sorted((r.doc_id or 0) for r in simhash.survivors(df).collect()) == [0, 5, 8, 10]
    assert simhash.survivors(df.where("false")).count() == 0 and simhash.survivors(df).columns == df.columns


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_components_of_chains_and_stars(spark, monkeypatch, broadcast):
    monkeypatch.setattr(components, "BROADCAST_ROWS", broadcast)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(3, 3), (None, 4), (1, 2), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in range(200, 400)} | {7: 7, 1: 1, 2: 1}
