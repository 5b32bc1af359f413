import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe, queries

FILES = {bpe.ByteLevel: "byte_bpe_50k.json", bpe.WordLevel: "word_bpe_49k.json"}


def library(kind):
    t = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(coder, texts):
    flat, sizes = coder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("kind", FILES)
def test_every_code_point(kind):
    coder, lib = bpe.load(kind, public_tokenizers.path(FILES[kind])), library(kind)
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}\n" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 64)]
    assert ids_of(coder, texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", FILES)
def test_random_and_odd_texts(kind, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 500)  # the table is emptied now and then
    coder, lib, rnd = bpe.load(kind, public_tokenizers.path(FILES[kind])), library(kind), random.Random(7)
    parts = ["a", "aa", "ing", " ", "  ", "the", "<|endoftext|>", "\n", "É", "é", "ß", "İ", "Σ", "1", "!!", " 's", "</w>", "̀", "日本", "\x1c", "\x85", "🙂"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 5000, " " * 3000, "", "ab" * 4000, "the" * 1000, "zq" * 30, "<|startoftext|>", "".join(rnd.choices("abeinrst", k=6000)), "é" * 700 + "." * 1500]
    assert ids_of(coder, texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(coder, [None, "a"])[0] == []


@pytest.mark.parametrize("kind", FILES)
def test_proposals_that_pass_are_exact(kind):
    """Words whose proposal is kept equal exact merging, and both outcomes occur."""
    coder, rnd = bpe.load(kind, public_tokenizers.path(FILES[kind])), random.Random(3)
    words = [bytes(rnd.choices(b"aeinrst hlo", k=rnd.randint(1, 14))) for _ in range(6000)]
    flat, starts, sizes, failed = coder.encode_words(words)
    assert 0 < failed < len(words)
    assert all(flat[s : s + n].tolist() == coder.merge(w) for w, s, n in zip(words, starts, sizes))
    long = [bytes(rnd.choices(b"aeinrst", k=200)) for _ in range(40)]
    assert all(coder._merge_long([*map(int, coder.base_mid[np.frombuffer(w[:-1], np.uint8)]), int(coder.base_end[w[-1]])]) == x for w, x in zip(long, [short_merge(coder, w) for w in long]))


def short_merge(coder, word):
    kept, bpe.SHORT = bpe.SHORT, 10**9
    try:
        return coder.merge(word)
    finally:
        bpe.SHORT = kept


def test_query(spark, sf):
    lib = library(bpe.ByteLevel)
    got = {r.doc_id: r for r in queries.QUERIES["op1_bpe"](spark, sf).collect()}
    for r in queries.read(spark, sf, "documents").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        q = got.pop(r.doc_id)
        assert q.n_tokens == len(ids)
        assert q.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert q.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def test_frames(spark):
    """Nulls, empty texts, copies, clashing columns, no rows; the round trip gives the text back."""
    path = public_tokenizers.path(FILES[bpe.ByteLevel])
    rows = [(1, None, "x"), (1, "", "y"), (2, "Hi there\n<|endoftext|> é", "z"), (2, "Hi there\n<|endoftext|> é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, path), path).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.text, r.decoded) for r in out] == [(1, None, ""), (1, "", ""), (2, rows[2][1], rows[2][1]), (2, rows[2][1], rows[2][1])]
    assert bpe.encode(df.where("false"), path).count() == 0
    odd = spark.createDataFrame([([72, -1, 10**6, 128],), (None,), ([None, 72],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, path).collect()] == [bytes(bpe.load(bpe.ByteLevel, path).token_bytes[72] + bpe.load(bpe.ByteLevel, path).token_bytes[128]).decode("utf-8", "replace"), "", "i"]
