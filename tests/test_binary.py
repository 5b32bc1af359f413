import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import binary
from siltstone.operators import parity, store


def test_identity_of_nothing():
    assert binary.shake256(b"").hex() == "46b9dd2b0ba88d13233b3feb743eeb243fcd52ea62b81b82b50c27646ed5762f"


@pytest.mark.parametrize("n", [0, 1, -1, 63, 64, -64, -65, 8191, 8192, 2**31, -(2**31), 2**62, 2**63 - 1, -(2**63)])
def test_varints(n):
    data = binary.varint(n)
    assert binary.read_varint(b"xx" + data + b"yy", 2) == (n, 2 + len(data))


def test_varint_lengths(spark):
    values = [0, 63, 64, 8191, 8192, 2**20 - 1, 2**20, 2**40, 2**55, 2**62 - 1, 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", binary.varint_length(F.col("n")).alias("l")).collect()
    assert all(r.l == len(binary.varint(r.n)) for r in got)
    for bad in (b"", b"\xff", b"\x80" * 11):
        with pytest.raises(ValueError):
            binary.read_varint(bad, 0)


def test_checksum():
    assert binary.crc32c(b"123456789") == 0xE3069283 and binary.crc32c(b"") == 0


def test_compression(spark):
    values = [b"", b"a", b"a" * 1000, os.urandom(500), None]
    df = spark.createDataFrame([(k, v and bytearray(v) if v is not None else None) for k, v in enumerate(values)], "k int, d binary")
    got = {r.k: (r.p, r.u, r.h) for r in df.select("k", binary.compress("d").alias("p"), binary.hash_bytes("d").alias("h"), "d").withColumn("u", binary.decompress("p")).collect()}
    for k, v in enumerate(values):
        if v is None:
            assert got[k] == (None, None, None)
            continue
        p = bytes(got[k][0])
        assert bytes(got[k][1]) == v and bytes(got[k][2]) == binary.shake256(v) and p[:1] == (b"\1" if k == 2 else b"\0")
        assert p[:1] == b"\0" or zlib.decompress(p[1:], 31) == v
    with pytest.raises(ValueError):
        binary.unpack_gzip(b"\7x")


def test_encryption(spark):
    """Equal data under one key is different each time, and opens again."""
    key = bytearray(os.urandom(32))
    df = spark.createDataFrame([(bytearray(b"secret"), key)] * 2, "d binary, k binary")
    a, b = df.select(binary.encrypt(F.col("d"), F.col("k")).alias("x"), "k").withColumn("c", binary.decrypt(F.col("x"), F.col("k"))).collect()
    assert bytes(a.c) == bytes(b.c) == b"secret" and a.x != b.x


@pytest.mark.parametrize(("n", "shown"), [(0, "0 B"), (1024, "1024 B"), (1025, "1.00 kiB"), (1152, "1.12 kiB"), (1 << 20, "1024.00 kiB"), ((1 << 20) + 1, "1.00 MiB"), (1 << 30, "1.00 GiB"), (1 << 40, "1.00 TiB"), (-5, "-5 B")])
def test_sizes_for_people(spark, n, shown):
    assert spark.range(1).select(binary.format_bytes(F.lit(n).cast("long")).alias("s")).first().s == shown


def test_packs(spark):
    rng = np.random.default_rng(1)
    chunks = [rng.integers(0, 256, int(n), np.uint8).tobytes() for n in rng.integers(0, 3000, 200)]
    content, index = b"", b""
    for c in chunks:
        record = store.blob_record(c)
        index += store.index_record(binary.shake256(c), len(content), len(record))
        content += record
    assert [d for _, d in store.decode_pack(content)] == chunks
    for (h, o, n), c in zip(store.decode_index(index), chunks, strict=True):
        assert h == binary.shake256(c) and content[o : o + n] == store.blob_record(c)
    for bad in (b"nope", content[:-1], store.BLOB_MAGIC + b"\xff"):
        with pytest.raises(ValueError):
            list(store.decode_pack(bad))
    with pytest.raises(ValueError):
        list(store.decode_index(index[:-40]))
    df = spark.createDataFrame([(1, k, bytearray(c)) for k, c in enumerate(chunks)], "pack int, seq int, data binary")
    (f,) = store.encode_packs(df).collect()
    assert (bytes(f.content), bytes(f["index"])) == (content, index)


def test_merkle():
    leaves = [binary.shake256(bytes([k, j])) for k in range(40) for j in range(10)]
    levels = store.merkle_tree(leaves, 8)
    assert len(levels[-1]) == 1 and 1 < len(levels) <= 10
    assert store.merkle_expand(b"".join(n for _, n in levels[0])) == leaves
    for below, above in zip(levels, levels[1:]):
        assert store.merkle_expand(b"".join(n for _, n in above)) == [h for h, _ in below]
    assert store.merkle_tree(leaves[:1], 8) == []
    with pytest.raises(ValueError):
        store.merkle_tree([], 8)
    with pytest.raises(ValueError):
        store.merkle_expand(b"x" * 33)


@pytest.mark.parametrize("seed", range(8))
def test_parity_repairs_up_to_its_shards(seed):
    rng = np.random.default_rng(seed)
    n_data, n_parity = int(rng.integers(1, 25)), int(rng.integers(1, 9))
    segment = rng.integers(0, 256, int(rng.integers(1, 5000)), np.uint8).tobytes()
    hashes, extra = parity.encode_segment(segment, n_data, n_parity)
    size = -(-len(segment) // n_data)
    hurt, lost = bytearray(segment.ljust(size * n_data, b"\0")), list(extra)
    for k in rng.choice(n_data + n_parity, n_parity, replace=False).tolist():
        if k < n_data:
            hurt[k * size] ^= 255
        else:
            lost[k - n_data] = bytes([extra[k - n_data][0] ^ 1]) + extra[k - n_data][1:]
    # bytes beyond the end of the file can't be hurt
    data, back, bad = parity.restore_segment(bytes(hurt[: len(segment)]), hashes, lost, n_data)
    assert data == segment and back == extra and len(bad) <= n_parity
    if n_data > 1 and size * n_data == len(segment):
        for k in range(min(n_data, n_parity + 1)):
            hurt[k * size] = segment[k * size] ^ 7
        if n_data > n_parity:
            with pytest.raises(ValueError):
                parity.restore_segment(bytes(hurt), hashes, extra, n_data)


def test_parity_frames(spark):
    rng = np.random.default_rng(9)
    files = {f"f{k}": rng.integers(0, 256, int(n), np.uint8).tobytes() for k, n in enumerate([0, 1, 100, 5000, 6400])}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file string, content binary")
    kw = {"n_data": 5, "hash_rate": 256}
    protected = parity.encode(df, n_parity=2, **kw)
    assert parity.check(df, protected, **kw).count() == 0
    hurt = df.withColumn("content", F.when(F.col("file") == "f3", F.concat(F.expr("substring(content, 1, 700)"), F.lit(b"zz"), F.expr("substring(content, 703)"))).otherwise(F.col("content")))
    found = parity.check(hurt, protected, **kw).collect()
    assert {(r.file, r.kind) for r in found} == {("f3", "data")} and parity.corrupt_shards(parity.check(hurt, protected, **kw)).count() == 1
    back = parity.restore(hurt, protected, **kw).collect()
    for name, v in files.items():
        assert b"".join(bytes(r.data) for r in sorted((r for r in back if r.file == name), key=lambda r: r.seg)) == v
    short = df.where("file <> 'f4'").unionByName(spark.createDataFrame([("f9", bytearray(b"x"))], df.schema))
    assert {(r.file, r.kind) for r in parity.check(short, protected, **kw).collect()} == {("f4", "extra"), ("f9", "unprotected")}
    sizes = spark.createDataFrame([(k, len(v)) for k, v in files.items()], "file string, size long")
    assert {(r.file, r.seg, r.seg_bytes) for r in parity.layout(sizes, "file", "size", **kw).collect()} == {(r.file, r.seg, len(r.data)) for r in parity.segments(df, **kw).collect()}
    assert hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        parity.generator(0, 3)
