import numpy as np
import pytest

from siltstone.operators import chunking


def literal(data, bits):
    """Byte at a time, as the format is defined: cut lengths."""
    out, at = [], 0
    while at < len(data):
        s1, s2, window, n = 64 * 31, 64 * 63 * 31, [0] * 64, 0
        for b in data[at:]:
            drop = window[n % 64]
            window[n % 64] = b
            s1 = (s1 + b - drop) & 0xFFFFFFFF
            s2 = (s2 + s1 - 64 * ((drop + 31) % 256)) & 0xFFFFFFFF
            n += 1
            if n >= 512 and ((s1 << 16) | (s2 & 0xFFFF)) & ((1 << bits) - 1) == (1 << bits) - 1:
                break
        out.append(n)
        at += n
    return out


def golden_stream():
    x, out = 1, bytearray()
    for _ in range(200_000):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
        out.append((x >> 16) & 255)
    return bytes(out)


def lengths(data, bits):
    ends = chunking.cuts(data, bits)
    return np.diff(np.concatenate([[0], ends])).tolist()


@pytest.mark.parametrize(
    ("bits", "n", "first", "longest"),
    [
        (8, 267, [571, 578, 530, 877, 711, 577], 2187), (10, 133, [571, 578, 546, 861, 783, 659], 5361), (12, 53, [653, 1903, 1288, 3769, 4459, 768], 13788),
        (14, 12, [7613, 41640, 45196, 20060, 3723, 5102], 45196), (15, 6, [49253, 99321, 7066, 11963, 5845, 26552], 99321), (16, 3, [148574, 7066, 44360], 148574), (18, 1, [200000], 200000),
    ],
)
def test_golden_vectors(bits, n, first, longest):
    got = lengths(golden_stream(), bits)
    assert (len(got), got[:6], max(got), sum(got)) == (n, first, longest, 200_000)


@pytest.mark.parametrize("bits", [8, 10, 13, 14, 15, 16, 17, 18])
def test_closed_form_equals_the_definition(bits):
    rng = np.random.default_rng(bits)
    for data in (rng.integers(0, 256, 40_000, np.uint8).tobytes(), rng.integers(200, 256, 30_000, np.uint8).tobytes(), b"", b"x", b"ab" * 700, bytes(511), bytes(513), rng.integers(0, 256, 700, np.uint8).tobytes()):
        assert lengths(data, bits) == literal(data, bits)


@pytest.mark.parametrize("bits", [8, 14, 16])
def test_many_objects_at_once(bits):
    """Objects behind one another are cut as each by itself; sums are taken in steps."""
    rng = np.random.default_rng(bits)
    objects = [rng.integers(150, 256, int(n), np.uint8).tobytes() for n in rng.integers(0, 9000, 40)]
    bounds = np.cumsum([0, *map(len, objects)])
    ends, of = chunking.cut_all(np.frombuffer(b"".join(objects), np.uint8), bounds, bits)
    for k, v in enumerate(objects):
        assert np.diff([0, *(ends[of == k] - bounds[k])]).tolist() == literal(v, bits)


def test_constant_streams_never_cut():
    for value in range(0, 256, 15):
        assert lengths(bytes([value]) * 20_000, 14) == [20_000]
    assert lengths_max(bytes(20_000), 14, 4096) == [4096] * 4 + [3616]


def lengths_max(data, bits, most):
    return np.diff(np.concatenate([[0], chunking.cuts(data, bits, most)])).tolist()


@pytest.mark.parametrize("bits", [7, 19])
def test_bits_out_of_range(bits):
    with pytest.raises(ValueError):
        chunking.cuts(b"x" * 1000, bits)


@pytest.mark.parametrize("bits", [9, 11, 13])
def test_distribution(bits):
    data = np.random.default_rng(7).integers(0, 256, 4 << 20, np.uint8).tobytes()
    n = len(lengths(data, bits))
    expected = len(data) / (2**bits + 512)
    assert 0.7 * expected < n < 1.4 * expected


@pytest.mark.parametrize("bits", [8, 13])
def test_edits_stay_local(bits):
    """Single edits bring at most a few new chunks."""
    rng = np.random.default_rng(7)
    data = bytearray(rng.integers(0, 256, 256 << 10, np.uint8).tobytes())
    chunks = lambda d: {d[e - n : e] for e, n in zip(chunking.cuts(d, bits).tolist(), lengths(d, bits))}
    known, over = chunks(bytes(data)), 0
    for _ in range(60):
        at, kind = int(rng.integers(len(data))), int(rng.integers(3))
        if kind == 0:
            data[at] = int(rng.integers(256))
        elif kind == 1:
            data[at:at] = bytes([int(rng.integers(256))])
        else:
            del data[at]
        now = chunks(bytes(data))
        over += max(0, len(now - known) - 2)
        known |= now
    assert over <= 5


def test_frame_and_blocks(spark):
    rng = np.random.default_rng(3)
    objects = {k: rng.integers(0, 256, int(n), np.uint8).tobytes() for k, n in enumerate([0, 10, 5000, 90_000, 40_000])}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in objects.items()] + [(9, None)], "object_id long, data binary")
    got = chunking.chunk(df, "object_id", "data", 10).collect()
    for k, v in objects.items():
        mine = sorted((r.seq, r.offset, r.length, bytes(r.data)) for r in got if r.object_id == k)
        assert b"".join(m[3] for m in mine) == v and [m[2] for m in mine] == literal(v, 10) and [m[0] for m in mine] == list(range(len(mine)))
    blocks = [(k, n, bytearray(v[a:b])) for k, v in objects.items() for n, (a, b) in enumerate(zip(range(0, len(v), 777), [*range(777, len(v), 777), len(v)]))]
    blocks += [(7, n, bytearray(objects[3][n * 20 : n * 20 + 20])) for n in range(4500)]  # blocks shorter than the window
    from_blocks = chunking.chunk_blocks(spark.createDataFrame(blocks, "object_id long, block_no long, data binary"), 10).collect()
    with_data = chunking.chunk_data(spark.createDataFrame(blocks, "object_id long, block_no long, data binary"), 10, grid=4096).collect()
    high = {k: v for k, v in objects.items() if k != 2} | {2: rng.integers(200, 256, 50_000, np.uint8).tobytes()}
    for bits in (15, 18):
        rows = [(k, n, bytearray(v[a : a + 701])) for k, v in high.items() for n, a in enumerate(range(0, len(v), 701))]
        found = chunking.chunk_blocks(spark.createDataFrame(rows, "object_id long, block_no long, data binary"), bits).collect()
        for k, v in high.items():
            assert [r.length for r in sorted((r for r in found if r.object_id == k), key=lambda r: r.seq)] == literal(v, bits)
    for k, v in [*objects.items(), (7, objects[3])]:
        mine = sorted((r.seq, r.offset, bytes(r.data)) for r in with_data if r.object_id == k)
        assert [len(m[2]) for m in mine] == literal(v, 10) and b"".join(m[2] for m in mine) == v
        assert [r.length for r in sorted((r for r in from_blocks if r.object_id == k), key=lambda r: r.seq)] == literal(v, 10)
