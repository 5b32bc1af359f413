"""Reed-Solomon parity of files: segments of data shards, parity shards, and a hash of each.

The generator is systematic: a Vandermonde matrix over GF(2^8), multiplied by the inverse of its upper square, so
that any `n_data` shards give the rest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.binary import shake256
from siltstone.model import RS_DATA, RS_PARITY, RS_SEGMENTS, RS_SHARD


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2 modulo x^8 + x^4 + x^3 + x^2 + 1, and logarithms."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for k in range(255):
        power[k] = power[k + 255] = x
        log[x] = k
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    return power, log


POWER, LOG = _tables()


#: All products: a row for each left factor.
PRODUCT = np.where((np.arange(256)[:, None] == 0) | (np.arange(256)[None, :] == 0), 0, POWER[(LOG[:, None] + LOG[None, :]) % 255]).astype(np.uint8)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return PRODUCT[a, b]


def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: a factor's row of products, taken at the other's bytes."""
    out = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for i, k in np.argwhere(a).tolist():
        out[i] ^= PRODUCT[a[i, k]][b[k]]
    return out


def inverse(m: np.ndarray) -> np.ndarray:
    """By elimination; raises on a singular matrix."""
    n = len(m)
    work = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], 1)
    for k in range(n):
        pivots = np.flatnonzero(work[k:, k])
        if not len(pivots):
            raise ValueError("singular matrix")
        work[[k, k + pivots[0]]] = work[[k + pivots[0], k]]
        work[k] = multiply(work[k], POWER[(255 - LOG[work[k, k]]) % 255])
        for r in np.flatnonzero(work[:, k]):
            if r != k:
                work[r] ^= multiply(work[k], work[r, k])
    return work[:, n:]


@functools.cache
def generator(n_data: int, n_parity: int) -> np.ndarray:
    """Rows of the identity, then the parity rows."""
    if n_data < 1 or n_parity < 1 or n_data + n_parity > 256:
        raise ValueError("shards must be 1 to 256 in all, at least one of each kind")
    x = np.arange(n_data + n_parity)
    m = np.stack([np.where(x == 0, int(k == 0), POWER[(LOG[x] * k) % 255]) for k in range(n_data)], 1).astype(np.uint8)
    return matmul(m, inverse(m[:n_data]))


def split(segment: bytes, n_data: int) -> np.ndarray:
    """Data shards of equal length, the end filled with zeros."""
    size = -(-len(segment) // n_data)
    return np.frombuffer(segment.ljust(size * n_data, b"\0"), np.uint8).reshape(n_data, size)


def encode_segment(segment: bytes, n_data: int, n_parity: int) -> tuple[list[bytes], list[bytes]]:
    """Hashes of all shards, and the parity shards."""
    data = split(segment, n_data)
    parity = matmul(generator(n_data, n_parity)[n_data:], data)
    return [shake256(s.tobytes()) for s in [*data, *parity]], [p.tobytes() for p in parity]


def restore_segment(segment: bytes, hashes: list[bytes], parity: list[bytes], n_data: int) -> tuple[bytes, list[bytes], list[int]]:
    """The segment and its parity as they were, and which shards were bad; raises if too many are."""
    size = -(-len(segment) // n_data)
    shards = [*split(segment, n_data), *(np.frombuffer(p.ljust(size, b"\0")[:size], np.uint8) for p in parity)]
    bad = [k for k, s in enumerate(shards) if shake256(s.tobytes()) != hashes[k]]
    if bad:
        good = [k for k in range(len(shards)) if k not in bad]
        if len(good) < n_data:
            raise ValueError(f"{len(bad)} bad shards, {len(parity)} can be repaired")
        g = generator(n_data, len(parity))
        data = matmul(inverse(g[good[:n_data]]), np.stack([shards[k] for k in good[:n_data]]))
        every = np.concatenate([data, matmul(g[n_data:], data)])
        if any(shake256(s.tobytes()) != h for s, h in zip(every, hashes, strict=True)):
            raise ValueError("what was repaired doesn't have the hashes")
        return data.tobytes()[: len(segment)], [s.tobytes() for s in every[n_data:]], bad
    return segment, [s.tobytes() for s in shards[n_data:]], bad


def segments(files: DataFrame, file: str = "file", content: str = "content", n_data: int = RS_DATA, hash_rate: int = RS_SHARD) -> DataFrame:
    """(file, seg, data): the file's bytes in segments of n_data * hash_rate, one row each; an empty file has none."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("data", T.BinaryType())])
    step = n_data * hash_rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, x in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                parts = [x[k : k + step] for k in range(0, len(x or b""), step)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], schema.names)

    return files.select(F.col(file).cast("string").alias("file"), F.col(content).cast("binary").alias("content")).mapInArrow(run, schema)


def layout(files: DataFrame, file: str, size: str, n_data: int = RS_DATA, hash_rate: int = RS_SHARD) -> DataFrame:
    """(file, seg, seg_bytes, shard_bytes) from sizes alone."""
    step = n_data * hash_rate
    n = F.ceil(F.col(size) / step).cast("long")
    rows = files.where(F.col(size) > 0).select(file, size, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seg"))
    held = F.least(F.lit(step).cast("long"), F.col(size) - F.col("seg") * step)
    return rows.select(file, "seg", held.alias("seg_bytes"), F.ceil(held / n_data).cast("long").alias("shard_bytes"))


def encode(files: DataFrame, file: str = "file", content: str = "content", n_data: int = RS_DATA, n_parity: int = RS_PARITY, hash_rate: int = RS_SHARD) -> DataFrame:
    """(file, seg, hashes, parity) of every segment of files that fit a cell."""
    return encode_segments(segments(files, file, content, n_data, hash_rate), n_data, n_parity)


def encode_segments(cut: DataFrame, n_data: int = RS_DATA, n_parity: int = RS_PARITY) -> DataFrame:
    """The same of (file, seg, data), such as files of any size read in blocks of n_data * hash_rate bytes give."""
    generator(n_data, n_parity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_segment(x, n_data, n_parity) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("seg"), *(pa.array([m[k] for m in made], pa.list_(pa.binary())) for k in (0, 1))], ["file", "seg", "hashes", "parity"])

    return cut.select("file", "seg", "data").mapInArrow(run, RS_SEGMENTS)


def check(files: DataFrame, parity: DataFrame, file: str = "file", content: str = "content", n_data: int = RS_DATA, hash_rate: int = RS_SHARD) -> DataFrame:
    """(file, seg, shard, kind): shards that don't have their hash, segments that only one side has (shard -1)."""
    return check_segments(segments(files, file, content, n_data, hash_rate), parity, n_data)


def check_segments(cut: DataFrame, parity: DataFrame, n_data: int = RS_DATA) -> DataFrame:
    """The same of (file, seg, data)."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["data"] is None or r["hashes"] is None:
                    out.append({"file": r["file"], "seg": r["seg"], "shard": -1, "kind": "extra" if r["data"] is None else "unprotected"})
                    continue
                shards = [*split(r["data"], n_data), *(np.frombuffer(p, np.uint8) for p in r["parity"])]
                out += [{"file": r["file"], "seg": r["seg"], "shard": k, "kind": "data" if k < n_data else "parity"} for k, s in enumerate(shards) if shake256(s.tobytes()) != r["hashes"][k]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("seg", pa.int64()), ("shard", pa.int32()), ("kind", pa.string())]))

    return cut.select("file", "seg", "data").join(parity, ["file", "seg"], "full_outer").mapInArrow(run, schema)


def corrupt_shards(checked: DataFrame) -> DataFrame:
    return checked.groupBy("file", "seg").agg(F.count("*").alias("bad"))


def restore(files: DataFrame, parity: DataFrame, file: str = "file", content: str = "content", n_data: int = RS_DATA, hash_rate: int = RS_SHARD) -> DataFrame:
    """(file, seg, data, hashes, parity, bad): segments and parity repaired, and the shards that were bad; raises beyond repair."""
    return restore_segments(segments(files, file, content, n_data, hash_rate), parity, n_data)


def restore_segments(cut: DataFrame, parity: DataFrame, n_data: int = RS_DATA) -> DataFrame:
    """The same of (file, seg, data)."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("seg", T.LongType()), T.StructField("data", T.BinaryType()), RS_SEGMENTS["hashes"], RS_SEGMENTS["parity"], T.StructField("bad", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                data, parity_, bad = restore_segment(r["data"], r["hashes"], r["parity"], n_data)
                out.append({"file": r["file"], "seg": r["seg"], "data": data, "hashes": r["hashes"], "parity": parity_, "bad": bad})
            types = [("file", pa.string()), ("seg", pa.int64()), ("data", pa.binary()), ("hashes", pa.list_(pa.binary())), ("parity", pa.list_(pa.binary())), ("bad", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(types))

    return cut.select("file", "seg", "data").join(parity, ["file", "seg"]).mapInArrow(run, schema)
