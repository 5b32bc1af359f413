"""Functions of bytes. Built-in where Spark has them; Arrow batches where it hasn't."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.model import HASH_BYTES


def _of_bytes(f: Callable[[bytes], object], kind: T.DataType) -> Callable[[Column | str], Column]:
    """An Arrow function of one binary column; null gives null."""
    arrow = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.IntegerType: pa.int32()}[type(kind)]

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in column.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


def shake256(data: bytes) -> bytes:
    """The identity of a chunk: 32 bytes of SHAKE256."""
    return hashlib.shake_256(data).digest(HASH_BYTES)


hash_bytes = _of_bytes(shake256, T.BinaryType())


def hex_of(column: Column) -> Column:
    return F.lower(F.hex(column))


def is_hash_text(column: Column) -> Column:
    """Whether the text is the hex form of a hash."""
    return (F.length(column) == 2 * HASH_BYTES) & column.rlike("^[0-9a-fA-F]+$")


# zig-zag varints


def varint(n: int) -> bytes:
    """Signed variable-length integer: zig-zag, then seven bits to a byte, lowest first."""
    u, out = (n << 1) ^ (n >> 63), bytearray()
    u &= (1 << 64) - 1
    while u >= 0x80:
        out.append(u & 0x7F | 0x80)
        u >>= 7
    return bytes([*out, u])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    u = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("broken varint")
        u |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return (u >> 1) ^ -(u & 1), at


def varint_length(column: Column) -> Column:
    """Bytes that the varint of a number from zero takes."""
    steps = F.lit(10)
    for k in range(9, 0, -1):
        steps = F.when(column < F.lit(1 << (7 * k - 1)), F.lit(k)).otherwise(steps)
    return steps


# compression: one flag byte, then the data, compressed only if that is smaller


def pack_gzip(data: bytes) -> bytes:
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    small = coder.compress(data) + coder.flush()
    return b"\1" + small if len(small) < len(data) else b"\0" + data


def unpack_gzip(data: bytes) -> bytes:
    if data[:1] == b"\1":
        return zlib.decompress(data[1:], 31)
    if data[:1] == b"\0":
        return data[1:]
    raise ValueError("unknown compression flag")


compress = _of_bytes(pack_gzip, T.BinaryType())
decompress = _of_bytes(unpack_gzip, T.BinaryType())


def encrypt(column: Column, key: Column) -> Column:
    """AES-GCM with a random IV in front: authenticated, and native in Spark."""
    return F.aes_encrypt(column, key, F.lit("GCM"))


def decrypt(column: Column, key: Column) -> Column:
    return F.aes_decrypt(column, key, F.lit("GCM"))


# Castagnoli's checksum


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_CRC = _table()
#: Bytes of one lane: texts are cut into these from their end, and all lanes go side by side.
LANE = 256


def _advance() -> np.ndarray:
    """Tables (one for each byte of a checksum) of what LANE zero bytes make of it."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(LANE):
            c = _CRC[c & 255] ^ (c >> 8)
        out[k] = c
    return out


_AFTER = _advance()


def crc32c_all(texts: list[bytes]) -> list[int]:
    """Castagnoli's checksum of each text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    lanes = -(-sizes // LANE)
    # every text is filled up in front: leading zeros don't change a checksum that starts at zero
    held = np.zeros((int(lanes.sum()), LANE), np.uint8)
    flat, ends = held.reshape(-1), np.cumsum(lanes) * LANE
    for x, n, e in zip(texts, sizes.tolist(), ends.tolist(), strict=True):
        flat[e - n : e] = np.frombuffer(x, np.uint8)
    c = np.zeros(len(held), np.uint32)
    for column in np.ascontiguousarray(held.T):
        c = _CRC[(c ^ column) & 255] ^ (c >> 8)
    out, first = np.zeros(len(texts), np.uint32), np.cumsum(lanes) - lanes
    for k in range(int(lanes.max(initial=0))):
        rows = np.flatnonzero(lanes > k)
        before = out[rows]
        out[rows] = _AFTER[0][before & 255] ^ _AFTER[1][before >> 8 & 255] ^ _AFTER[2][before >> 16 & 255] ^ _AFTER[3][before >> 24] ^ c[first[rows] + k]
    return [int(x) ^ _start(n) for x, n in zip(out, sizes.tolist(), strict=True)]


@functools.lru_cache(4096)
def _start(n: int) -> int:
    """What the first value, all ones, has become after n bytes, and the last inversion."""
    c = np.uint32(0xFFFFFFFF)
    for _ in range(n % LANE):
        c = _CRC[c & np.uint32(255)] ^ (c >> np.uint32(8))
    c = int(c)
    for _ in range(n // LANE):
        c = int(_AFTER[0][c & 255] ^ _AFTER[1][c >> 8 & 255] ^ _AFTER[2][c >> 16 & 255] ^ _AFTER[3][c >> 24])
    return c ^ 0xFFFFFFFF


def crc32c(data: bytes) -> int:
    return crc32c_all([data])[0]


def _checksums(column: pa.Array) -> pa.Array:
    texts = column.to_pylist()
    found = crc32c_all([x or b"" for x in texts])
    return pa.array([None if x is None else c for x, c in zip(texts, found, strict=True)], pa.int64())


checksum = F.arrow_udf(_checksums, T.LongType())


def format_bytes(column: Column) -> Column:
    """Size for people; the unit changes at "greater or equal" for GiB and TiB, at "greater" below these."""
    size = lambda k, unit: F.format_string(f"%.2f {unit}", F.bround(column / F.lit(float(1 << k)), 2))
    return (
        F.when(column >= F.lit(1 << 40), size(40, "TiB")).when(column >= F.lit(1 << 30), size(30, "GiB"))
        .when(column > F.lit(1 << 20), size(20, "MiB")).when(column > F.lit(1 << 10), size(10, "kiB")).otherwise(F.format_string("%d B", column))
    )
