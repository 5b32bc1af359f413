"""Content-defined chunks: cuts where a checksum over the last 64 bytes has its low bits all set.

The checksum has a closed form over a window, so every place that could be a cut is found with running sums in
numpy; what is left is a greedy pick of cuts at least 512 bytes apart, over these few places only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.binary import hash_bytes
from siltstone.model import MAX_SPLIT_BITS, MIN_CHUNK, MIN_SPLIT_BITS, WINDOW

#: The sums that a window of zeros starts with.
SUM1, SUM2 = WINDOW * 31, WINDOW * (WINDOW - 1) * 31


def check_bits(bits: int) -> None:
    if not MIN_SPLIT_BITS <= bits <= MAX_SPLIT_BITS:
        raise ValueError(f"split bits {bits} are not in {MIN_SPLIT_BITS} to {MAX_SPLIT_BITS}")


def _low(x: np.ndarray) -> np.ndarray:
    """The low 16 bits of the checksum of every window, the first of which ends at byte 63; sums wrap around."""
    x = x.astype(np.uint16)
    total = np.zeros(len(x) + 1, np.uint16)
    placed = np.zeros(len(x) + 1, np.uint16)
    np.cumsum(x, dtype=np.uint16, out=total[1:])
    np.cumsum(x * np.arange(len(x)).astype(np.uint16), dtype=np.uint16, out=placed[1:])
    end = np.arange(WINDOW, len(x) + 1).astype(np.uint16)
    return end * (total[WINDOW:] - total[:-WINDOW]) - (placed[WINDOW:] - placed[:-WINDOW]) + np.uint16(SUM2 & 0xFFFF)


def candidates(data: np.ndarray, bits: int, before: int = 0) -> list[np.ndarray]:
    """Ends of chunks that the checksum allows, by what the count of high bytes (225 and over) before the chunk leaves modulo 4.

    Up to 14 bits the four are one.  before: the count of high bytes that the object has before the data.
    """
    check_bits(bits)
    if len(data) < WINDOW:
        return [np.zeros(0, np.int64)] * (4 if bits > 14 else 1)
    low, mask = _low(data), (1 << bits) - 1
    if bits <= 14:
        return [np.flatnonzero((low & np.uint16(mask)) == mask) + WINDOW]
    # few places are left by the low 14 bits, whatever the count is
    at = np.flatnonzero((low & np.uint16(0x3FFF)) == 0x3FFF)
    total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    high = np.concatenate([[0], np.cumsum(data >= 225)])[at] + before
    s = total[at + WINDOW] - total[at]
    out = []
    for r in range(4):
        value = ((SUM1 + s) << 16) | ((low[at].astype(np.int64) + 16384 * ((high - r) % 4)) & 0xFFFF)
        out.append(at[(value & mask) == mask] + WINDOW)
    return out


def _pick(found: list[list[int]], start: int, end: int, left: Callable[[int], int], max_chunk: int | None) -> list[int]:
    """Ends of the chunks from start to end: each time the first place far enough, of those that what lies before allows."""
    ends, last = [], start
    while last < end:
        c = found[left(last)] if len(found) > 1 else found[0]
        at = bisect_left(c, last + MIN_CHUNK)
        to = min(c[at], end) if at < len(c) else end
        last = min(to, last + max_chunk) if max_chunk else to
        ends.append(last)
    return ends


def cut_all(data: np.ndarray, bounds: np.ndarray, bits: int, max_chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of objects that lie behind one another, between bounds; and which object each is of."""
    # a window never reaches over an object's start: chunks have 512 bytes at least, and then their last window is their own
    found = [c.tolist() for c in candidates(data, bits)]
    high = np.concatenate([[0], np.cumsum(data >= 225)]) if bits > 14 else None
    ends, of = [], []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        mine = _pick(found, a, b, lambda x: int(high[x]) % 4, max_chunk)
        ends += mine
        of += [k] * len(mine)
    return np.array(ends, np.int64), np.array(of, np.int64)


def cuts(data: bytes, bits: int, max_chunk: int | None = None) -> np.ndarray:
    """Ends of the chunks; none for no bytes. max_chunk: not part of the format, off by default."""
    x = np.frombuffer(data, np.uint8)
    return cut_all(x, np.array([0, len(x)]), bits, max_chunk)[0]


#: Bytes whose sums are computed at once; an object is never divided.
STEP = 4 << 20


def _spans(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Buffer]]:
    """(first row, rows, bytes, bounds, buffer) of a column's values in steps: values lie behind one another in Arrow."""
    column = column.fill_null(b"")
    _, offsets, buffer = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    buffer = buffer if buffer is not None else pa.py_buffer(b"")
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
        bounds = ends[at : upto + 1].astype(np.int64)
        yield at, upto - at, np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0], buffer.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        at = upto


def chunk(df: DataFrame, key: str, data: str, bits: int, payload: bool = True, max_chunk: int | None = None) -> DataFrame:
    """(key, seq, offset, length[, data]) of every object's chunks; null and empty objects have none."""
    check_bits(bits)
    kind = df.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("seq", T.LongType(), False), T.StructField("offset", T.LongType(), False), T.StructField("length", T.LongType(), False)]
    schema = T.StructType([*fields, *[T.StructField("data", T.BinaryType(), False)] * payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(key)
            for first, rows, x, bounds, buffer in _spans(b.column("data")):
                ends, of = cut_all(x, bounds, bits, max_chunk)
                new = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
                starts = np.where(new, bounds[of], np.concatenate([[0], ends[:-1]])[: len(of)])
                at = np.arange(len(of))
                seq = at - np.maximum.accumulate(np.where(new, at, 0)) if len(of) else at
                columns = [keys.slice(first, rows).take(pa.array(of)), pa.array(seq), pa.array(starts - bounds[of]), pa.array(ends - starts)]
                if payload:  # chunks lie behind one another as the objects do: their bytes are those of the column
                    held = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                    columns.append(pa.Array.from_buffers(pa.binary(), len(of), [None, held, buffer]))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, schema)


def count_candidates(df: DataFrame, key: str, data: str, bits: int) -> DataFrame:
    """(key, n_candidates): places at least 512 bytes into the object where the checksum allows a cut (up to 14 bits)."""
    if bits > 14:
        raise ValueError("over 14 bits the checksum depends on where the chunk begins")
    schema = T.StructType([df.schema[key], T.StructField("n_candidates", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.zeros(0, np.int64)]
            for _, _, x, bounds, _ in _spans(b.column("data")):
                places = candidates(x, bits)[0]
                first = np.searchsorted(places, np.minimum(bounds[:-1] + MIN_CHUNK, bounds[1:] + 1))
                counts.append(np.searchsorted(places, bounds[1:], "right") - first)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.concatenate(counts), pa.int64())], schema.names)

    return df.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, schema)


def chunk_blocks(blocks: DataFrame, bits: int, object_id: str = "object_id", block_no: str = "block_no", data: str = "data") -> DataFrame:
    """(object_id, seq, offset, length) for objects too large for one cell, held as numbered blocks.

    Every block finds its candidates with the 63 bytes before it; only these few places of an object come together.
    Over 14 bits the checksum depends on how many high bytes lie before the chunk: blocks are counted first, and a place
    carries its count.
    """
    check_bits(bits)
    order = Window.partitionBy(object_id).orderBy(block_no)
    size = F.octet_length(data).cast("long")
    # the 63 bytes may reach over several short blocks: their tails are put together, each no longer than needed
    tail = F.expr(f"substring({data}, greatest(octet_length({data}) - {WINDOW - 2}, 1), {WINDOW - 1})")
    high = _count_high(F.col(data)) if bits > 14 else F.lit(0).cast("long")
    # only sizes, counts and tails pass the window, so that one object's bytes never have to be in one task
    narrow = blocks.select(object_id, block_no, size.alias("size"), tail.alias("tail"), high.alias("high"))
    former = order.rowsBetween(Window.unboundedPreceding, -1)
    narrow = narrow.select(object_id, block_no, *(F.coalesce(F.sum(c).over(former), F.lit(0)).alias(n) for c, n in (("size", "base"), ("high", "high"))), F.collect_list("tail").over(order.rowsBetween(-(WINDOW - 1), -1)).alias("before"))
    rows = blocks.select(object_id, block_no, F.col(data).alias("data")).join(narrow, [object_id, block_no])
    schema = T.StructType([blocks.schema[object_id], T.StructField("end", T.LongType(), False), T.StructField("last", T.BooleanType(), False), T.StructField("allows", T.IntegerType(), False), T.StructField("left", T.IntegerType(), False)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, base, count = b.column("data")[k].as_py() or b"", b.column("base")[k].as_py(), b.column("high")[k].as_py()
                lead = b"".join(b.column("before")[k].as_py())[-(WINDOW - 1) :]
                whole = np.frombuffer(lead + x, np.uint8)
                found = candidates(whole, bits, count - int((whole[: len(lead)] >= 225).sum()))
                ends, inverse = np.unique(np.concatenate(found), return_inverse=True)
                allows = np.zeros(len(ends), np.int32)
                np.bitwise_or.at(allows, inverse, np.repeat(1 << np.arange(len(found)), [len(c) for c in found]).astype(np.int32))
                upto = np.concatenate([[0], np.cumsum(whole[len(lead) :] >= 225)]) + count if bits > 14 else None
                own = ends > len(lead)
                ends, allows = ends[own], allows[own]
                left = upto[ends - len(lead)] % 4 if bits > 14 else np.zeros(len(ends))
                n = len(ends) + 1
                columns = [pa.array(np.append(ends + base - len(lead), base + len(x))), pa.array(np.arange(n) == n - 1), pa.array(np.append(allows, 0).astype(np.int32)), pa.array(np.append(left, 0).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(object_id)[k].as_py()] * n, b.schema.field(object_id).type), *columns], schema.names)

    def pick(group: pa.Table) -> pa.Table:
        ends, last, allows, left = (group.column(c).to_numpy() for c in ("end", "last", "allows", "left"))
        total, places = int(ends.max()), ends[~last]
        found = [np.unique(places[allows[~last] >> r & 1 == 1]).tolist() for r in range(4 if bits > 14 else 1)]
        after = dict(zip(places.tolist(), left[~last].tolist(), strict=True))
        cut = _pick(found, 0, total, lambda x: after.get(x, 0), None)
        starts = np.array([0, *cut[:-1]][: len(cut)], np.int64)
        key = pa.array([group.column(object_id)[0].as_py()] * len(cut), group.schema.field(object_id).type)
        return pa.table({object_id: key, "seq": pa.array(range(len(cut)), pa.int64()), "offset": pa.array(starts), "length": pa.array(np.array(cut, np.int64) - starts)})

    found = rows.mapInArrow(find, schema)
    return found.groupBy(object_id).applyInArrow(pick, T.StructType([blocks.schema[object_id], *(T.StructField(c, T.LongType()) for c in ("seq", "offset", "length"))]))


def _high(column: pa.Array) -> pa.Array:
    return pa.array([int((np.frombuffer(x or b"", np.uint8) >= 225).sum()) for x in column.to_pylist()], pa.int64())


_count_high = F.arrow_udf(_high, T.LongType())


def chunk_data(blocks: DataFrame, bits: int, object_id: str = "object_id", block_no: str = "block_no", data: str = "data", grid: int = 1 << 20) -> DataFrame:
    """(object_id, seq, offset, length, data) of the chunks of objects held as numbered blocks.

    Which part of which block a chunk needs is found on numbers alone, by cells of `grid` bytes; then every block is
    read once and gives its parts, and a chunk's parts come together.
    """
    order = Window.partitionBy(object_id).orderBy(block_no)
    size = F.octet_length(data).cast("long")
    sizes = blocks.select(object_id, block_no, size.alias("size")).withColumn("base", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("size > 0")
    found = chunk_blocks(blocks, bits, object_id, block_no, data)
    cells = lambda first, n: F.explode(F.sequence(F.expr(f"{first} div {grid}"), F.expr(f"({first} + {n} - 1) div {grid}"))).alias("cell")
    a = found.select(object_id, "seq", "offset", "length", cells("offset", "length"))
    b = sizes.select(F.col(object_id).alias("of"), block_no, "base", "size", cells("base", "size"))
    once = F.col("cell") == F.expr(f"greatest(base div {grid}, offset div {grid})")
    pairs = a.join(b.withColumnRenamed("cell", "at"), (F.col(object_id) == F.col("of")) & (F.col("cell") == F.col("at"))).where(once & (F.col("base") < F.col("offset") + F.col("length")) & (F.col("offset") < F.col("base") + F.col("size")))
    start = F.greatest(F.col("offset"), F.col("base"))
    stop = F.least(F.col("offset") + F.col("length"), F.col("base") + F.col("size"))
    wanted = pairs.groupBy(object_id, block_no).agg(F.collect_list(F.struct("seq", "offset", "length", (start - F.col("base")).alias("start"), (stop - F.col("base")).alias("stop"))).alias("parts"))
    key = blocks.schema[object_id]
    schema = T.StructType([key, *(T.StructField(c, T.LongType()) for c in ("seq", "offset", "length", "block")), T.StructField("piece", T.BinaryType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, parts, block = batch.column("data")[k].as_py(), batch.column("parts")[k].as_py(), batch.column("block")[k].as_py()
                columns = [pa.array([batch.column(object_id)[k].as_py()] * len(parts), batch.schema.field(object_id).type)]
                columns += [pa.array([p[c] for p in parts], pa.int64()) for c in ("seq", "offset", "length")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([block] * len(parts), pa.int64()), pa.array([x[p["start"] : p["stop"]] for p in parts], pa.binary())], schema.names)

    pieces = blocks.select(object_id, block_no, F.col(data).alias("data")).join(wanted, [object_id, block_no]).select(object_id, F.col(block_no).cast("long").alias("block"), "data", "parts").mapInArrow(take, schema)
    whole = pieces.groupBy(object_id, "seq", "offset", "length").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("held"))
    return whole.select(object_id, "seq", "offset", "length", F.expr("aggregate(held, cast('' as binary), (a, p) -> concat(a, p.piece))").alias("data"))


def hashed(chunks: DataFrame, data: str = "data") -> DataFrame:
    """Adds the identity of each chunk."""
    return chunks.withColumn("hash", hash_bytes(data))
