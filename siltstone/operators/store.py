"""Chunk store: dedup, index, packs, recipes, reassembly, Merkle identities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.durable import written
from siltstone.functions.binary import hash_bytes, read_varint, shake256, varint, varint_length
from siltstone.model import BLOB_MAGIC, HASH_BYTES, INDEX_MAGIC, MAX_LEVEL
from siltstone.operators.chunking import chunk_data, cuts, hashed


def distinct_hashes(chunks: DataFrame, hash: str = "hash") -> DataFrame:
    return chunks.select(hash).distinct()


def new_chunks(chunks: DataFrame, index: DataFrame, hash: str = "hash") -> DataFrame:
    """One row for each hash that the index hasn't; only hashes are shuffled against the index."""
    return chunks.dropDuplicates([hash]).join(index.select(hash), hash, "left_anti")


def existing(hashes: DataFrame, index: DataFrame, hash: str = "hash") -> DataFrame:
    return hashes.join(index.select(hash), hash, "left_semi")


def locate(hashes: DataFrame, index: DataFrame, hash: str = "hash") -> DataFrame:
    """Pack, offset and length of each hash that is stored."""
    return hashes.join(index, hash)


def duplicate_index_entries(index: DataFrame, hash: str = "hash") -> DataFrame:
    """Hashes that more than one entry claims; the format allows none."""
    return index.groupBy(hash).agg(F.count("*").alias("n")).where("n > 1")


def dedup_report(chunks: DataFrame, hash: str = "hash", length: str = "length") -> DataFrame:
    """Chunks and bytes, all and distinct: one aggregation by hash, summed up."""
    by_hash = chunks.groupBy(hash).agg(F.count("*").alias("n"), F.max(length).alias("size"))
    return by_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"),
    )


# packs


def record_length(length: Column) -> Column:
    """Bytes of a chunk's record in a pack: magic, varint of the length, chunk."""
    return F.lit(len(BLOB_MAGIC)) + varint_length(length) + length


def running_offsets(chunks: DataFrame, order: list[str], length: str = "length", group: list[str] | None = None) -> DataFrame:
    """Adds `record` and the `offset` in an endless pack (of each group).

    Ranges of the order are summed first, and then the rows of each, so that no group has to be in one task.  chunks:
    narrow rows, as they are written once.
    """
    keys, part, base = group or [], "siltstone_part", "siltstone_base"
    rows = chunks.withColumn("record", record_length(F.col(length)).cast("long"))
    rows = written(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "records")
    former = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, part).agg(F.sum("record").alias("sum")).withColumn(base, F.coalesce(F.sum("sum").over(former), F.lit(0))).drop("sum")
    sums = sums.select(*(F.col(k).alias(f"siltstone_{k}") for k in keys), F.col(part).alias("siltstone_of"), base)
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"siltstone_{k}")) for k in keys]
    met = rows.withColumn("offset", F.coalesce(F.sum("record").over(inside), F.lit(0))).join(sums, reduce(lambda x, y: x & y, same, F.col(part) == F.col("siltstone_of")))
    return met.withColumn("offset", F.col("offset") + F.col(base)).select(*chunks.columns, "record", "offset")


def assign_packs(chunks: DataFrame, order: list[str], group: str | list[str], limit: int, length: str = "length", slop: int = 16) -> DataFrame:
    """Adds `pack` (from 0 in each group) and `offset`: a chunk that would pass the limit opens a new pack.

    A group is one writer's stream, which is sequential; it is read in order, batch by batch, and isn't held.  Many
    writers, such as ranges of a source, are many groups, which run side by side.
    """
    groups = [group] if isinstance(group, str) else group
    rows = chunks.withColumn("record", record_length(F.col(length)).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("pack", T.LongType()), T.StructField("offset", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, of = 0, 0, None
        for b in batches:
            pack, offset = [], []
            keys = zip(*(b.column(g).to_pylist() for g in groups), strict=True)
            for key, size, record in zip(keys, b.column(length).to_pylist(), b.column("record").to_pylist(), strict=True):
                if key != of:
                    of, number, at = key, 0, 0
                if at and at + size + slop > limit:
                    number, at = number + 1, 0
                pack.append(number)
                offset.append(at)
                at += record
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pack, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    return rows.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(fold, schema)


def blob_record(data: bytes) -> bytes:
    return BLOB_MAGIC + varint(len(data)) + data


def index_record(hash: bytes, offset: int, length: int) -> bytes:
    return INDEX_MAGIC + hash + varint(offset) + varint(length)


def decode_pack(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, chunk) of all records; a broken record is an error."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != BLOB_MAGIC:
            raise ValueError(f"no blob at byte {at}")
        n, start = read_varint(content, at + 4)
        if n < 0 or start + n > len(content):
            raise ValueError(f"the blob at byte {at} is cut off")
        yield at, content[start : start + n]
        at = start + n


def decode_index(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(hash, offset, length) of all entries."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != INDEX_MAGIC or at + 4 + HASH_BYTES > len(content):
            raise ValueError(f"no index entry at byte {at}")
        hash = content[at + 4 : at + 4 + HASH_BYTES]
        offset, at = read_varint(content, at + 4 + HASH_BYTES)
        length, at = read_varint(content, at)
        yield hash, offset, length


def encode_packs(chunks: DataFrame, pack: str = "pack", order: str = "seq", data: str = "data") -> DataFrame:
    """(pack, content, index): the bytes of pack and index files of chunks that were dealt to packs; a pack's limit bounds its cell."""
    schema = T.StructType([T.StructField(pack, chunks.schema[pack].dataType), T.StructField("content", T.BinaryType()), T.StructField("index", T.BinaryType())])

    def build(table: pa.Table) -> pa.Table:
        content, index = bytearray(), bytearray()
        for x in table.sort_by(order).column(data).to_pylist():
            record = blob_record(x)
            index += index_record(shake256(x), len(content), len(record))
            content += record
        return pa.table({pack: table.column(pack).slice(0, 1), "content": pa.array([bytes(content)], pa.binary()), "index": pa.array([bytes(index)], pa.binary())})

    return chunks.groupBy(pack).applyInArrow(build, schema)


def read_packs(files: DataFrame, pack: str = "pack", content: str = "content") -> DataFrame:
    """(pack, offset, data) of all blobs in pack files."""
    schema = T.StructType([T.StructField(pack, files.schema[pack].dataType), T.StructField("offset", T.LongType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, x in zip(b.column(pack), b.column(content).to_pylist(), strict=True):
                found = list(decode_pack(x or b""))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), b.schema.field(pack).type), pa.array([o for o, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], schema.names)

    return files.select(pack, content).mapInArrow(run, schema)


def read_index(files: DataFrame, pack: str = "pack", index: str = "index") -> DataFrame:
    """(hash, pack_name, offset, length) of all entries of index files."""
    schema = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("pack_name", files.schema[pack].dataType), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, x in zip(b.column(pack), b.column(index).to_pylist(), strict=True):
                found = list(decode_index(x or b""))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in found], pa.binary()), pa.array([name.as_py()] * len(found), b.schema.field(pack).type), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2))], schema.names)

    return files.select(pack, index).mapInArrow(run, schema)


# recipes


def pieces(recipes: DataFrame, chunks: DataFrame, hash: str = "hash", data: str = "data") -> DataFrame:
    """The recipes' rows with the bytes of each chunk as `piece`, null where it is missing; never broadcast, as bytes may be many."""
    return recipes.join(chunks.select(hash, F.col(data).alias("piece")).hint("merge"), hash, "left")


def reassemble(recipes: DataFrame, chunks: DataFrame, key: str = "object_id", hash: str = "hash", data: str = "data") -> DataFrame:
    """(key, data): every object's bytes in the order of its recipe, for objects that fit a cell; what has a missing chunk has
    null data.  Larger objects are written piece by piece, from `pieces`."""
    held = pieces(recipes, chunks, hash, data).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("parts"))
    return held.select(key, join_pieces("parts").alias(data))


def _join(parts: pa.Array) -> pa.Array:
    return pa.array([None if p is None or any(x["piece"] is None for x in p) else b"".join(x["piece"] for x in p) for p in parts.to_pylist()], pa.binary())


join_pieces = F.arrow_udf(_join, T.BinaryType())


def verified(chunks: DataFrame, hash: str = "hash", data: str = "data") -> DataFrame:
    """Adds `intact`: whether the bytes still have the hash they are kept under."""
    return chunks.withColumn("intact", hash_bytes(data) == F.col(hash))


# Merkle identities


def merkle_bytes(hash: Column, level: Column) -> Column:
    """Wire form: the hash, then one byte of level."""
    return F.concat(hash, F.unhex(F.lpad(F.hex(level.cast("long")), 2, "0")))


def merkle_parse(wire: Column) -> Column:
    return F.struct(F.substring(wire, 1, HASH_BYTES).alias("hash"), F.conv(F.hex(F.substring(wire, HASH_BYTES + 1, 1)), 16, 10).cast("tinyint").alias("level"))


def merkle_tree(leaves: list[bytes], bits: int) -> list[list[tuple[bytes, bytes]]]:
    """Levels above the leaf hashes, each as (hash, node bytes): the hashes of a level, put together and cut like data."""
    levels, hashes = [], leaves
    while len(hashes) != 1:
        if not hashes or len(levels) >= MAX_LEVEL:
            raise ValueError("an empty stream has no identity" if not hashes else "the tree is too high")
        whole = b"".join(hashes)
        ends = cuts(whole, bits)
        nodes = [whole[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        hashes = [shake256(n) for n in nodes]
        levels.append(list(zip(hashes, nodes, strict=True)))
    return levels


def merkle_roots(recipes: DataFrame, bits: int, key: str = "object_id", hash: str = "hash") -> DataFrame:
    """(key, hash, level) of every object's root, where the hashes of an object (32 bytes a chunk) fit a task; see `tall_roots`."""
    schema = T.StructType([T.StructField(key, recipes.schema[key].dataType), T.StructField("hash", T.BinaryType()), T.StructField("level", T.ByteType())])

    def root(table: pa.Table) -> pa.Table:
        leaves = table.sort_by("seq").column(hash).to_pylist()
        levels = merkle_tree(leaves, bits)
        return pa.table({key: table.column(key).slice(0, 1), "hash": pa.array([levels[-1][0][0] if levels else leaves[0]], pa.binary()), "level": pa.array([len(levels)], pa.int8())})

    return recipes.select(key, "seq", hash).groupBy(key).applyInArrow(root, schema)


def tall_roots(recipes: DataFrame, bits: int, key: str = "object_id", hash: str = "hash", block_rows: int = 4096) -> DataFrame:
    """As `merkle_roots`, level by level, for objects of any number of chunks: a level's hashes are blocks of bytes, which are cut
    like any data in blocks.  The number of rounds is that of the levels, ten at most."""
    table, out = written(recipes.select(F.col(key).alias("object_id"), "seq", F.col(hash).alias("hash")), "level"), None
    for level in range(MAX_LEVEL + 1):
        sizes = table.groupBy("object_id").agg(F.count("*").alias("n"))
        done = table.join(sizes.where("n = 1"), "object_id", "left_semi").select("object_id", "hash", F.lit(level).cast("tinyint").alias("level"))
        out = done if out is None else out.unionByName(done)
        rest = table.join(sizes.where("n > 1"), "object_id", "left_semi")
        if not rest.limit(1).count():
            return out.withColumnRenamed("object_id", key)
        blocks = rest.groupBy("object_id", F.expr(f"seq div {block_rows}").alias("block_no")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("hash").alias("piece")))).alias("parts"))
        nodes = chunk_data(blocks.select("object_id", "block_no", join_pieces("parts").alias("data")), bits)
        table = written(hashed(nodes).select("object_id", "seq", "hash"), "level")
    raise ValueError("the tree is too high")


def expand_level(nodes: DataFrame, key: str = "object_id", data: str = "data") -> DataFrame:
    """(key, seq, hash): the hashes that the nodes of a level hold, given as (key, seq, data); nodes may be cut inside a hash.

    A level that is no whole number of hashes is an error.
    """
    former = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(data).cast("long")
    places = nodes.select(key, "seq", size.alias("size")).withColumn("base", F.coalesce(F.sum("size").over(former), F.lit(0))).where("size > 0")
    held = nodes.select(key, "seq", F.col(data).alias("data")).join(places, [key, "seq"])
    parts = held.select(key, "seq", "data", "base", F.explode(F.expr(f"sequence(base div {HASH_BYTES}, (base + size - 1) div {HASH_BYTES})")).alias("number"))
    start = F.greatest(F.col("number") * HASH_BYTES - F.col("base"), F.lit(0))
    stop = (F.col("number") + 1) * HASH_BYTES - F.col("base")
    piece = F.substring("data", (start + 1).cast("int"), (stop - start).cast("int"))
    whole = parts.groupBy(key, "number").agg(F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece")))).alias("parts"))
    hash = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.piece))")
    fine = F.when(F.octet_length(hash) == HASH_BYTES, hash).otherwise(F.raise_error(F.lit("a level is no whole number of hashes")).cast("binary"))
    return whole.select(key, F.col("number").alias("seq"), fine.alias("hash"))


def merkle_expand(node: bytes) -> list[bytes]:
    """The hashes of a whole level's bytes, put together first: nodes may be cut inside a hash."""
    if len(node) % HASH_BYTES:
        raise ValueError("a level is no whole number of hashes")
    return [node[k : k + HASH_BYTES] for k in range(0, len(node), HASH_BYTES)]


def merkle_nodes(leaves: np.ndarray | list[bytes], bits: int) -> list[bytes]:
    """Hashes of all interior nodes."""
    return [h for level in merkle_tree(list(leaves), bits) for h, _ in level]
