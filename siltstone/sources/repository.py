"""A repository: tables in one folder, read from the names on, so that what isn't named yet isn't there.

Every commit writes chunks, then recipes and entries, then the snapshot, then its name; a run that stops on the way
leaves rows that nothing leads to. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import os
import zlib
from collections.abc import Callable
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import durable, model
from siltstone.functions.binary import compress, decompress, decrypt, encrypt, hash_bytes, shake256, unpack_gzip
from siltstone.operators import chunking, metadata, parity, snapshots, store, verify
from siltstone.session import importable
from siltstone.sources.files import BLOCK_BYTES, write_pieces, write_tree

#: Fixed values of the key derivation.
ROUNDS, DERIVED = 65_536, 64
#: Binary literals of 16 bytes and more, as plans show them.
LONG_BINARY = "(0x|X')[0-9A-Fa-f]{32,}"
#: Of a pack file by default: one is a cell.
PACK_BYTES = 256 << 20


class Repository:
    def __init__(self, spark: SparkSession, path: str, passphrase: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if not self.exists():
            raise FileNotFoundError(f"no repository at {path}")
        record = self.metadata().where("name = 'key'").select("data").first()
        if (record is None) != (passphrase is None):
            raise PermissionError("the repository is encrypted" if passphrase is None else "the repository isn't encrypted")
        if record:  # the key is a literal in plans, which are shown in event logs and the user interface
            spark.conf.set("spark.sql.redaction.string.regex", LONG_BINARY)
        self.key = self._unwrap(bytes(record.data).decode(), passphrase) if record else None

    # layout

    @staticmethod
    def init(spark: SparkSession, path: str, passphrase: str | None = None, protect: bool = False) -> Repository:
        """Makes an empty repository; one that is there already is an error. protect: every commit writes parity of its chunks' files."""
        self = object.__new__(Repository)
        self.spark, self.path, self.key = spark, path.rstrip("/"), None
        if self.exists():
            raise FileExistsError(path)
        for name, schema in (("chunks", model.CHUNKS), ("recipes", model.RECIPES), ("entries", model.ENTRIES), ("snapshots", model.SNAPSHOTS), ("enc_map", model.ENC_MAP)):
            spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")
        spark.createDataFrame([], model.RS_SEGMENTS).write.parquet(f"{self.path}/parity")
        self._append("metadata", [("format", _now(), b"1"), *([("parity", _now(), b"1")] if protect else [])], model.METADATA)
        if passphrase is not None:
            self._append("metadata", [("key", _now(), self._wrap(passphrase).encode())], model.METADATA)
        return Repository(spark, path, passphrase)

    def exists(self) -> bool:
        return durable.exists(importable(self.spark), f"{self.path}/metadata")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: list | DataFrame, schema: T.StructType) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema).coalesce(1)
        df.select(*schema.names).write.mode("append").parquet(f"{self.path}/{name}")

    def metadata(self) -> DataFrame:
        return self._table("metadata", model.METADATA)

    def chunks(self) -> DataFrame:
        return self._table("chunks", model.CHUNKS)

    def recipes(self) -> DataFrame:
        return self._table("recipes", model.RECIPES)

    def entries(self) -> DataFrame:
        return self._table("entries", model.ENTRIES)

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", model.SNAPSHOTS)

    # keys: wrapped by a key derived from the passphrase, on the driver only

    def _aes(self, f: str, data: bytes, key: bytes) -> bytes:
        one = self.spark.createDataFrame([(bytearray(data), bytearray(key))], "d binary, k binary")
        return bytes(one.select((encrypt if f == "e" else decrypt)(F.col("d"), F.col("k")).alias("x")).first().x)

    def _wrap(self, passphrase: str) -> str:
        salt, key = os.urandom(32), os.urandom(32)
        derived = hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ROUNDS, DERIVED)
        sealed = self._aes("e", key, derived[32:])
        return "\n".join(x.hex() for x in (salt, derived[:32], sealed[12:], sealed[:12]))

    def _unwrap(self, record: str, passphrase: str) -> bytes:
        salt, known, sealed, iv = (bytes.fromhex(x) for x in record.split("\n")[:4])
        derived = hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ROUNDS, DERIVED)
        if derived[:32] != known:
            raise PermissionError("wrong passphrase")
        return self._aes("d", iv + sealed, derived[32:])

    def _sealed(self, data: Column) -> Column:
        return encrypt(data, F.lit(self.key)) if self.key else data

    def _opened(self, data: Column) -> Column:
        return decrypt(data, F.lit(self.key)) if self.key else data

    # chunks

    def store_chunks(self, chunks: DataFrame) -> None:
        """Adds the chunks (hash, data) that aren't there; only these are compressed and encrypted."""
        new = store.new_chunks(chunks.select("hash", "data"), self.chunks())
        rows = new.select("hash", F.octet_length("data").cast("long").alias("raw_len"), F.lit(2 if self.key else 1).cast("tinyint").alias("codec"), self._sealed(compress("data")).alias("payload"))
        if not self.key:
            self._append("chunks", rows, model.CHUNKS)
            return
        # the cipher differs each time it is computed: written once, then both tables are made from what was written
        staged = durable.written(rows, "sealed")
        self._append("chunks", staged, model.CHUNKS)
        log = staged.select(F.col("hash").alias("plain"), hash_bytes("payload").alias("encrypted"), F.lit(int(_now().timestamp() * 1e6)).alias("written"))
        self._append("enc_map", log, model.ENC_MAP)

    def data(self) -> DataFrame:
        """(hash, data) of all chunks, opened."""
        return self._open(self.chunks())

    def _open(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("hash", decompress(self._opened(F.col("payload"))).alias("data"))

    def cat(self, hashes: list[str]) -> DataFrame:
        """Chunks by the hex form of their hashes; anything else is an error."""
        for h in hashes:
            if len(h) != 2 * model.HASH_BYTES or set(h.lower()) - set("0123456789abcdef"):
                raise ValueError(f"no hash: {h!r}")
        return self.data().where(F.col("hash").isin(*(bytearray.fromhex(h) for h in hashes)))

    # names

    def _name(self, name: str, data: bytes, at: dt.datetime) -> None:
        if self.metadata().where(F.col("name") == name).limit(1).count():
            raise FileExistsError(name)
        self._append("metadata", [(name, at, data)], model.METADATA)

    def resolve(self, prefix: str, exact: bool = False) -> T.Row:
        """The name and its data: this very name, or the newest that begins so."""
        found = metadata.latest(self.metadata(), prefix, exact).first()
        if found is None:
            raise KeyError(prefix)
        return found

    def list(self) -> DataFrame:
        return metadata.listing(self.metadata())

    # bit streams

    def save_bits(self, name: str, blocks: DataFrame, bits: int = model.SPLIT_BITS, at: dt.datetime | None = None) -> str:
        """Stores one stream of any size given as (block_no, data) rows, under name@time."""
        chunking.check_bits(bits)
        at = at or _now()
        cut = chunking.chunk_data(blocks.withColumn("object_id", F.lit("stream")), bits)
        found = self._stored(cut, bits).first()
        if found is None:
            raise ValueError("an empty stream has no identity")
        full = f"{metadata.BITS}{name}@{at:%Y%m%d%H%M%S}"
        self._protect()
        self._name(full, bytes.fromhex(found.id), at)
        return full

    def save_stream(self, name: str, stream: BinaryIO, bits: int = model.SPLIT_BITS, at: dt.datetime | None = None, block_bytes: int = BLOCK_BYTES, held: int = 8) -> str:
        """The same from an open stream on the driver, which holds `held` blocks at a time: they go to the shared folder first."""
        path, k = durable.scratch(self.spark, "stream"), 0
        schema = T.StructType([T.StructField("block_no", T.LongType()), T.StructField("data", T.BinaryType())])
        self.spark.createDataFrame([], schema).write.parquet(path)
        while blocks := _some(stream, block_bytes, held):
            self.spark.createDataFrame([(k + i, bytearray(x)) for i, x in enumerate(blocks)], schema).write.mode("append").parquet(path)
            k += len(blocks)
        return self.save_bits(name, self.spark.read.schema(schema).parquet(path), bits, at)

    def _stored(self, cut: DataFrame, bits: int, tall: bool = True) -> DataFrame:
        """Stores chunks (object_id, seq, offset, length, data) and recipes, and gives (object_id, id) of every object: its recipe's id.

        What was cut is written once to the shared folder, sealed if the repository is. tall: whether an object may have more
        chunks than a task holds hashes.
        """
        staged = durable.written(chunking.hashed(cut).withColumn("data", self._sealed(F.col("data"))), "cut")
        narrow = staged.drop("data")
        ids = (store.tall_roots if tall else store.merkle_roots)(narrow, bits)
        ids = durable.written(ids.select("object_id", F.lower(F.hex(store.merkle_bytes(F.col("hash"), F.col("level")))).alias("id")), "identities")
        self.store_chunks(staged.select("hash", self._opened(F.col("data")).alias("data")))
        new = narrow.join(ids, "object_id").select(F.col("id").alias("object_id"), "seq", "hash", "offset", "length", F.lit(bits).alias("bits")).dropDuplicates(["object_id", "seq"])
        self._append("recipes", new.join(self.recipes().select("object_id").distinct(), "object_id", "left_anti"), model.RECIPES)
        return ids

    def bits(self, name: str) -> DataFrame:
        """(seq, offset, length, piece) of the newest stream of that name; a missing or changed chunk is an error when it is read."""
        wire = bytes(self.resolve(metadata.BITS + name).data)
        found = self._pieces(self.recipes().where(F.col("object_id") == wire.hex()))
        if not self.recipes().where(F.col("object_id") == wire.hex()).limit(1).count():
            raise KeyError(f"{name}: its recipe is missing")
        lost = F.raise_error(F.lit(f"{name}: chunks are missing or changed")).cast("binary")
        return found.select("seq", "offset", "length", F.coalesce("piece", lost).alias("piece"))

    def write_bits(self, name: str, out: BinaryIO) -> int:
        """Writes the stream to an open file on the driver, part by part; how many bytes."""
        n = 0
        for r in self.bits(name).orderBy("seq").toLocalIterator():
            out.write(r.piece)
            n += r.length
        return n

    def restore_bits(self, name: str) -> bytes:
        """The newest stream of that name, where it fits the driver's memory."""
        out = io.BytesIO()
        self.write_bits(name, out)
        return out.getvalue()

    def _pieces(self, recipes: DataFrame) -> DataFrame:
        """The recipes' rows with each chunk's bytes as `piece`, null if it is missing or changed. Only chunks that these recipes
        need are read, and each is opened and verified once."""
        wanted = self.chunks().join(recipes.select("hash").distinct(), "hash", "left_semi")
        sound = wanted.select("hash", sound_chunk(self._opened(F.col("payload")), F.col("hash")).alias("data"))
        return store.pieces(recipes, sound)

    # snapshots

    def backup(self, name: str, files: DataFrame, base: str | None = None, bits: int = model.SPLIT_BITS, exclude: tuple[str, ...] = (), at: dt.datetime | None = None, blocks: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Stores a tree given as FILES. base: a snapshot whose unchanged files' content isn't read again.

        blocks: gives (path, block_no, data) of the paths in a frame, files of up to BLOCK_BYTES as one block, and is asked for
        what is new only (`files.read_blocks` of a tree); `content` isn't looked at then.  Without it contents are those of the
        column `content`.
        """
        chunking.check_bits(bits)
        at = at or _now()
        full = f"{name}@{at:%Y%m%d%H%M%S}"
        kept = files.where(~snapshots.excluded(F.col("path"), list(exclude))) if exclude else files
        current = snapshots.entries(kept)
        if snapshots.duplicate_paths(current).limit(1).count():
            raise ValueError("a path occurs twice")
        if self.metadata().where(F.col("name") == metadata.BACKUP + full).limit(1).count():
            raise FileExistsError(full)
        old = self.snapshot(base) if base else self.entries().where("false")
        plan = snapshots.incremental(current, old).withColumn("bits", snapshots.split_bits(F.col("name"), bits)).withColumn("keep", snapshots.storage_of(F.col("kind"), F.col("size")))
        plan = durable.written(plan, "plan")
        todo = plan.where("status <> 'unchanged'")
        if blocks is None:
            blocks = lambda paths: kept.join(paths.select("path"), "path", "left_semi").select("path", F.lit(0).cast("long").alias("block_no"), F.col("content").alias("data"))
            whole = F.lit(True)
        else:
            whole = F.col("size") <= BLOCK_BYTES
        objects = self.spark.createDataFrame([], "path string, object_id string")
        chunked = todo.where("keep = 'chunks'")
        for r in chunked.select("bits", whole.alias("whole")).distinct().collect():  # four at most
            mine = chunked.where((F.col("bits") == r.bits) & (whole == r.whole)).select("path")
            read = blocks(mine).withColumnRenamed("path", "object_id")
            cut = chunking.chunk(read, "object_id", "data", r.bits) if r.whole else chunking.chunk_data(read, r.bits)
            ids = self._stored(cut, r.bits, tall=not r.whole)
            objects = objects.unionByName(ids.select(F.col("object_id").alias("path"), F.col("id").alias("object_id")))
        inline = blocks(todo.where("keep = 'inline'").select("path")).select("path", F.col("data").alias("inline"))
        links = kept.where("kind = 'symlink'").select("path", F.col("target").cast("binary").alias("link"))
        reused = old.select("path", F.col("contents").alias("old_contents"), F.col("object_id").alias("old_object"))
        joined = plan.join(objects, "path", "left").join(inline, "path", "left").join(links, "path", "left").join(reused, "path", "left")
        same = F.col("status") == "unchanged"
        rows = joined.select(
            F.lit(full).alias("snapshot"), "path", "parent", "name", "kind", "mode", "mtime_ns", "size",
            F.when(same, F.col("old_contents")).otherwise(F.coalesce("inline", "link")).alias("contents"), F.when(same, F.col("old_object")).otherwise(F.col("object_id")).alias("object_id"),
        )
        self._append("entries", rows, model.ENTRIES)
        found = snapshots.root_digests(self._identified(self.entries().where(F.col("snapshot") == full))).first()
        root = bytes.fromhex(found.digest) if found else shake256(b"")
        self._append("snapshots", [(full, at, bytearray(root), 0)], model.SNAPSHOTS)
        self._protect()
        self._name(metadata.BACKUP + full, root, at)
        return full

    def _identified(self, entries: DataFrame) -> DataFrame:
        """Entries with the identity of what they hold."""
        return entries.withColumn("content_id", F.coalesce("object_id", F.lower(F.hex(hash_bytes("contents"))), F.lit("")))

    def snapshot(self, name: str) -> DataFrame:
        """The entries of the newest snapshot of that name."""
        found = self.resolve(metadata.BACKUP + name).name
        return self.entries().where(F.col("snapshot") == found.removeprefix(metadata.BACKUP))

    def _below(self, name: str, below: str) -> DataFrame:
        rows = self.snapshot(name)
        return rows.where((F.col("path") == below) | F.col("path").startswith(below.strip("/") + "/")) if below else rows

    def restore(self, name: str, below: str = "") -> DataFrame:
        """FILES of a snapshot, or of one of its paths with all that is below, for files that fit a cell; see `restore_tree`."""
        rows = self._below(name, below)
        wanted = self.recipes().join(rows.select("object_id").distinct(), "object_id", "left_semi")
        objects = self._pieces(wanted).groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("parts")).select("object_id", store.join_pieces("parts").alias("data"))
        joined = rows.join(objects, "object_id", "left")
        content = snapshots.contents(F.col("kind"), F.col("size"), F.col("contents"), F.col("data"))
        target = F.when(F.col("kind") == "symlink", F.col("contents").cast("string"))
        lost = (F.col("kind") == "file") & F.col("content").isNull()
        done = joined.select("path", "kind", "mode", "mtime_ns", "size", content.alias("content"), target.alias("target"))
        return done.withColumn("content", F.when(lost, F.raise_error(F.concat(F.lit("chunks are missing or changed: "), F.col("path"))).cast("binary")).otherwise(F.col("content")))

    def restored_pieces(self, name: str, below: str = "") -> DataFrame:
        """(path, mode, mtime_ns, seq, piece) of the regular files of a snapshot, of any size; what is lost is an error."""
        rows = self._below(name, below).where("kind = 'file'")
        held = rows.where("object_id is null").select("path", "mode", "mtime_ns", F.lit(0).cast("long").alias("seq"), F.coalesce("contents", F.when(F.col("size") == 0, F.lit(b""))).alias("piece"))
        recipes = self.recipes().join(rows.select("object_id").distinct(), "object_id", "left_semi")
        chunks = self._pieces(recipes).select("object_id", "seq", F.col("piece"), F.lit(True).alias("there"))
        cut = rows.where("object_id is not null").select("path", "mode", "mtime_ns", "object_id").join(chunks.hint("merge"), "object_id", "left").select("path", "mode", "mtime_ns", F.coalesce("seq", F.lit(0)).alias("seq"), "piece")
        lost = F.raise_error(F.concat(F.lit("chunks are missing or changed: "), F.col("path"))).cast("binary")
        return held.unionByName(cut).withColumn("piece", F.coalesce("piece", lost))

    def restore_tree(self, name: str, folder: str, below: str = "") -> int:
        """Writes a snapshot, or a part of it, below a new local folder; files of any size. Returns how many files and links."""
        rows = self._below(name, below)
        tree = rows.where("kind <> 'file'").select("path", "kind", "mode", "mtime_ns", "size", F.lit(None).cast("binary").alias("content"), F.when(F.col("kind") == "symlink", F.col("contents").cast("string")).alias("target"))
        return write_tree(tree, folder, self.restored_pieces(name, below))

    def paths(self) -> DataFrame:
        """Every path of every snapshot as a mounted tree shows it: name, year, month, day, time, then the path."""
        return self.entries().select(metadata.hierarchy(F.col("snapshot")).alias("at"), "*").select("at.*", *(c for c in model.ENTRIES.names if c not in ("snapshot", "name")))

    # integrity

    # packs

    def packs(self, limit: int = PACK_BYTES, writers: int = 64) -> DataFrame:
        """(pack, content, index): all stored chunks as pack and index files of at most so many bytes, to be kept or sent elsewhere.

        Chunks are dealt to writers by their hashes; each fills its packs one after another, and none of them holds more than a pack.
        """
        dealt = self.data().withColumn("writer", F.pmod(F.xxhash64("hash"), F.lit(writers)))
        places = store.assign_packs(self.chunks().select("hash", F.col("raw_len").alias("length"), F.pmod(F.xxhash64("hash"), F.lit(writers)).alias("writer")), ["hash"], "writer", limit)
        places = places.select("hash", F.format_string("%04d-%06d", "writer", "pack").alias("pack"))
        return store.encode_packs(dealt.select("hash", "data").join(places.hint("merge"), "hash"), order="hash")

    def export_packs(self, folder: str, limit: int = PACK_BYTES, writers: int = 64) -> int:
        """Writes them as packs/NAME.pack and indices/NAME.idx below a local folder, packs before indices; how many packs."""
        made = durable.written(self.packs(limit, writers), "packs")
        none, one = F.lit(None).cast("long"), F.lit(0).cast("long").alias("seq")
        file = lambda sub, end, column: made.select(F.concat(F.lit(f"{sub}/"), "pack", F.lit(end)).alias("path"), none.alias("mode"), none.alias("mtime_ns"), one, F.col(column).alias("piece"))
        n = write_pieces(file("packs", ".pack", "content"), folder)
        write_pieces(file("indices", ".idx", "index"), folder)
        return n

    def import_packs(self, folder: str) -> DataFrame:
        """Adds the chunks of pack files that indices name and that aren't there; gives the violations: blobs that no index names,
        and entries whose blob isn't there or has another hash.  Recipes and names aren't part of packs."""
        files = lambda sub, end: self.spark.read.format("binaryFile").option("pathGlobFilter", f"*{end}").load(f"{folder}/{sub}").select(F.regexp_extract("path", "([^/]*)[.][a-z]+$", 1).alias("pack"), "content")
        blobs = store.read_packs(files("packs", ".pack")).withColumn("hash", hash_bytes("data"))
        blobs = durable.written(blobs.withColumn("data", self._sealed(F.col("data"))), "blobs")
        index = durable.written(store.read_index(files("indices", ".idx"), index="content"), "index")
        sound = blobs.select("hash", self._opened(F.col("data")).alias("data")).join(index.select("hash").distinct(), "hash", "left_semi")
        self.store_chunks(sound)
        self._protect()
        lost = index.select(F.col("pack_name").alias("pack"), "offset", "hash").join(blobs.select("pack", "offset", "hash"), ["pack", "offset", "hash"], "left_anti")
        return verify.union(verify.orphans(blobs, index), lost.select(*verify.violation("missing", F.col("pack"), F.lower(F.hex("hash")))))

    def _files(self, content: bool) -> DataFrame:
        """The chunk table's files: file, and content if asked for."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/chunks")
        name = F.element_at(F.split("path", "/"), -1).alias("file")
        return found.select(name, "content") if content else found.select(name, "length")

    def _parity(self) -> DataFrame:
        return self._table("parity", model.RS_SEGMENTS)

    def protected(self) -> bool:
        return bool(self.metadata().where("name = 'parity'").limit(1).count())

    def _protect(self) -> None:
        """Parity of the files that have none yet."""
        if self.protected():
            new = self._files(content=True).join(self._parity().select("file").distinct(), "file", "left_anti")
            self._append("parity", parity.encode(new), model.RS_SEGMENTS)

    def repaired(self) -> DataFrame:
        """(file, seg, data, hashes, parity, bad) of the chunk table's files as they were; raises beyond repair."""
        return parity.restore(self._files(content=True), self._parity())

    def fsck_bytes(self) -> int:
        """What a check reads of the chunk table: bytes of its files, by their lengths."""
        return self._files(content=False).agg(F.sum("length")).first()[0] or 0

    def fsck(self, most_bytes: int | None = None) -> DataFrame:
        """All violations: changed, missing, doubled, unneeded and unmapped chunks, files that differ from their parity, broken
        recipes and identities that aren't those of their recipes, lost recipes, snapshots that aren't those of their entries,
        names that lead nowhere and names that are no pointers.

        most_bytes: a check that would read more chunk bytes is refused, as reading may cost.
        """
        if most_bytes is not None and (cost := self.fsck_bytes()) > most_bytes:
            raise PermissionError(f"a check reads {cost} bytes of chunks, {most_bytes} are allowed")
        recipes = self.recipes()
        backups = metadata.of_kind(self.metadata(), metadata.BACKUP)
        found = [
            verify.rehash(self.data()), verify.missing(recipes, self.chunks()), verify.unneeded(recipes, self.chunks()), verify.duplicates(self.chunks()), verify.recipe_gaps(recipes),
            verify.unknown_objects(self.entries(), recipes), verify.dangling(backups, self.snapshots()), verify.bad_pointers(backups),
        ]
        for r in recipes.select("bits").distinct().collect():  # eleven at most
            found.append(verify.identities(store.tall_roots(recipes.where(F.col("bits") == r.bits), r.bits)))
        named = self.snapshots().select(F.col("name").alias("snapshot"), F.lower(F.hex("root_hash")).alias("root"))
        empty = F.lit(shake256(b"").hex())
        digests = snapshots.root_digests(self._identified(self.entries()).join(named.select("snapshot"), "snapshot", "left_semi"))
        none = named.join(self.entries().select("snapshot").distinct(), "snapshot", "left_anti").select("snapshot", empty.alias("digest"))
        found.append(verify.roots(digests.unionByName(none), named))
        if self.key:
            enc = self._table("enc_map", model.ENC_MAP)
            found.append(verify.unmapped(enc, self.chunks().select(hash_bytes("payload").alias("hash"))))
        if self.protected():
            found.append(verify.damaged(parity.check(self._files(content=True), self._parity())))
        return verify.union(*found)


def _some(stream: BinaryIO, size: int, most: int) -> list[bytes]:
    out = []
    while len(out) < most and (data := stream.read(size)):
        out.append(data)
    return out


def _sound(payload: pa.Array, hash: pa.Array) -> pa.Array:
    out = []
    for x, h in zip(payload.to_pylist(), hash.to_pylist(), strict=True):
        try:
            data = None if x is None else unpack_gzip(x)
        except (ValueError, zlib.error):
            data = None
        out.append(data if data is not None and shake256(data) == h else None)
    return pa.array(out, pa.binary())


#: A chunk's bytes from its payload, null if they don't have the hash.
sound_chunk = F.arrow_udf(_sound, T.BinaryType())


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)
