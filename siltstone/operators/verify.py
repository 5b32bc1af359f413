"""Integrity checks; each gives violations (check, object, detail), and a check is the union of what it asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.binary import hash_bytes, hex_of
from siltstone.model import HASH_BYTES
from siltstone.operators.store import merkle_bytes


def violation(check: str, object: Column, detail: Column | None = None) -> list[Column]:
    return [F.lit(check).alias("check"), object.cast("string").alias("object"), (F.lit("") if detail is None else detail).alias("detail")]


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def rehash(chunks: DataFrame, hash: str = "hash", data: str = "data", hasher=hash_bytes) -> DataFrame:  # noqa: ANN001
    """Chunks whose bytes no longer have their hash."""
    return chunks.where(~hasher(F.col(data)).eqNullSafe(F.col(hash))).select(*violation("rehash", hex_of(F.col(hash))))


def orphans(pack_hashes: DataFrame, index: DataFrame, hash: str = "hash") -> DataFrame:
    """Blobs in packs that no index entry names."""
    return pack_hashes.select(hash).distinct().join(index.select(hash), hash, "left_anti").select(*violation("orphan", hex_of(F.col(hash))))


def missing(recipes: DataFrame, index: DataFrame, key: str = "object_id", hash: str = "hash") -> DataFrame:
    """Hashes that recipes need and the index hasn't (leaves too; a check of interior nodes takes these as recipes)."""
    needed = recipes.select(key, hash).distinct()
    return needed.join(index.select(hash), hash, "left_anti").select(*violation("missing", F.col(key), hex_of(F.col(hash))))


def unknown_objects(entries: DataFrame, recipes: DataFrame) -> DataFrame:
    """Entries whose content is in chunks, but that have no recipe."""
    want = entries.where("object_id is not null").select("path", "object_id")
    return want.join(recipes.select("object_id").distinct(), "object_id", "left_anti").select(*violation("no_recipe", F.col("path"), F.col("object_id")))


def duplicates(index: DataFrame, hash: str = "hash") -> DataFrame:
    return index.groupBy(hash).agg(F.count("*").alias("n")).where("n > 1").select(*violation("duplicate", hex_of(F.col(hash)), F.col("n").cast("string")))


def recipe_gaps(recipes: DataFrame, key: str = "object_id") -> DataFrame:
    """Objects whose recipe isn't numbered from 0 without gaps, or whose chunks don't follow one another."""
    shape = recipes.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("last"), F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("end"))
    bad = shape.where("d <> n or last <> n - 1 or bytes <> end")
    return bad.select(*violation("recipe", F.col(key), F.concat_ws("/", F.col("n").cast("string"), F.col("last").cast("string"))))


def unmapped(enc_map: DataFrame, index: DataFrame) -> DataFrame:
    """Encrypted hashes of the map that aren't stored."""
    return enc_map.select(F.col("encrypted").alias("hash")).distinct().join(index.select("hash"), "hash", "left_anti").select(*violation("unmapped", hex_of(F.col("hash"))))


def dangling(pointers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Names whose root isn't there."""
    return pointers.join(snapshots.select(F.col("root_hash").alias("data")), "data", "left_anti").select(*violation("dangling", F.col("name")))


def bad_pointers(pointers: DataFrame) -> DataFrame:
    """Names whose data is not one hash."""
    return pointers.where(~F.coalesce(F.octet_length("data") == HASH_BYTES, F.lit(False))).select(*violation("pointer", F.col("name")))


def unneeded(recipes: DataFrame, index: DataFrame, hash: str = "hash") -> DataFrame:
    """Stored chunks that no recipe needs, as an interrupted run leaves them."""
    return index.select(hash).distinct().join(recipes.select(hash), hash, "left_anti").select(*violation("orphan", hex_of(F.col(hash))))


def identities(rebuilt: DataFrame, key: str = "object_id") -> DataFrame:
    """Objects whose identity isn't that of their recipe. rebuilt: (key, hash, level) of the recipes' roots."""
    found = hex_of(merkle_bytes(F.col("hash"), F.col("level")))
    return rebuilt.where(found != F.col(key)).select(*violation("identity", F.col(key), found))


def roots(digests: DataFrame, snapshots: DataFrame, by: str = "snapshot") -> DataFrame:
    """Snapshots whose root isn't that of their entries (by, digest); name and root of snapshots as (by, root), in hex."""
    met = snapshots.select(by, "root").join(digests.select(by, "digest"), by, "left")
    return met.where(~F.col("root").eqNullSafe(F.coalesce("digest", F.lit("")))).select(*violation("root", F.col(by)))


def damaged(checked: DataFrame) -> DataFrame:
    """What `parity.check` found, as violations."""
    return checked.select(*violation("parity", F.col("file"), F.concat_ws("/", "kind", F.col("seg").cast("string"), F.col("shard").cast("string"))))


def exit_code(violations: DataFrame) -> int:
    """The number of violations, as a process can return it."""
    return min(255, violations.count())
