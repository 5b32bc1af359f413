"""Schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"binary": T.BinaryType(), "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "timestamp": T.TimestampNTZType(), "binaries": T.ArrayType(T.BinaryType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CHUNKS = _schema("hash:binary raw_len:long codec:byte payload:binary")
CHUNK_INDEX = _schema("hash:binary pack_name:string offset:long length:long")
RECIPES = _schema("object_id:string seq:long hash:binary offset:long length:long bits:int")
ENTRIES = _schema("snapshot:string path:string parent:string name:string kind:string mode:long mtime_ns:long size:long contents:binary object_id:string")
SNAPSHOTS = _schema("name:string created:timestamp root_hash:binary root_level:byte")
METADATA = _schema("name:string created:timestamp data:binary")
ENC_MAP = _schema("plain:binary encrypted:binary written:long")
RS_SEGMENTS = _schema("file:string seg:long hashes:binaries parity:binaries")
VIOLATIONS = _schema("check:string object:string detail:string")
FILES = _schema("path:string kind:string mode:long mtime_ns:long size:long content:binary target:string")

# Fixed values of the data model.
HASH_BYTES = 32
INLINE_BYTES = 8192
SPLIT_BITS = 14
INCOMPRESSIBLE_BITS = 18
MIN_SPLIT_BITS, MAX_SPLIT_BITS = 8, 18
MIN_CHUNK = 512
WINDOW = 64
MAX_LEVEL = 10
DIR_BIT, SYMLINK_BIT = 1 << 31, 1 << 27
BLOB_MAGIC, INDEX_MAGIC = b"BL0B", b"Idx2"
DISK_PACK_BYTES, BUCKET_PACK_BYTES = 4 << 30, 512 << 20
RS_DATA, RS_PARITY, RS_SHARD = 17, 3, 1 << 20
#: File extensions whose content is compressed already, so that chunks are rarely shared.
INCOMPRESSIBLE = ("arw", "avi", "flv", "gif", "gz", "jpeg", "jpg", "mkv", "mov", "mp4", "mpeg", "mpg", "nef", "png", "raw", "wmv", "zip")
