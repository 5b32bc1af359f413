"""Snapshots of directory trees as flat entries; incremental plans; comparison; lookup."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.durable import written
from siltstone.functions.binary import hash_bytes
from siltstone.model import DIR_BIT, INCOMPRESSIBLE, INCOMPRESSIBLE_BITS, INLINE_BYTES, SPLIT_BITS, SYMLINK_BIT

KINDS = ("dir", "file", "symlink")


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(DIR_BIT)) != 0


def is_symlink(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(SYMLINK_BIT)) != 0


def is_file(mode: Column) -> Column:
    """Neither of the above nor a device, pipe, socket or the like."""
    other = DIR_BIT | SYMLINK_BIT | 1 << 26 | 1 << 25 | 1 << 24 | 1 << 21 | 1 << 19
    return mode.bitwiseAND(F.lit(other)) == 0


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every directory above the paths, once; the root is the empty path."""
    parts = F.split(parent_of(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return paths.select(F.explode(F.array_append(above, F.lit(""))).alias("path")).distinct()


def entries(files: DataFrame, mode_dir: int = DIR_BIT | 0o755) -> DataFrame:
    """Files with all their directories, as (path, parent, name, kind, mode, mtime_ns, size); other kinds are rejected."""
    own = files.where(F.col("kind").isin(*KINDS)).select("path", "kind", "mode", "mtime_ns", "size")
    made = directories(own).join(own.select("path"), "path", "left_anti").where("path <> ''").select("path", F.lit("dir").alias("kind"), F.lit(mode_dir).cast("long").alias("mode"), F.lit(None).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"))
    every = own.unionByName(made)
    return every.select("path", parent_of(F.col("path")).alias("parent"), base_name(F.col("path")).alias("name"), "kind", "mode", "mtime_ns", "size")


def rejects(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is a part of the whole path."""
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in patterns), F.lit(False))


def without_excluded(files: DataFrame, patterns: DataFrame, path: str = "path", pattern: str = "pattern") -> DataFrame:
    """The same with the patterns in a table, by equality: every path gives its parts of each length that patterns have.

    Null patterns and paths match nothing, the empty pattern matches every path.  The lengths, which are few, come to the
    driver; a path gives no more parts than these times its own length, and parts that are no pattern go before the paths
    meet.
    """
    known = patterns.select(F.col(pattern).alias("siltstone_part")).where("siltstone_part is not null").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("siltstone_part")).distinct().collect())
    if not lengths:
        return files
    every = [f"transform(sequence(1, length(siltstone_path) - {n} + 1), k -> substring(siltstone_path, k, {n}))" if n else "array('')" for n in lengths]
    guarded = [f"if(length(siltstone_path) >= {n}, {e}, cast(array() as array<string>))" for n, e in zip(lengths, every, strict=True)]
    paths = files.select(F.col(path).alias("siltstone_path")).where("siltstone_path is not null").distinct()
    parts = paths.select("siltstone_path", F.explode(F.expr(f"array_distinct(concat({', '.join(guarded)}))")).alias("siltstone_part"))
    hit = parts.join(known, "siltstone_part", "left_semi").select("siltstone_path").distinct()
    return files.join(hit, files[path] == hit["siltstone_path"], "left_anti")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def split_bits(name: Column, default: int = SPLIT_BITS) -> Column:
    """Larger chunks for what is compressed already."""
    return F.when(extension(name).isin(*INCOMPRESSIBLE), F.lit(INCOMPRESSIBLE_BITS)).otherwise(F.lit(default))


def storage_of(kind: Column, size: Column) -> Column:
    """How a file's content is kept: "none" (not a file), "empty", "inline" or "chunks"."""
    return F.when(kind != "file", "none").when(size == 0, "empty").when(size < INLINE_BYTES, "inline").otherwise("chunks")


def contents(kind: Column, size: Column, inline: Column, joined: Column) -> Column:
    """A file's bytes from wherever they are kept."""
    return F.when(kind != "file", F.lit(None).cast("binary")).when(size == 0, F.lit(b"")).otherwise(F.coalesce(inline, joined))


def incremental(current: DataFrame, base: DataFrame) -> DataFrame:
    """Adds `status` to the current entries: unchanged if path, mode, size and mtime are those of the base, else modified
    or added.  Only these columns take part, so content is read for the rest alone.  Directories are never reused."""
    old = base.select("path", F.col("mode").alias("old_mode"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.lit(True).alias("known"))
    joined = current.join(old, "path", "left")
    same = (F.col("kind") != "dir") & (F.col("mode") == F.col("old_mode")) & (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime"))
    status = F.when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("known"), "modified").otherwise("added")
    return joined.withColumn("status", status).select(*current.columns, "status")


def duplicate_paths(table: DataFrame) -> DataFrame:
    return table.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def compare(a: DataFrame, b: DataFrame, attributes: tuple[str, ...] = ("kind", "mode", "mtime_ns", "size", "digest")) -> DataFrame:
    """(path, difference) of all paths that differ: only_a, only_b, or the first attribute that does."""
    left = a.select("path", *(F.col(c).alias(f"a_{c}") for c in attributes), F.lit(1).alias("in_a"))
    right = b.select("path", *(F.col(c).alias(f"b_{c}") for c in attributes), F.lit(1).alias("in_b"))
    difference = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b")
    for c in attributes:
        difference = difference.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return left.join(right, "path", "full_outer").select("path", difference.alias("difference")).where("difference is not null")


def lookup(table: DataFrame, path: str) -> DataFrame:
    """The entry at a path; slashes at the ends and doubled ones don't matter."""
    return table.where(F.col("path") == "/".join(p for p in path.split("/") if p))


def children(table: DataFrame, directory: str) -> DataFrame:
    return table.where((F.col("parent") == directory) & (F.col("path") != "")).orderBy("name")


def attributes(table: DataFrame) -> DataFrame:
    """What a mounted tree shows: permission bits, the kind of each child itself, and a size for files only."""
    return table.select("path", "name", "kind", F.col("mode").bitwiseAND(F.lit(0o777)).alias("perm"), F.when(F.col("kind") == "file", F.col("size")).otherwise(F.lit(0)).alias("size"), "mtime_ns")


def rollup(table: DataFrame) -> DataFrame:
    """(path, n_files, bytes) below every directory, the root as the empty path."""
    parts = F.split("parent", "/")
    above = F.array_append(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.lit(""))
    return table.where("kind = 'file'").select("size", F.explode(F.array_distinct(above)).alias("path")).groupBy("path").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


# identities of trees


def own_text(children: Column | str = "") -> Column:
    """What an entry's digest is of: kind, mode, time, size, content and name; the name is last, as it may hold any sign."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = children if isinstance(children, Column) else F.coalesce("content_id", F.lit(children))
    return F.concat_ws("|", "kind", number("mode"), number("mtime_ns"), F.when(F.col("kind") == "dir", F.lit("0")).otherwise(number("size")), content, "name")


def tree_digests(table: DataFrame, by: str = "snapshot", hasher: Callable[[Column], Column] = hash_bytes) -> DataFrame:
    """(by, path, digest) of all entries and, with the empty path, of the root of each tree: hex digests, rolled up depth by depth.

    table: by, path, parent, name, kind, mode, mtime_ns, size and content_id, the identity of a file's or link's content.
    A directory's digest is of its own attributes and its children's digests, so any change of any entry changes the
    root.  The children of a directory are put together in 4,096 parts by their digests' first three signs, so that a
    directory of very many children isn't in one place.  There are as many rounds as the deepest path has parts.
    """
    shown = lambda text: F.lower(F.hex(hasher(text.cast("binary"))))
    rows = table.withColumn("depth", F.size(F.split("path", "/")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below, out = None, None
    for depth in range(deepest, 0, -1):
        mine = rows.where(F.col("depth") == depth)
        if below is not None:
            mine = mine.join(below, [by, "path"], "left")
        else:
            mine = mine.withColumn("children", F.lit(None).cast("string"))
        text = F.when(F.col("kind") == "dir", own_text(F.coalesce("children", F.lit("")))).otherwise(own_text())
        level = written(mine.select(by, "path", "parent", shown(text).alias("digest")), "digests")
        out = level if out is None else out.unionByName(level)
        parts = level.groupBy(by, "parent", F.substring("digest", 1, 3).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("digest")), "").alias("all"))
        parts = parts.select(by, "parent", F.struct("part", shown(F.col("all")).alias("digest")).alias("part"))
        joined = parts.groupBy(by, "parent").agg(F.sort_array(F.collect_list("part")).alias("parts"))
        below = joined.select(by, F.col("parent").alias("path"), shown(F.array_join(F.transform("parts", lambda p: p["digest"]), "")).alias("children"))
    if out is None:
        return table.select(by, "path", F.lit("").alias("digest"))
    return out.select(by, "path", "digest").unionByName(below.select(by, "path", F.col("children").alias("digest")))


def root_digests(table: DataFrame, by: str = "snapshot", hasher: Callable[[Column], Column] = hash_bytes) -> DataFrame:
    """(by, digest) of every tree."""
    return tree_digests(table, by, hasher).where("path = ''").select(by, "digest")
