"""Directory trees as tables: Spark's own binary source, and a source that also knows modes and symbolic links."""

from __future__ import annotations

import os
import stat as st
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.model import DIR_BIT, FILES, SYMLINK_BIT
from siltstone.session import importable

#: Of a file's blocks; a file up to this size is one block.
BLOCK_BYTES = 8 << 20


def listing(spark: SparkSession, folder: str, prefix: str = "", hide: str = ".rs") -> DataFrame:
    """(name, length, modified) of the files below a folder of any file system, by prefix, parity files hidden."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    name = F.expr(f"substring(path, length('{root}') + 2)")
    return found.select(name.alias("name"), "length", "modified").where(F.col("name").startswith(prefix) & ~F.col("name").endswith(hide)).orderBy("name")


def read_range(files: DataFrame, offset: int, length: int, content: str = "content") -> DataFrame:
    """Adds `part`: the bytes from an offset on, length 0 for all that follow."""
    end = F.octet_length(content) if length == 0 else F.lit(length)
    return files.withColumn("part", F.substring(F.col(content), F.lit(offset + 1), end))


def read_tree(spark: SparkSession, folder: str, content: bool = True, split_above: int = 4096) -> DataFrame:
    """FILES of a local tree, links and modes included, read by a Python data source, so many entries of a directory to a partition.

    Without content no file is opened: what is to be read then is read by `read_blocks`.
    """
    importable(spark).dataSource.register(TreeSource)
    return spark.read.format("siltstone_tree").option("path", folder).option("content", str(content).lower()).option("split_above", split_above).load()


def read_blocks(paths: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block_no, data) of the files at paths below a local folder; a file of any size, and only these are opened."""
    importable(paths.sparkSession)
    schema = "path string, block_no long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block_no", "data"]
        for b in batches:
            for path in b.column("path").to_pylist():
                with open(os.path.join(folder, path), "rb") as f:
                    k, data = 0, f.read(block_bytes)
                    while data or not k:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names)
                        k, data = k + 1, f.read(block_bytes)

    return paths.select("path").mapInArrow(run, schema)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_tree"

    def schema(self):  # noqa: ANN201
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TreeReader(self.options["path"], self.options.get("content", "true") == "true", int(self.options.get("split_above", "4096")))


class Part(InputPartition):
    """Some of the entries of a directory."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class TreeReader(DataSourceReader):
    """Lists the directories on the driver; attributes and contents are read where Spark runs the partition."""

    def __init__(self, root: str, content: bool, split_above: int = 4096):
        self.root, self.content, self.split_above = root, content, split_above

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        out = []
        for d, dirs, names in os.walk(self.root):
            every = sorted([*dirs, *names])
            out += [Part(os.path.relpath(d, self.root), every[k : k + self.split_above]) for k in range(0, len(every), self.split_above)]
        return out or [Part(".", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        folder = os.path.normpath(os.path.join(self.root, partition.folder))
        for name in partition.names:
            path = os.path.join(folder, name)
            info = os.lstat(path)
            kind = "symlink" if st.S_ISLNK(info.st_mode) else "dir" if st.S_ISDIR(info.st_mode) else "file" if st.S_ISREG(info.st_mode) else "other"
            mode = st.S_IMODE(info.st_mode) & 0o777 | {"dir": DIR_BIT, "symlink": SYMLINK_BIT}.get(kind, 0)
            data = None
            if kind == "file" and self.content:
                with open(path, "rb") as f:
                    data = f.read()
            yield os.path.relpath(path, self.root), kind, mode, info.st_mtime_ns, info.st_size if kind == "file" else 0, data, os.readlink(path) if kind == "symlink" else None


def write_pieces(pieces: DataFrame, folder: str) -> int:
    """Writes files below a folder from (path, mode, mtime_ns, seq, piece): a file's pieces in the order of seq, of any number and
    size in all; each file by one task, aside and then renamed, as a task that is run again finds its former file.  A null mode or
    time is left as it comes.  Returns how many files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, f, aside = None, 0, None, None

        def close() -> None:
            f.close()
            path, mode, mtime = now
            where = os.path.join(folder, path)
            if mode is not None:
                os.chmod(aside, int(mode) & 0o777)
            if mtime is not None:
                os.utime(aside, ns=(int(mtime), int(mtime)))
            os.replace(aside, where)

        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in ("path", "mode", "mtime_ns", "piece")), strict=True):
                if now is None or key[0] != now[0]:
                    if now is not None:
                        close()
                    now, n = key[:3], n + 1
                    where = os.path.join(folder, key[0])
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    aside = f"{where}.{os.getpid()}.part"
                    f = open(aside, "wb")  # noqa: SIM115
                f.write(key[3] or b"")
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    importable(pieces.sparkSession)
    rows = pieces.select("path", "mode", "mtime_ns", "seq", "piece").repartition("path").sortWithinPartitions("path", "seq")
    return rows.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first().n or 0


def write_links(links: DataFrame, folder: str) -> int:
    """Makes symbolic links from (path, target)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, target in zip(b.column("path").to_pylist(), b.column("target").to_pylist(), strict=True):
                where = os.path.join(folder, path)
                os.makedirs(os.path.dirname(where), exist_ok=True)
                aside = f"{where}.{os.getpid()}.part"
                if os.path.islink(aside):
                    os.unlink(aside)
                os.symlink(target, aside)
                os.replace(aside, where)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return links.select("path", "target").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first().n or 0


def write_tree(files: DataFrame, folder: str, pieces: DataFrame | None = None) -> int:
    """Writes a tree below a new local folder (shared by the executors, or one machine): directories, then files and links,
    then the directories' own modes and times. Returns how many files and links were written.

    files: FILES; with pieces, (path, mode, mtime_ns, seq, piece) of all regular files, contents are taken from these.
    """
    if os.path.exists(folder):
        raise FileExistsError(folder)
    os.makedirs(folder)
    dirs = files.where("kind = 'dir'").select("path", "mode", "mtime_ns")
    for d in dirs.orderBy("path").toLocalIterator():
        os.makedirs(os.path.join(folder, d.path), exist_ok=True)
    own = files.where("kind = 'file'").select("path", "mode", "mtime_ns", F.lit(0).cast("long").alias("seq"), F.col("content").alias("piece")) if pieces is None else pieces
    n = write_pieces(own, folder) + write_links(files.where("kind = 'symlink'"), folder)
    for d in dirs.orderBy(F.desc("path")).toLocalIterator():
        where = os.path.join(folder, d.path)
        os.chmod(where, int(d.mode) & 0o777)
        if d.mtime_ns is not None:
            os.utime(where, ns=(int(d.mtime_ns), int(d.mtime_ns)))
    return n
