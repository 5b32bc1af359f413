"""Command line: python -m siltstone.cli COMMAND ... on a repository's folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from siltstone.model import RS_DATA, RS_SHARD, SPLIT_BITS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description="Deduplicated, versioned snapshots of directory trees and byte streams, on Spark.")
    p.add_argument("--repository", default=os.environ.get("SILTSTONE_DIR"), help="folder of the repository (or SILTSTONE_DIR)")
    p.add_argument("--passphrase", default=os.environ.get("SILTSTONE_PASSPHRASE"), help="of an encrypted repository (or SILTSTONE_PASSPHRASE)")
    c = p.add_subparsers(dest="command", required=True)
    i = c.add_parser("init", help="make an empty repository, encrypted if a passphrase is given")
    i.add_argument("--parity", action="store_true", help="write parity of the chunks' files with every commit")
    b = c.add_parser("backup", help="store a directory tree")
    b.add_argument("--base", help="a snapshot whose unchanged files aren't read again")
    b.add_argument("--split-bits", type=int, default=SPLIT_BITS)
    b.add_argument("--exclude", action="append", default=[])
    b.add_argument("name")
    b.add_argument("directory")
    c.add_parser("list", help="snapshots and bit streams")
    r = c.add_parser("restore", help="write a snapshot to a new folder")
    r.add_argument("name")
    r.add_argument("directory")
    k = c.add_parser("cat", help="print chunks")
    k.add_argument("hash", nargs="+")
    f = c.add_parser("fsck", help="check everything; exits with the number of violations")
    f.add_argument("--most-bytes", type=int, help="refuse a check that would read more bytes of chunks")
    s = c.add_parser("savebits", help="store standard input")
    s.add_argument("--split-bits", type=int, default=SPLIT_BITS)
    s.add_argument("name")
    t = c.add_parser("restorebits", help="print a bit stream")
    t.add_argument("name")
    m = c.add_parser("paths", help="what a mounted repository would show")
    m.add_argument("prefix", nargs="?", default="")
    for name, text in (("rs-encode", "write parity of files"), ("rs-check", "compare files with their parity"), ("rs-restore", "write repaired files")):
        q = c.add_parser(name, help=text)
        q.add_argument("files", help="folder of files")
        q.add_argument("parity", help="Parquet table of the parity")
        if name == "rs-restore":
            q.add_argument("directory")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from pyspark.sql import functions as F

    from siltstone import durable
    from siltstone.operators import parity, verify
    from siltstone.sources.files import read_blocks, read_tree, write_pieces
    from siltstone.sources.repository import Repository

    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = sys.stdout.buffer
    if a.command.startswith("rs-"):
        paths = read_tree(spark, a.files, content=False).where("kind = 'file' and size > 0").select("path")
        cut = read_blocks(paths, a.files, RS_DATA * RS_SHARD).select(F.col("path").alias("file"), F.col("block_no").alias("seg"), "data")
        if a.command == "rs-encode":
            parity.encode_segments(cut).write.parquet(a.parity)
            return 0
        table = spark.read.parquet(a.parity)
        if a.command == "rs-check":
            bad = parity.check_segments(cut, table).collect()
            for r in bad:
                print(f"{r.file}: {r.kind} segment {r.seg} shard {r.shard}", file=sys.stderr)
            return min(255, len(bad))
        os.makedirs(a.directory)
        none = F.lit(None).cast("long")
        write_pieces(parity.restore_segments(cut, table).select(F.col("file").alias("path"), none.alias("mode"), none.alias("mtime_ns"), F.col("seg").alias("seq"), F.col("data").alias("piece")), a.directory)
        return 0
    if not a.repository:
        raise SystemExit("no repository: give --repository or set SILTSTONE_DIR")
    if a.command == "init":
        Repository.init(spark, a.repository, a.passphrase, a.parity)
        return 0
    repo = Repository(spark, a.repository, a.passphrase)
    if a.command == "backup":
        tree = read_tree(spark, a.directory, content=False)
        print(repo.backup(a.name, tree, a.base, a.split_bits, tuple(a.exclude), blocks=lambda paths: read_blocks(paths, a.directory)))
    elif a.command == "list":
        rows = repo.list().collect()
        for kind, title in (("backup", "backups"), ("bits", "bitstreams")):
            mine = [r for r in rows if r.kind == kind]
            if mine:
                print(f"Total of {len(mine)} {title}:")
                for r in mine:
                    print(f"  {r.name:<30} {r.created}")
    elif a.command == "restore":
        repo.restore_tree(a.name, a.directory)
    elif a.command == "cat":
        for r in repo.cat(a.hash).collect():
            out.write(r.data)
    elif a.command == "fsck":
        found = durable.written(repo.fsck(a.most_bytes), "violations")
        for r in found.toLocalIterator():
            print(f"{r.check}: {r.object} {r.detail}", file=sys.stderr)
        return verify.exit_code(found)
    elif a.command == "savebits":
        print(repo.save_stream(a.name, sys.stdin.buffer, a.split_bits))
    elif a.command == "restorebits":
        repo.write_bits(a.name, out)
    elif a.command == "paths":
        for r in repo.paths().where(F.col("path").startswith(a.prefix)).orderBy("name", "year", "month", "day", "time", "path").toLocalIterator():
            print("/".join([r.name, r.year, r.month, r.day, r.time, r.path]))
    out.flush()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
