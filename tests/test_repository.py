import datetime as dt
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions.binary import shake256
from siltstone.operators import chunking, metadata, parity, snapshots, store, verify
from siltstone.sources import repository
from siltstone.sources.files import BLOCK_BYTES, listing, read_blocks, read_tree, write_tree
from siltstone.sources.repository import Repository

AT = dt.datetime(2024, 5, 6, 7, 8, 9)


def make_tree(root, seed=1):
    rng = np.random.default_rng(seed)
    root.mkdir()
    for name, n in (("a.txt", 0), ("b.bin", 100), ("big.bin", 60_000), ("sub/c.jpg", 30_000), ("sub/deep/d", 9000), ("sub/deep/e", 10)):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rng.integers(0, 256, n, np.uint8).tobytes())
        os.utime(path, ns=(10**18 + n, 10**18 + n))
    (root / "empty").mkdir()
    (root / "link").symlink_to("b.bin")
    (root / "sub/deep/d").chmod(0o600)


def state(root):
    out = {}
    for folder, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            p = os.path.join(folder, n)
            info, rel = os.lstat(p), os.path.relpath(p, root)
            if os.path.islink(p):
                out[rel] = ("symlink", os.readlink(p))
            elif os.path.isdir(p):
                out[rel] = ("dir", info.st_mode & 0o777)
            else:
                out[rel] = ("file", info.st_mode & 0o777, info.st_mtime_ns, open(p, "rb").read())
    return out


@pytest.mark.parametrize("passphrase", [None, "open sesame"])
def test_backup_and_restore(spark, tmp_path, passphrase):
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"), passphrase)
    name = repo.backup("home", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT)
    assert name == "home@20240506070809"
    files, first = repo.restore("home"), repo.chunks().count()
    write_tree(files, str(tmp_path / "out"))
    assert state(tmp_path / "out") == state(tmp_path / "src")
    assert repo.fsck().count() == 0
    # the same again stores nothing; a change stores little and is found by the base's entries
    with pytest.raises(FileExistsError):
        repo.backup("home", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT)
    (tmp_path / "src/big.bin").write_bytes((tmp_path / "src/big.bin").read_bytes()[:50_000] + b"new end")
    (tmp_path / "src/b.bin").unlink()
    second = repo.backup("home", read_tree(spark, str(tmp_path / "src")), base="home", bits=10, at=AT + dt.timedelta(hours=1))
    assert first < repo.chunks().count() <= first + 6
    assert repo.resolve("backup-home").name == "backup-" + second
    write_tree(repo.restore("home"), str(tmp_path / "out2"))
    assert state(tmp_path / "out2") == state(tmp_path / "src")
    assert {r.path for r in repo.restore(name, "sub").collect()} == {"sub", "sub/c.jpg", "sub/deep", "sub/deep/d", "sub/deep/e"}
    assert [r.name for r in repo.list().collect()] == [name, second]
    assert repo.paths().select("year", "month", "day", "time").distinct().count() == 2
    assert repo.fsck().count() == 0
    opened = Repository(spark, str(tmp_path / "repo"), passphrase)
    assert opened.key == repo.key
    if passphrase:  # plans are shown without the key
        for shown in (opened.data()._sc._jvm.PythonSQLUtils.explainString(opened.data()._jdf.queryExecution(), m) for m in ("simple", "extended", "formatted")):
            assert opened.key.hex() not in shown.lower() and "redacted" in shown
    with pytest.raises(PermissionError):
        Repository(spark, str(tmp_path / "repo"), "wrong" if passphrase else "any")


def test_streams_of_bits(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "r"))
    data = np.random.default_rng(5).integers(0, 256, 100_000, np.uint8).tobytes()
    blocks = spark.createDataFrame([(k, bytearray(data[k * 9999 : (k + 1) * 9999])) for k in range(11)], "block_no long, data binary")
    assert repo.save_bits("tape", blocks, 10, AT) == "bits-tape@20240506070809"
    assert repo.save_bits("high", blocks, 16, AT) == "bits-high@20240506070809" and repo.restore_bits("high") == data
    assert repo.restore_bits("tape") == data
    n = repo.chunks().count()
    repo.save_bits("tape", blocks, 10, AT + dt.timedelta(seconds=1))
    assert repo.chunks().count() == n and repo.restore_bits("tape") == data and repo.fsck().count() == 0
    with pytest.raises(ValueError):
        repo.save_bits("none", blocks.where("false"), 10, AT)
    h = repo.chunks().select(F.lower(F.hex("hash")).alias("h")).first().h
    assert repo.cat([h]).count() == 1
    for bad in ("xyz", h[:-1], "g" * 64):
        with pytest.raises(ValueError):
            repo.cat([bad])


def test_damage_is_found(spark, tmp_path):
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"))
    repo.backup("x", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT)
    rows = repo.chunks().orderBy("hash").collect()
    changed = [r.asDict() | ({"payload": bytearray(b"\0tampered")} if k == 0 else {}) for k, r in enumerate(rows) if k != 1]
    spark.createDataFrame(changed, repo.chunks().schema).write.mode("overwrite").parquet(str(tmp_path / "repo2/chunks"))
    for t in ("recipes", "entries", "snapshots", "metadata", "enc_map", "parity"):
        spark.read.parquet(str(tmp_path / "repo" / t)).write.parquet(str(tmp_path / "repo2" / t))
    broken = Repository(spark, str(tmp_path / "repo2"))
    assert {r.check for r in broken.fsck().collect()} == {"rehash", "missing"}
    with pytest.raises(Exception, match="missing or changed"):
        broken.restore("x").collect()


def test_a_crash_before_the_name_leaves_no_snapshot(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"))
    monkeypatch.setattr(Repository, "_name", lambda *a: (_ for _ in ()).throw(OSError("power cut")))
    with pytest.raises(OSError):
        repo.backup("x", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT)
    monkeypatch.undo()
    assert repo.list().count() == 0
    with pytest.raises(KeyError):
        repo.restore("x")
    n = repo.chunks().count()
    repo.backup("x", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT + dt.timedelta(seconds=1))
    assert repo.chunks().count() == n
    write_tree(repo.restore("x"), str(tmp_path / "out"))
    assert state(tmp_path / "out") == state(tmp_path / "src")


def tree(spark, root, block_bytes=BLOCK_BYTES):
    return {"files": read_tree(spark, str(root), content=False), "blocks": lambda paths: read_blocks(paths, str(root), block_bytes)}


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    """Other bytes under the same size and time: an incremental backup that read them would store them. Large files come in blocks."""
    monkeypatch.setattr(repository, "BLOCK_BYTES", 10_000)
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"))
    repo.backup("x", **tree(spark, tmp_path / "src", 10_000), bits=10, at=AT)
    want = state(tmp_path / "src")
    for name in ("big.bin", "b.bin", "sub/c.jpg"):
        path = tmp_path / "src" / name
        before = os.stat(path)
        path.write_bytes(bytes(before.st_size))
        os.utime(path, ns=(before.st_atime_ns, before.st_mtime_ns))
    (tmp_path / "src/new").write_bytes(b"new" * 5000)
    repo.backup("x", **tree(spark, tmp_path / "src"), base="x", bits=10, at=AT + dt.timedelta(1))
    assert repo.restore_tree("x", str(tmp_path / "out")) == 8
    got = state(tmp_path / "out")
    assert got.pop("new")[3] == b"new" * 5000 and got == want and repo.fsck().count() == 0
    repo.restore_tree("x", str(tmp_path / "part"), "sub/deep")
    assert set(state(tmp_path / "part")) == {"sub", "sub/deep", "sub/deep/d", "sub/deep/e"}


def test_only_needed_chunks_are_opened_and_once(spark, tmp_path):
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"))
    repo.backup("x", **tree(spark, tmp_path / "src"), bits=10, at=AT)
    plan = repo._pieces(repo.recipes())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "LeftSemi" in plan and plan.index("ArrowEvalPython") < plan.index("LeftSemi") and "SortMergeJoin" in plan.split("ArrowEvalPython")[0]
    assert repo.fsck_bytes() > 0
    with pytest.raises(PermissionError):
        repo.fsck(most_bytes=10)


def test_roots_follow_from_content(spark, tmp_path):
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"))
    root = lambda name: bytes(repo.snapshots().where(F.col("name") == name).first().root_hash)
    one = root(repo.backup("x", **tree(spark, tmp_path / "src"), bits=10, at=AT))
    assert root(repo.backup("y", read_tree(spark, str(tmp_path / "src")), bits=10, at=AT)) == one
    (tmp_path / "src/sub/deep/e").chmod(0o640)
    assert root(repo.backup("x", **tree(spark, tmp_path / "src"), base="x", bits=10, at=AT + dt.timedelta(1))) != one
    # changed rows are found: an entry's time, an object's order, a name that points nowhere
    rows = {t: [r.asDict() for r in repo._table(t, s).collect()] for t, s in (("entries", model.ENTRIES), ("recipes", model.RECIPES), ("metadata", model.METADATA))}
    first = next(r for r in rows["entries"] if r["path"] == "b.bin" and r["snapshot"].startswith("y"))
    first["mtime_ns"] += 1
    many = [r for r in rows["recipes"] if r["object_id"] == rows["recipes"][0]["object_id"]]
    many = max((([r for r in rows["recipes"] if r["object_id"] == i]) for i in {r["object_id"] for r in rows["recipes"]}), key=len)
    many[0]["hash"], many[1]["hash"] = many[1]["hash"], many[0]["hash"]
    rows["metadata"].append({"name": "backup-z@1", "created": AT, "data": bytearray(b"short")})
    for t in ("chunks", "snapshots", "enc_map", "parity"):
        spark.read.parquet(str(tmp_path / "repo" / t)).write.parquet(str(tmp_path / "repo2" / t))
    for t, s in (("entries", model.ENTRIES), ("recipes", model.RECIPES), ("metadata", model.METADATA)):
        spark.createDataFrame(rows[t], s).write.parquet(str(tmp_path / "repo2" / t))
    found = {(r.check, r.object) for r in Repository(spark, str(tmp_path / "repo2")).fsck().collect()}
    assert found == {("root", first["snapshot"]), ("identity", many[0]["object_id"]), ("pointer", "backup-z@1"), ("dangling", "backup-z@1")}


def test_what_an_interrupted_run_leaves_is_told(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "repo"))
    repo.store_chunks(spark.createDataFrame([(bytearray(shake256(b"lost")), bytearray(b"lost"))], "hash binary, data binary"))
    assert [r.check for r in repo.fsck().collect()] == ["orphan"]


def test_parity_with_commits(spark, tmp_path):
    """Files of the chunk table that are hurt are told by their parity and come back from it."""
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"), protect=True)
    repo.backup("x", **tree(spark, tmp_path / "src"), bits=10, at=AT)
    repo.backup("x", **tree(spark, tmp_path / "src"), bits=11, at=AT + dt.timedelta(1))
    assert repo.fsck().count() == 0 and repo._parity().select("file").distinct().count() == repo._files(False).count()
    path = max((tmp_path / "repo/chunks").glob("*.parquet"), key=lambda p: p.stat().st_size)
    good = path.read_bytes()
    path.write_bytes(good[:5000] + b"???" + good[5003:])
    for crc in (tmp_path / "repo/chunks").glob(".*.crc"):
        crc.unlink()
    bad = verify.damaged(parity.check(repo._files(True), repo._parity())).collect()
    assert [(r.check, r.object) for r in bad] == [("parity", path.name)]
    back = repo.repaired().where(F.col("file") == path.name).orderBy("seg").collect()
    assert b"".join(bytes(r.data) for r in back) == good


@pytest.mark.parametrize("passphrase", [None, "s"])
def test_packs_out_and_in(spark, tmp_path, passphrase):
    """All chunks as pack and index files; what another repository takes from them, and what it says of broken ones."""
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, str(tmp_path / "repo"), passphrase)
    repo.backup("x", **tree(spark, tmp_path / "src"), bits=9, at=AT)
    n = repo.export_packs(str(tmp_path / "p"), limit=31_000, writers=2)
    files = sorted((tmp_path / "p/packs").glob("*.pack"))
    assert n == len(files) == len(list((tmp_path / "p/indices").glob("*.idx"))) > 3 and all(f.stat().st_size <= 31_016 for f in files)
    other = Repository.init(spark, str(tmp_path / "other"))
    assert other.import_packs(str(tmp_path / "p")).count() == 0
    data = lambda r: sorted((bytes(x.hash), bytes(x.data)) for x in r.data().collect())
    assert data(other) == data(repo) and other.import_packs(str(tmp_path / "p")).count() == 0 and data(other) == data(repo)
    good = files[0].read_bytes()
    files[0].write_bytes(good[:-3] + b"???")
    (tmp_path / "p/indices" / files[1].with_suffix(".idx").name).unlink()
    third = Repository.init(spark, str(tmp_path / "third"))
    found = [r.check for r in third.import_packs(str(tmp_path / "p")).collect()]
    assert found.count("missing") == 1 and found.count("orphan") > 1 and len(data(third)) == len(data(repo)) - found.count("orphan")


def test_streams_in_parts(spark, tmp_path):
    """Read and written a few blocks at a time, cut as a whole, also where cuts depend on what lies before."""
    repo = Repository.init(spark, str(tmp_path / "r"), "secret")
    data = np.random.default_rng(6).integers(0, 256, 300_000, np.uint8).tobytes()
    for bits in (10, 16):
        repo.save_stream(f"tape{bits}", io.BytesIO(data), bits, AT, block_bytes=9000, held=5)
        out = io.BytesIO()
        assert repo.write_bits(f"tape{bits}", out) == len(data) and out.getvalue() == data
        assert [r.length for r in repo.bits(f"tape{bits}").orderBy("seq").collect()] == np.diff([0, *chunking.cuts(data, bits)]).tolist()
    with pytest.raises(ValueError):
        repo.save_stream("none", io.BytesIO(b""), 10, AT)


def test_another_file_system(spark, tmp_path):
    """All of it through a file system that isn't the local one: Hadoop's view of mounted folders."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.siltstone.link./data", f"file://{tmp_path}")
    make_tree(tmp_path / "src")
    repo = Repository.init(spark, "viewfs://siltstone/data/repo", protect=True)
    repo.backup("x", **tree(spark, tmp_path / "src"), bits=10, at=AT)
    opened = Repository(spark, "viewfs://siltstone/data/repo")
    opened.restore_tree("x", str(tmp_path / "out"))
    assert state(tmp_path / "out") == state(tmp_path / "src") and opened.fsck().count() == 0
    assert listing(spark, "viewfs://siltstone/data/src").count() == 6


def test_identities_level_by_level(spark):
    """The same roots as in one place, and levels expand to the hashes that they hold."""
    rng = np.random.default_rng(8)
    rows = [(k, n, bytearray(rng.integers(0, 256, 32, np.uint8).tobytes())) for k, m in enumerate([1, 2, 40, 900]) for n in range(m)]
    df = spark.createDataFrame(rows, "object_id long, seq long, hash binary")
    same = lambda t: sorted((r.object_id, bytes(r.hash), r.level) for r in t.collect())
    assert same(store.tall_roots(df, 8, block_rows=7)) == same(store.merkle_roots(df, 8)) and store.tall_roots(df.where("false"), 8).count() == 0
    nodes = spark.createDataFrame([(1, 0, bytearray(range(50))), (1, 1, bytearray()), (1, 2, bytearray(range(50, 64)))], "object_id long, seq long, data binary")
    assert [bytes(r.hash) for r in store.expand_level(nodes).orderBy("seq").collect()] == [bytes(range(32)), bytes(range(32, 64))]
    with pytest.raises(Exception, match="whole number"):
        store.expand_level(nodes.where("seq < 2")).collect()


def test_offsets_and_packs_of_hot_groups(spark):
    """Against plain sums, with null groups and one group that has nearly all rows."""
    df = spark.range(0, 3000, 1, 5).selectExpr("id", "case when id % 50 = 0 then null when id % 7 = 0 then 'b' else 'a' end as g", "id * 37 % 501 as length")
    rows = sorted(df.collect(), key=lambda r: r.id)
    got = {r.id: r for r in store.running_offsets(df, ["id"], group=["g"]).collect()}
    packed = {r.id: r for r in store.assign_packs(df, ["id"], ["g"], 4000).collect()}
    at, pack = {}, {}
    for r in rows:
        record = 4 + (1 if r.length < 64 else 2) + r.length
        assert (got[r.id].offset, got[r.id].record) == (at.get(r.g, 0), record)
        at[r.g] = at.get(r.g, 0) + record
        n, o = pack.get(r.g, (0, 0))
        n, o = (n + 1, 0) if o and o + r.length + 16 > 4000 else (n, o)
        assert (packed[r.id].pack, packed[r.id].offset) == (n, o)
        pack[r.g] = (n, o + record)
    assert store.running_offsets(df.select("id", "length"), ["id"]).agg(F.max("offset")).first()[0] == sum(at.values()) - got[2999].record


def test_excluded_by_a_table(spark):
    files = spark.createDataFrame([("a/b/c",), ("abc",), ("x",), ("",), (None,)], "path string")
    left = lambda *p: sorted(str(r.path) for r in snapshots.without_excluded(files, spark.createDataFrame([(x,) for x in p], "pattern string")).collect())
    assert left() == left(None) == ["", "None", "a/b/c", "abc", "x"] and left("b/", "x") == ["", "None", "abc"] and left("") == ["None"] and left("longer than all") == left()


def test_opening_and_making(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Repository(spark, str(tmp_path / "none"))
    Repository.init(spark, str(tmp_path / "r"))
    with pytest.raises(FileExistsError):
        Repository.init(spark, str(tmp_path / "r"))
    with pytest.raises(Exception, match="NotADirectory"):
        read_tree(spark, str(tmp_path / "none")).count()


def test_listing_hides_parity_files(spark, tmp_path):
    for n in ("packs/a.pack", "packs/a.pack.rs", "indices/a.idx"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in listing(spark, str(tmp_path)).collect()] == ["indices/a.idx", "packs/a.pack"]
    assert [r.name for r in listing(spark, str(tmp_path), "packs/").collect()] == ["packs/a.pack"]


def test_names(spark):
    rows = [("backup-home@1", AT, b"x" * 32), ("backup-home2@1", AT + dt.timedelta(1), b"y" * 32), ("backup-home", AT, b""), ("bits-t@2", AT, b"")]
    df = spark.createDataFrame([(n, t, bytearray(d)) for n, t, d in rows], "name string, created timestamp_ntz, data binary")
    one = lambda *a, **k: [r.name for r in metadata.latest(df, *a, **k).collect()]
    assert one("backup-home") == ["backup-home"] and one("backup-hom") == ["backup-home2@1"] and one("backup-home@1") == ["backup-home@1"]
    without = df.where("name <> 'backup-home'")
    assert [r.name for r in metadata.latest(without, "backup-home").collect()] == ["backup-home2@1"]
    assert [r.name for r in metadata.latest(without, "backup-home", exact=True).collect()] == ["backup-home@1"]
    assert one("nothing") == [] and one("backup-@") == []
    assert [(r.kind, r.name) for r in metadata.listing(df).collect()] == [("backup", "home"), ("backup", "home2@1"), ("backup", "home@1"), ("bits", "t@2")]
    got = spark.createDataFrame([("a@20240102030405",), ("a@2024",), ("a",), ("a@b@20240102030405",)], "n string").select(metadata.hierarchy(F.col("n")).alias("h")).collect()
    assert [r.h and tuple(r.h) for r in got] == [("a", "2024", "01", "02", "030405"), None, None, None]


def test_entries_and_lookup(spark):
    rows = [("a/b/c.GZ", "file", 0o644, 1, 10), ("a/x", "file", 0o600, 1, 0), ("top", "file", 0o644, 1, 9000), ("pipe", "other", 0, 1, 0)]
    df = spark.createDataFrame(rows, "path string, kind string, mode long, mtime_ns long, size long")
    every = snapshots.entries(df)
    assert {(r.path, r.parent, r.name, r.kind) for r in every.collect()} == {("a", "", "a", "dir"), ("a/b", "a", "b", "dir"), ("a/b/c.GZ", "a/b", "c.GZ", "file"), ("a/x", "a", "x", "file"), ("top", "", "top", "file")}
    assert snapshots.rejects(df).count() == 1
    assert [r.name for r in snapshots.children(every, "a").collect()] == ["b", "x"]
    assert snapshots.lookup(every, "/a//b/").first().kind == "dir" and snapshots.lookup(every, "a/zz").count() == 0
    plan = {r.path: (r.b, r.k) for r in every.select("path", snapshots.split_bits(F.col("name")).alias("b"), snapshots.storage_of(F.col("kind"), F.col("size")).alias("k")).collect()}
    assert plan == {"a": (14, "none"), "a/b": (14, "none"), "a/b/c.GZ": (18, "inline"), "a/x": (14, "empty"), "top": (14, "chunks")}
