import io
import sys

import numpy as np

from siltstone import cli
from tests.test_repository import make_tree, state


def run(spark, capsysbinary, *args):
    code = cli.main([str(a) for a in args], spark)
    return code, capsysbinary.readouterr().out


def test_commands(spark, tmp_path, capsysbinary, monkeypatch):
    make_tree(tmp_path / "src")
    repo = ["--repository", tmp_path / "repo"]
    assert run(spark, capsysbinary, *repo, "init")[0] == 0
    name = run(spark, capsysbinary, *repo, "backup", "--split-bits", "10", "--exclude", "deep/e", "home", tmp_path / "src")[1].decode().strip()
    assert name.startswith("home@")
    assert run(spark, capsysbinary, *repo, "restore", "home", tmp_path / "out")[0] == 0
    want = state(tmp_path / "src")
    del want["sub/deep/e"]
    assert state(tmp_path / "out") == want
    data = np.random.default_rng(1).integers(0, 256, 70_000, np.uint8).tobytes()
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(data)})())
    run(spark, capsysbinary, *repo, "savebits", "--split-bits", "9", "tape")
    assert run(spark, capsysbinary, *repo, "restorebits", "tape")[1] == data
    listed = run(spark, capsysbinary, *repo, "list")[1].decode()
    assert "Total of 1 backups:" in listed and "Total of 1 bitstreams:" in listed and name in listed
    assert f"home/{name[5:9]}/" in run(spark, capsysbinary, *repo, "paths")[1].decode()
    assert run(spark, capsysbinary, *repo, "fsck")[0] == 0


def test_parity_commands(spark, tmp_path, capsysbinary):
    (tmp_path / "f").mkdir()
    data = np.random.default_rng(1).integers(0, 256, 50_000, np.uint8).tobytes()
    (tmp_path / "f/x").write_bytes(data)
    assert run(spark, capsysbinary, "rs-encode", tmp_path / "f", tmp_path / "p")[0] == 0
    assert run(spark, capsysbinary, "rs-check", tmp_path / "f", tmp_path / "p")[0] == 0
    (tmp_path / "f/x").write_bytes(b"???" + data[3:])
    assert run(spark, capsysbinary, "rs-check", tmp_path / "f", tmp_path / "p")[0] == 1
    run(spark, capsysbinary, "rs-restore", tmp_path / "f", tmp_path / "p", tmp_path / "g")
    assert (tmp_path / "g/x").read_bytes() == data
