"""Files as they are found on disk, and snapshots that survive a commit that breaks off."""

import hashlib
import os

import pytest

from gleanery.schema import empty
from gleanery.sources.files import listed
from gleanery.sources.store import SnapshotStore


def test_listing_inspects_bytes(spark, tmp_path):
    files = {
        "a/note.md": b"# hi\n", "a/bad.txt": b"caf\xe9 \xff", "a/nul.py": b"x = 1\x00", "a/blob.bin": bytes(range(1, 9)) * 20, "a/README": b"plain words", "a/bom.json": "﻿{}".encode(),
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"x")  # Spark's readers pass over both
    found = {r.relative_path: r for r in listed(spark, str(tmp_path)).collect()}
    assert set(found) == set(files)
    status = {k: r.read_status for k, r in found.items()}
    assert status == {"a/note.md": "ready", "a/bad.txt": "malformed", "a/nul.py": "unsupported", "a/blob.bin": "unsupported", "a/README": "ready", "a/bom.json": "ready"}
    assert found["a/note.md"].format == "markdown" and found["a/README"].format == "text"
    assert found["a/bom.json"].text == "{}" and found["a/bad.txt"].text is None
    assert all(r.content_hash == hashlib.sha256(files[k]).hexdigest() and r.size == len(files[k]) for k, r in found.items())
    assert len({r.file_id for r in found.values()}) == len(files)


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.read("files").count() == 0
    row = spark.createDataFrame([("f1", "a.md")], "file_id string, relative_path string")
    shape = empty(spark, "files")
    full = shape.unionByName(row, allowMissingColumns=True)
    first = store.commit({"files": full})
    assert store.current() == first and [r.file_id for r in store.read("files").collect()] == ["f1"]

    def broken(batches):
        for _ in batches:
            raise RuntimeError("lost")
        yield

    with pytest.raises(Exception):
        store.commit({"files": full.mapInPandas(broken, full.schema)})
    assert store.current() == first and store.read("files").count() == 1 and store.read("chunks").count() == 0
    assert store.commit({"files": full.limit(0)}) != first and store.read("files").count() == 0


def test_a_commit_that_breaks_off_before_the_rename_keeps_the_snapshot(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    full = empty(spark, "files").unionByName(spark.createDataFrame([("f1", "a.md")], "file_id string, relative_path string"), allowMissingColumns=True)
    first = store.commit({"files": full, "chunks": empty(spark, "chunks")})
    with monkeypatch.context() as broken:
        broken.setattr(SnapshotStore, "_point", lambda self, pending: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit({"files": full.limit(0)})
    assert store.current() == first and store.read("files").count() == 1
    second = store.commit({"files": full.limit(0)})
    assert store.current() == second and store.read("files").count() == 0
    assert not (tmp_path / "s" / second / "chunks").exists() and store.read("chunks").count() == 0  # chunks were not written again


def test_the_newest_pending_pointer_counts_where_the_present_one_is_lost(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    name = store.commit({"files": empty(spark, "files")})
    (tmp_path / "s" / "CURRENT").rename(tmp_path / "s" / "PENDING-x")
    assert store.current() == name


def test_a_file_of_the_same_size_and_exact_time_is_not_read_again(spark, tmp_path):
    from gleanery.functions.embedding import DigestProvider
    from gleanery.index import Indexer

    root, exact, whole = tmp_path / "root", 1_700_000_000_123_000_000, 1_700_000_100_000_000_000
    root.mkdir()
    for name, at in (("exact.txt", exact), ("whole.txt", whole), ("later.txt", whole + 999_000_000)):
        (root / name).write_text("first words")
        os.utime(root / name, ns=(at, at))
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), DigestProvider())
    tick = lambda: indexer.run(listed(spark, str(root), None, indexer.known()))
    assert tick() == {"content": 3} and tick() == {"unchanged": 3}
    for name, at in (("exact.txt", exact), ("whole.txt", whole)):
        (root / name).write_text("other words")  # as long, at the same time
        os.utime(root / name, ns=(at, at))
    assert tick() == {"content": 1, "unchanged": 2}  # a time of whole seconds is not trusted
    (root / "later.txt").write_text("words that differ")
    (root / "new.txt").write_text("new words")
    assert tick() == {"content": 2, "unchanged": 2}
    assert [r.relative_path for r in indexer.store.manifest().collect()] == ["exact.txt", "later.txt", "new.txt", "whole.txt"]
    ids = indexer.store.read("files").where("relative_path = 'new.txt'").select("file_id")
    assert [r.relative_path for r in indexer.store.of("chunks", ids.union(ids)).collect()] == ["new.txt"]
    other = Indexer(indexer.store, DigestProvider(64))
    assert other.differing() == ["provider", "dimension"] and other.known().count() == 0
    assert other.run(listed(spark, str(root), None, other.known())) == {"content": 4} and other.differing() == []
    assert other.store.read("chunks").where("size(vector) != 64").count() == 0


def test_usual_ignores(spark):
    from gleanery.sources.ignore import USUAL, ignored

    rows = spark.createDataFrame([("src/a.py",), ("node_modules/x/y.js",), ("web/dist/app.js",), ("a/b.min.js",), ("targets/x.md",)], "path string")
    assert {r.path for r in rows.where(~ignored(rows.path, list(USUAL))).collect()} == {"src/a.py", "targets/x.md"}
