"""A folder walked by tasks: links, circles, hidden and empty files, names, and files that change while they are read."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gleanery.functions.embedding import ConceptProvider
from gleanery.functions.paths import normal_path
from gleanery.index import Indexer
from gleanery.sources.store import SnapshotStore
from gleanery.sources.walk import OUTSIDE, contents, walked, walked_listing


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    root, other = top / "root", top / "other"
    for folder in (root / "a" / "deep", root / "build" / "x", root / "skip", other):
        folder.mkdir(parents=True)
    texts = {"a/one.md": "# One\n", "a/deep/two.txt": "two", ".hidden": "h", "empty.txt": "", "build/x/made.js": "x", "skip/no.txt": "no", "build/keep.txt": "kept by a link"}
    for name, text in texts.items():
        (root / name).write_text(text)
    (other / "secret.txt").write_text("secret")
    (root / "a" / "loop").symlink_to(root, target_is_directory=True)
    (root / "A-link").symlink_to(root / "a", target_is_directory=True)  # a folder that is reached by its own path
    (root / "z-link").symlink_to(root / "build" / "x", target_is_directory=True)  # one whose own path is ignored
    (root / "file-link.md").symlink_to(root / "a" / "one.md")
    (root / "out").symlink_to(other, target_is_directory=True)
    (root / "out.txt").symlink_to(other / "secret.txt")
    (root / "dangling").symlink_to(root / "nowhere")
    (root / "cafe\u0301.txt").write_text("decomposed")
    (root / "two\u0301").write_text("first")
    (root / "tw\u00f3").write_text("second")
    os.mkfifo(root / "pipe")
    with open(os.path.join(os.fsencode(root), b"bad\xff.txt"), "wb") as file:
        file.write(b"x")
    return root


def test_walk(spark, tree):
    rows = walked(spark, str(tree), ["build/"], (str(tree / "skip"),)).collect()
    files = {r.relative_path: r for r in rows if r.read_status == "ready"}
    assert set(files) == {"a/one.md", "a/deep/two.txt", ".hidden", "empty.txt", "z-link/made.js", "file-link.md", "caf\u00e9.txt", "tw\u00f3"}
    assert files["tw\u00f3"].canonical_path.endswith("two\u0301")
    assert files["file-link.md"].inode == files["a/one.md"].inode and files["file-link.md"].file_id != files["a/one.md"].file_id
    found = os.stat(tree / "a" / "one.md")
    assert (files["a/one.md"].size, files["a/one.md"].modified_at_ns, files["a/one.md"].changed_at_ns, files["a/one.md"].inode) == (found.st_size, found.st_mtime_ns, found.st_ctime_ns, found.st_ino)
    failed = {r.relative_path.split("\0")[0]: (r.read_status, r.last_error) for r in rows if r.read_status != "ready"}
    assert failed == {
        "out": ("unsafe", OUTSIDE), "out.txt": ("unsafe", OUTSIDE), "dangling": ("unreadable", os.strerror(2)), "bad?.txt": ("unreadable", "a name that is not UTF-8"),
        "tw\u00f3": ("unsafe", "another file has this path"),
    }
    assert len({r.file_id for r in rows}) == len(rows)


def test_walk_of_an_empty_folder_and_of_no_folder(spark, tmp_path):
    assert walked(spark, str(tmp_path)).count() == 0 and walked_listing(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        walked(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        walked(spark, "s3a://bucket/files")


def test_contents_are_those_that_were_listed(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other.txt"
    root.mkdir()
    other.write_text("secret")
    for name in ("same", "swapped", "linked", "gone", "large"):
        (root / name).write_text(name * (100 if name == "large" else 1))
    found = walked(spark, str(root))
    walk = spark.createDataFrame(found.collect(), found.schema)
    (root / "new").write_text("new")
    os.replace(root / "new", root / "swapped")
    os.remove(root / "linked")
    (root / "linked").symlink_to(other)
    os.remove(root / "gone")
    found = {r.filename: (bytes(r.content) if r.content is not None else None, r.refused, r.why) for r in contents(walk, str(root), 100).collect()}
    assert found == {
        "same": (b"same", None, None), "swapped": (None, "unsafe", "another file since it was listed"), "linked": (None, "unsafe", OUTSIDE), "gone": (None, "unreadable", os.strerror(2)),
        "large": (None, "unreadable", "larger than 100 bytes"),
    }


def test_listing_by_a_walk_is_indexed(spark, tree, tmp_path):
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), ConceptProvider())
    listing = walked_listing(spark, str(tree), ["build/"])
    found = {r.relative_path: r for r in listing.collect()}
    assert found["a/one.md"].content_hash == hashlib.sha256(b"# One\n").hexdigest() and found["a/one.md"].format == "markdown" and found["empty.txt"].text == ""
    assert found["out.txt"].read_status == "unsafe" and found["out.txt"].text is None and found["out.txt"].content_hash is None
    counts = indexer.run(listing)
    assert counts["failed"] == sum(r.read_status != "ready" for r in found.values()) and counts["content"] == sum(r.read_status == "ready" for r in found.values())
    again = walked_listing(spark, str(tree), ["build/"], indexer.known())
    assert again.where("relative_path = 'a/one.md'").first().text is None  # not opened again
    assert indexer.run(again).get("content", 0) == 0


def test_normal_paths(spark):
    cases = {
        "a/b": "a/b", "a\\b": "a/b", "./a//b/": "a/b", "a/../b": "b", "a/..": None, "..": None, "../a": None, "a/../../b": None, "/a": None, "C:\\a": None, "": None, ".": None, "cafe\u0301/x": "caf\u00e9/x", "a/b/../../c/./d": "c/d", "a..b/...": "a..b/...",
    }
    rows = spark.createDataFrame([(p,) for p in [*cases, None]], "path string").select("path", normal_path(F.col("path")).alias("made")).collect()
    assert {r.path: r.made for r in rows} == {**cases, None: None}
