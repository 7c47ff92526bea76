"""A feed of file versions: late and repeated ones, deletions, a restart."""

import json

from gleanery.functions.embedding import DigestProvider
from gleanery.index import Indexer
from gleanery.sources.files import listed
from gleanery.sources.store import SnapshotStore
from gleanery.streaming.changes import apply_changes

SCHEMA = "relative_path string, content binary, modified_at_ms double, op string, generation long"


def test_versions_are_applied_once_and_in_order(spark, tmp_path):
    inbox, batches = tmp_path / "inbox", []
    inbox.mkdir()
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), DigestProvider())

    def put(name, *rows):
        lines = [json.dumps({"relative_path": p, "content": None if t is None else __import__("base64").b64encode(t.encode()).decode(), "modified_at_ms": 1.0, "op": "delete" if t is None else "put", "generation": g}) for p, t, g in rows]
        (tmp_path / name).write_text("\n".join(lines))
        (tmp_path / name).rename(inbox / name)

    def play(checkpoint="c"):
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(inbox))
        query = apply_changes(feed, "/corpus", indexer, str(tmp_path / checkpoint), lambda n, counts: batches.append(counts), availableNow=True)
        assert query.awaitTermination(300)

    state = lambda: {r.relative_path: r.display_text for r in indexer.store.read("chunks").collect()}
    put("1.json", ("a.txt", "one", 1), ("a.txt", "two", 2), ("b.txt", "bee", 1), ("c.txt", "sea", 5))
    play()
    assert state() == {"a.txt": "two", "b.txt": "bee", "c.txt": "sea"} and batches == [{"content": 3}]
    put("2.json", ("a.txt", "late", 1), ("b.txt", None, 2), ("c.txt", "sea", 6))
    play()  # from the checkpoint
    assert state() == {"a.txt": "two", "c.txt": "sea"} and batches[1:] == [{"deleted": 1, "unchanged": 1}]
    put("3.json", ("b.txt", "overtaken", 1), ("c.txt", None, 4), ("d.txt", None, 1))
    play()
    assert state() == {"a.txt": "two", "c.txt": "sea"}
    before, version = state(), indexer.store.snapshot().version
    play("another")  # all of it played again by a query that knows nothing
    assert state() == before and indexer.store.snapshot().version == version
    put("4.json", ("b.txt", "back", 3), ("c.txt", "see", 7))
    play()
    assert state() == {"a.txt": "two", "b.txt": "back", "c.txt": "see"}
    assert {r.generation for r in indexer.store.read("generations").collect()} == {2, 3, 7, 1}


def test_a_feed_leaves_other_files_alone(spark, tmp_path):
    from gleanery.sources.files import versions

    root = tmp_path / "r"
    root.mkdir()
    (root / "x.txt").write_text("listed")
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), DigestProvider())
    indexer.run(listed(spark, str(root)))
    rows = spark.createDataFrame([("y.txt", bytearray(b"fed"), 1.0, "put", 1), ("z.bin", bytearray(b"\x00\xff"), 1.0, "put", 1)], SCHEMA)
    assert indexer.apply(versions(rows, str(root))) == {"content": 1, "skipped": 1}
    assert {r.relative_path for r in indexer.store.read("chunks").collect()} == {"x.txt", "y.txt"}
    assert indexer.apply(versions(rows, str(root))) == {}
    assert indexer.apply(versions(rows.limit(0), str(root))) == {}
