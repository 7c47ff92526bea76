"""What an index was made from: settings that differ, vectors that can be used again, and texts that get none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gleanery.index as index
from gleanery.config import IndexConfig
from gleanery.functions.embedding import FAILED, TOO_LONG, DigestProvider, Profile, embedded, embedded_or_why
from gleanery.index import Indexer
from gleanery.operators.maintenance import reusable
from gleanery.sources.files import listed
from gleanery.sources.store import SnapshotStore


def refusing():
    """A provider that refuses texts that say so; its class is made here, so that tasks need not import this file."""

    class Refusing(DigestProvider):
        def embed(self, texts):
            if any("refuse" in t for t in texts):
                raise RuntimeError("no")
            return DigestProvider.embed(self, texts)

    return Refusing()


def test_reasons_stay_with_their_texts(spark):
    texts = ["one", "please refuse this", "two " * 600, None, "", "three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    found = {r.n: r.e for r in rows.select("n", embedded_or_why(F.col("text"), refusing(), Profile(document_prefix="d ")).alias("e")).collect()}
    assert {n: e.why for n, e in found.items()} == {0: None, 1: f"{FAILED}: RuntimeError", 2: TOO_LONG, 3: None, 4: None, 5: None}
    assert [n for n, e in found.items() if e.vector is None] == [1, 2] and found[3].vector == found[4].vector
    assert np.allclose(found[0].vector, DigestProvider().embed(["d one"])[0])
    assert rows.select(embedded(F.col("text"), refusing()).alias("v")).where("v is null").count() == 2


def test_vectors_that_can_be_used_again(spark):
    rows = [(1, "m", [1.0, 0.0]), (2, "other", [1.0, 0.0]), (3, "m", [1.0]), (4, "m", [float("nan"), 0.0]), (5, "m", [float("-inf"), 0.0]), (6, "m", [None, 1.0]), (7, "m", None), (8, None, [1.0, 0.0]), (9, "m", [])]
    table = spark.createDataFrame(rows, "n int, made_by string, vector array<float>")
    assert [r.n for r in table.where(reusable(F.col("made_by"), F.col("vector"), "m", 2)).collect()] == [1]


def test_settings_that_differ(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    (root / "a.txt").write_text("some words")
    (root / "b.txt").write_text("words that the provider will refuse")
    store = SnapshotStore(spark, str(tmp_path / "s"))
    first = Indexer(store, refusing())
    assert first.compatibility() == ("missing", []) and first.differing() == []
    first.run(listed(spark, str(root)))
    states = {r.relative_path: (r.index_status, r.last_error) for r in store.read("files").collect()}
    assert states == {"a.txt": ("indexed", ""), "b.txt": ("failed", f"{FAILED}: RuntimeError")}
    assert first.compatibility() == ("compatible", [])
    other = Indexer(store, refusing(), profile=Profile(revision="2", pooling="cls-v1", batch_rows=7))
    assert other.compatibility() == ("rebuild", ["revision", "pooling"]) and other.known().count() == 0
    assert Indexer(store, refusing(), IndexConfig(chunk_size_tokens=300)).differing() == ["chunk_size_tokens"]
    monkeypatch.setattr(index, "APPLICATION", "next")
    assert first.compatibility() == ("migrate", ["application_version"]) and first.differing() == [] and first.known().count() == 1
    made = store.read("chunks").first()
    assert made.embedding_model == first.identity() != other.identity()
    other.run(listed(spark, str(root)))
    assert {r.embedding_model for r in store.read("chunks").collect()} == {other.identity()}
    with pytest.raises(ValueError):
        Indexer(store, refusing(), profile=Profile(max_tokens=100))
