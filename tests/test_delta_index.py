"""The index as a log: what an edit writes, what a held snapshot sees, which folders a search opens."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.config import IndexConfig, SearchConfig
from gleanery.functions.embedding import ConceptProvider, DigestProvider
from gleanery.index import Indexer
from gleanery.operators import cells, retrieval
from gleanery.schema import BUCKETS, empty
from gleanery.search import HybridSearch
from gleanery.sources.files import listed
from gleanery.sources.store import CommitConflict, SnapshotStore

WORDS = ["harbour", "lantern", "granite", "meadow", "copper", "willow", "saffron", "anchor", "thistle", "ember"]


def text_of(k: int) -> str:
    return "\n".join(" ".join(WORDS[(k * 7 + line * 3 + w) % len(WORDS)] + str((k + w) % 97) for w in range(12)) for line in range(30))


@pytest.fixture(scope="module")
def thousand(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("thousand")
    for k in range(1000):
        (root / f"f{k:04d}.txt").write_text(text_of(k))
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("log")))
    indexer = Indexer(store, DigestProvider())
    assert indexer.run(listed(spark, str(root))) == {"content": 1000}
    return root, store, indexer


def test_an_edit_writes_a_hundredth_and_compaction_changes_no_row(spark, thousand):
    root, store, indexer = thousand
    whole, before = store.written_bytes(store.current()), store.snapshot()
    (root / "f0007.txt").write_text("quartz and obsidian\n")
    (root / "f0008.txt").unlink()
    assert indexer.run(listed(spark, str(root))) == {"content": 1, "deleted": 1, "unchanged": 998}
    assert store.written_bytes(store.current()) < whole / 100
    paths = lambda held: {r.relative_path for r in held.read("chunks").select("relative_path").collect()}
    assert len(paths(before)) == 1000 and len(paths(store.snapshot())) == 999
    assert before.read("postings").where("unit = 'quartz'").count() == 0 and store.read("postings").where("unit = 'quartz'").count() == 1
    rows = lambda held: {t: sorted(map(str, held.read(t).collect())) for t in ("files", "lengths", "postings", "cells")}
    merged = store.snapshot()
    assert indexer.refresh() == store.current() != merged.name
    now = store.snapshot()
    assert rows(now) == rows(merged) and not now.pointer["gone"] and all(len(now.segments(t)) == 1 for t in ("files", "chunks", "postings"))
    assert indexer.refresh() is None
    assert store.vacuum(grace_s=0) == 2  # the first commit and the edit
    assert rows(store.snapshot()) == rows(now)


def test_a_search_opens_the_folders_of_its_terms_alone(spark, thousand, tmp_path):
    _, store, _ = thousand
    store.compact()
    index = HybridSearch.index(store.snapshot())
    queries = spark.createDataFrame([(1, "harbour12")], "query_id long, query string")
    held = index.of_units(queries.select(F.col("query").alias("unit")))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*unit", plan)
    folders = {f.split("bucket=")[1].split("/")[0] for f in held.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(folders) == 1 and BUCKETS > 8
    scored = retrieval.match_scores(index, queries)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" not in plan  # terms are a filter of the scan; postings meet queries without a shuffle of their own
    plain = retrieval.match_scores(store.read("chunks"), queries)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, plain.collect())) != []


def test_more_terms_than_a_filter_holds(spark, thousand, monkeypatch):
    _, store, _ = thousand
    index = HybridSearch.index(store.snapshot())
    queries = spark.createDataFrame([(1, "harbour12 lantern3"), (2, "copper40")], "query_id long, query string")
    expect = sorted(map(tuple, retrieval.match_scores(index, queries).collect()))
    monkeypatch.setattr(retrieval, "TERMS_IN_FILTER", 1)
    assert sorted(map(tuple, retrieval.match_scores(index, queries).collect())) == expect != []


def test_a_commit_between_the_pools_is_not_seen(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    root.mkdir()
    for k in range(6):
        (root / f"n{k}.txt").write_text(f"granite pillar number {k}\n")
    store = SnapshotStore(spark, str(tmp_path / "s"))
    indexer = Indexer(store, ConceptProvider())
    indexer.run(listed(spark, str(root)))
    search = HybridSearch(store, ConceptProvider())
    expect = [tuple(r) for r in search.search("granite pillar").collect()]
    plain = retrieval.bm25_pool

    def meanwhile(*given, **named):  # between the vector pool and this one, every file is replaced
        for k in range(6):
            (root / f"n{k}.txt").write_text("basalt only\n")
        if indexer.run(listed(spark, str(root))) == {"content": 6}:
            store.compact()
        return plain(*given, **named)

    monkeypatch.setattr(retrieval, "bm25_pool", meanwhile)
    assert [tuple(r) for r in search.search("granite pillar").collect()] == expect
    monkeypatch.undo()
    assert search.search("granite pillar").where("array_contains(sources, 'bm25')").count() == 0


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("f1",)], "file_id string")
    rows = lambda i: empty(spark, "files").unionByName(spark.createDataFrame([(i, f"{i}.md")], "file_id string, relative_path string"), allowMissingColumns=True)
    store.commit({"files": rows("f1")})
    base = store.snapshot()
    store.change({"files": (one, rows("f2"))}, base=base)
    with pytest.raises(CommitConflict):
        store.change({"files": (one, rows("f3"))}, base=base)
    assert [r.file_id for r in store.read("files").collect()] == ["f2"]
    assert [r.file_id for r in base.read("files").collect()] == ["f1"]
    store.change({"files": (None, rows("f1"))})  # a row added after its file was marked counts
    assert sorted(r.file_id for r in store.read("files").collect()) == ["f1", "f2"]


def clustered(spark, count, dim=16, centres=40, seed=1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim))
    rows = middle[draw.integers(0, centres, count)] + 0.25 * draw.normal(size=(count, dim))
    named = [(f"c{k:05d}", f"f{k % 50}", "text" if k % 3 else "python", [float(x) for x in v]) for k, v in enumerate(rows)]
    return spark.createDataFrame(named, "chunk_id string, file_id string, format string, vector array<float>"), middle


def test_cells_find_what_is_near(spark, tmp_path):
    vectors, middle = clustered(spark, 6000)
    made = cells.trained(vectors, 6000, 16)
    dealt = cells.dealt(vectors, made)
    assert dealt.where("cell < 0").count() == 0 and 40 <= len(made.centres) <= 90
    config = SearchConfig(vector_candidates=20)
    asked = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(middle[:25])], "query_id int, query_vector array<double>")
    probes = cells.probes_for(dealt, made, 0.95, config)
    assert probes < len(made.centres) and cells.recall(dealt, made, asked, config, probes) >= 0.95
    assert cells.recall(dealt, made, asked, config, len(made.centres)) == 1.0  # all cells: exact
    dealt.write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    found = cells.pool(stored, made, asked.limit(1), config, 2)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", found._jdf.queryExecution().executedPlan().toString())
    assert all(r.rank <= 20 for r in found.collect())


def test_chunks_without_a_cell_are_met_and_odd_queries_find_nothing(spark):
    vectors, middle = clustered(spark, 800)
    made = cells.trained(vectors, 800, 16)
    late = cells.dealt(spark.createDataFrame([("late", "f", "text", [float(x) for x in middle[0]]), ("zero", "f", "text", [0.0] * 16), ("short", "f", "text", [1.0])], vectors.schema), None)
    both = cells.dealt(vectors, made).unionByName(late)
    asked = spark.createDataFrame([("a", [float(x) for x in middle[0]], ["text"]), ("b", [0.0] * 16, []), ("c", [1.0], []), ("d", None, [])], "query_id string, query_vector array<double>, formats array<string>")
    found = cells.pool(both, made, asked, SearchConfig(vector_candidates=5), 1).collect()
    assert {r.query_id for r in found} == {"a"} and [r.chunk_id for r in found if r.rank == 1] == ["late"]
    formats = dict((r.chunk_id, r.format) for r in both.collect())
    assert {formats[r.chunk_id] for r in found} == {"text"}
    assert cells.trained(vectors.limit(0), 0, 16) is None and cells.dealt(vectors, None).where("cell = -1").count() == 800


def test_index_with_cells(spark, thousand, tmp_path):
    root, _, _ = thousand
    store = SnapshotStore(spark, str(tmp_path / "s"))
    indexer = Indexer(store, DigestProvider(), IndexConfig(cells_from=500))
    indexer.run(listed(spark, str(root)))
    search = HybridSearch(store, DigestProvider())
    plain = search.search("harbour12 lantern3").select("rank", "file_id", "score").collect()
    assert indexer.refresh() == store.current()
    held = store.snapshot()
    assert held.read("quantiser").count() > 10 and 0 < held.settings["cell_probes"] <= 1
    assert held.read("cells").where("cell = -1").count() == 0
    assert search.search("harbour12 lantern3").select("rank", "file_id", "score").collect()[0] == plain[0]
    (root / "f0500.txt").write_text("porphyry\n")
    assert indexer.run(listed(spark, str(root)))["content"] == 1
    assert store.read("cells").where("cell = -1").count() == 0  # dealt out by the stored centres
    assert [r.relative_path for r in search.search("porphyry").where("array_contains(sources, 'bm25')").collect()] == ["f0500.txt"]


def test_shared_values_do_not_fan_out(spark):
    """A heading that every chunk shares: a query meets its first chunks, and finds what comparing all of them finds."""
    rows = [(f"c{k:04d}", f"f{k % 40}", f"d/f{k % 40}.md", f"f{k % 40}.md", "md" if k % 2 else "py", ["Common heading"], [f"symbol{k % 7}"]) for k in range(900)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, relative_path string, filename string, format string, heading_trail array<string>, symbols array<string>")
    queries = spark.createDataFrame([(1, "common", []), (2, "symbol3 heading", ["md"]), (3, "f7.md", []), (4, "comon", ["py"])], "query_id long, query string, formats array<string>")
    found = sorted((r.query_id, r["rank"], r.chunk_id, round(r.raw_score, 9)) for r in retrieval.metadata_pool(chunks, queries).collect())
    formats, wanted = {r[0]: r[4] for r in rows}, {1: [], 2: ["md"], 3: [], 4: ["py"]}
    matches = [r for r in retrieval.metadata_matches(chunks, queries).collect() if not wanted[r.query_id] or formats[r.chunk_id] in wanted[r.query_id]]
    expect = []
    for q in wanted:
        own, seen = sorted((r for r in matches if r.query_id == q), key=lambda r: (-r.strength, r.relative_path, r.chunk_id)), {}
        kept = [r for r in own if seen.setdefault(r.file_id, []).append(r) or len(seen[r.file_id]) <= 3][:100]
        expect += [(q, k + 1, r.chunk_id, round(r.strength, 9)) for k, r in enumerate(kept)]
    assert found == sorted(expect)
