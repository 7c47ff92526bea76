"""A small corpus of our own, indexed, searched, changed and searched again."""

import pytest

from gleanery.config import IndexConfig, SearchConfig, SearchError, normalize_request
from gleanery.functions.embedding import ConceptProvider
from gleanery.index import Indexer
from gleanery.search import HybridSearch
from gleanery.sources.files import listed
from gleanery.sources.store import SnapshotStore
from gleanery.operators import evaluation

CORPUS = {
    "docs/retry-guide.md": "# Retry guide\n\nWhen a processor fails for a moment, try the call again.\n\n## Waiting\n\nUse exponential backoff with jitter between attempts so that a transient fault can pass.\n",
    "docs/once-only.md": "# Once only\n\nA repeated request must not charge a customer twice.\n\n## Duplicate keys\n\nAn idempotency key marks each charge; a replay returns the first answer.\n",
    "docs/faults.html": "<html><head><title>Faults</title><script>var hidden = 'never shown';</script></head><body><h1>Faults</h1><h2>Certificates</h2><p>Remote greeting refused: pinned certificate differs</p></body></html>",
    "src/limits.ts": "// limits of calls\nexport const CALL_TIMEOUT_MS = 2500;\n\nexport function deadline() {\n  return CALL_TIMEOUT_MS;\n}\n",
    "src/again.py": "import time\n\n\nclass WaitPlanner:\n    def delays(self):\n        return [1, 2, 4]\n\n\ndef try_again(call):\n    return call()\n",
    "notes/shopping.txt": "bread and butter\n\ntea\n",
}
JUDGED = [
    ("retry-guide.md", {"docs/retry-guide.md"}),
    ("src/limits.ts", {"src/limits.ts"}),
    ("CALL_TIMEOUT_MS", {"src/limits.ts"}),
    ("WaitPlanner", {"src/again.py"}),
    ('"remote greeting refused"', {"docs/faults.html"}),
    ("how long to wait before transient faults are retried", {"docs/retry-guide.md"}),
    ("stop charging a customer twice when a request is repeated", {"docs/once-only.md"}),
]


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in CORPUS.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    (root / "skip").mkdir()
    (root / "skip" / "x.txt").write_text("ignored words")
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("index")))
    indexer = Indexer(store, ConceptProvider(), IndexConfig(chunk_size_tokens=60, chunk_overlap_tokens=10))
    counts = indexer.run(listed(spark, str(root), ["skip/"]))
    return root, store, indexer, counts


def test_first_pass_indexes_all(setup):
    _, store, _, counts = setup
    assert counts == {"content": len(CORPUS)}
    rows = store.read("files").collect()
    assert {r.relative_path for r in rows} == set(CORPUS)
    assert all(r.index_status == "indexed" and r.chunk_count > 0 for r in rows)
    assert store.read("chunks").where("display_text like '%never shown%'").count() == 0
    assert store.read("chunks").where("size(vector) != 32 or token_count > 62").count() == 0


def test_second_pass_writes_nothing(spark, setup):
    root, store, indexer, _ = setup
    before = store.current()
    assert indexer.run(listed(spark, str(root), ["skip/"])) == {"unchanged": len(CORPUS)}
    assert store.current() == before


def test_relevance(spark, setup):
    _, store, _, _ = setup
    queries = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(JUDGED)], "query_id long, query string")
    found = HybridSearch(store, ConceptProvider()).search_batch(queries)
    expected = spark.createDataFrame([(k, path) for k, (_, paths) in enumerate(JUDGED) for path in paths], "query_id long, item string")
    row = evaluation.summary(evaluation.query_metrics(expected, found.select("query_id", "relative_path", "rank").withColumnRenamed("relative_path", "item"))).first()
    assert row.recall_5 >= 0.9 and row.recall_10 >= 0.95 and row.reciprocal_rank >= 0.8


def test_formats_and_nothing_found(setup):
    _, store, _, _ = setup
    search = HybridSearch(store, ConceptProvider())
    assert {r.relative_path for r in search.search("wait again", formats=("Python",)).collect()} <= {"src/again.py"}
    assert search.search("zzyzx-unheard-of", formats=("sql",)).count() == 0


def test_edit_delete_and_vector_reuse(spark, setup):
    root, store, indexer, _ = setup
    (root / "docs/retry-guide.md").write_text(CORPUS["docs/retry-guide.md"] + "\n## Limits\n\nGive up after five attempts.\n")
    (root / "notes/shopping.txt").unlink()
    old = {r.chunk_id: r.vector for r in store.read("chunks").where("relative_path = 'docs/retry-guide.md'").collect()}
    counts = indexer.run(listed(spark, str(root), ["skip/"]))
    assert counts == {"content": 1, "deleted": 1, "unchanged": len(CORPUS) - 2}
    new = {r.chunk_id: r.vector for r in store.read("chunks").where("relative_path = 'docs/retry-guide.md'").collect()}
    assert len(new) > len(old) and all(new[k] == v for k, v in old.items() if k in new)
    assert store.read("files").where("relative_path like '%shopping%'").count() == 0
    found = HybridSearch(store, ConceptProvider()).search("give up after five attempts").first()
    assert found.relative_path == "docs/retry-guide.md" and found.rank == 1


def test_requests():
    assert normalize_request("  x  ", formats=("Markdown", " markdown ", "ts")).formats == ("markdown", "ts")
    for bad in (dict(query=" "), dict(query="x" * 5000), dict(query="x", files=0), dict(query="x", files=51), dict(query="x", formats=("a b",))):
        with pytest.raises(SearchError):
            normalize_request(**bad)
    with pytest.raises(SearchError):
        SearchConfig(rrf_k=0)
    with pytest.raises(ValueError):
        IndexConfig(chunk_size_tokens=600)
