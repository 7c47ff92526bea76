"""Operators on small hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.config import IndexConfig, SearchConfig
from gleanery.functions import text as T
from gleanery.functions.chunks import Packer, count_tokens
from gleanery.functions.embedding import ConceptProvider, DigestProvider, pooled
from gleanery.operators import evaluation, fusion, lines, maintenance, retrieval
from gleanery.sources.files import coverage
from gleanery.sources.ignore import ignored
from gleanery.streaming import sessions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_competition_rank(spark):
    df = spark.createDataFrame([("q", "b", 5.0), ("q", "a", 5.0), ("q", "c", 1.0)], "query_id string, c string, s double")
    assert rows(df.select("c", fusion.competition_rank(["query_id"], F.col("s")).alias("r")), "c") == [("a", 1), ("b", 1), ("c", 3)]


def test_fusion_adds_sources(spark):
    pools = spark.createDataFrame([(1, "vector", "x", 0.9), (1, "bm25", "x", 7.0), (1, "bm25", "y", 3.0), (1, "metadata", "y", 0.5)], "query_id int, source string, chunk_id string, raw_score double")
    found = {r.chunk_id: (r.score, r.sources) for r in fusion.fuse(pools, SearchConfig(rrf_k=10.0)).collect()}
    assert found["x"] == (1 / 11 + 1 / 11, ["bm25", "vector"])
    assert found["y"] == (1 / 12 + 2 / 11, ["bm25", "metadata"])


def test_file_score_is_capped_and_excerpts_differ(spark):
    many = [("q", "big", "big", f"b{k:02}", 0.6, ["bm25"], "c") for k in range(20)]
    small = [("q", "small", "small", "s", 0.7, ["vector"], "c")]
    df = spark.createDataFrame(many + small, "query_id string, file_id string, relative_path string, chunk_id string, score double, sources array<string>, context string")
    found = rows(fusion.aggregate_files(df).select("rank", "file_id", "score"), "rank")
    assert [r[1] for r in found] == ["small", "big"] and found[1][2] <= 0.6 * 1.15 + 1e-9
    shown = spark.createDataFrame([("q", "f", "f", c, s, [], x) for c, s, x in (("i1", 1.0, "intro"), ("i2", 0.9, "intro"), ("u", 0.8, "usage"), ("a", 0.7, "api"))], df.schema)
    assert [r[1] for r in rows(fusion.diverse_excerpts(shown).select("excerpt", "chunk_id"), "excerpt")] == ["i1", "u", "a"]


@pytest.mark.parametrize(
    "value, term, kind",
    [("TeaLeaf.md", "tealeaf.MD", "exact"), ("TeaLeaf.md", "teal", "prefix"), ("shelf/tins/Green.md", "tins/green", "substring"), ("steepingTime", "stepingTimes", "fuzzy"), ("abc", "xyz", None), ("tea", "tee", "fuzzy"), ("", "ab", None)],
)
def test_match_kind(spark, value, term, kind):
    assert spark.range(1).select(T.match_kind(F.lit(value), F.lit(term)).alias("k")).first().k == kind


def test_query_terms(spark):
    found = spark.range(1).select(T.query_terms(F.lit('Tea "green leaf" tea steep/long.txt y cup_size')).alias("t")).first().t
    assert found == ["green leaf", "Tea", "green", "leaf", "steep/long.txt", "cup_size"]


def test_phrases_and_terms(spark):
    chunks = spark.createDataFrame([(1, "the card was declined today"), (2, "declined card"), (3, None), (4, "")], "chunk_id int, search_text string")
    ask = lambda q: {r.chunk_id for r in retrieval.bm25_pool(chunks, spark.createDataFrame([("q", q)], "query_id string, query string")).collect()}
    assert ask("card") == {1, 2} and ask('"card was declined"') == {1} and ask('"card was declined" declined') == {1, 2} and ask("absent") == set()


def test_vector_pool_ignores_what_is_no_vector(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0])], "chunk_id int, vector array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query_vector array<double>")
    found = retrieval.vector_pool(chunks, queries, SearchConfig(max_distance=2.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [1, 2] and found[0].raw_score == pytest.approx(1 / math.sqrt(1.01), abs=1e-6)


def test_changes(spark):
    kind = "file_id string, read_status string, content_hash string, size long"
    before = spark.createDataFrame([("same", "ready", "1", 1), ("edit", "ready", "1", 1), ("meta", "ready", "1", 1), ("gone", "ready", "1", 1), ("breaks", "ready", "1", 1), ("heals", "unreadable", None, 1), ("still", "malformed", None, 1)], kind)
    after = spark.createDataFrame([("same", "ready", "1", 1), ("edit", "ready", "2", 1), ("meta", "ready", "1", 2), ("breaks", "malformed", None, 1), ("heals", "ready", "1", 1), ("still", "malformed", None, 1), ("new", "ready", "1", 1), ("bad", "unsupported", None, 1)], kind)
    found = dict(rows(maintenance.classify_changes(before, after, ("size",)), "file_id"))
    assert found == {"same": "unchanged", "edit": "content-changed", "meta": "metadata-only", "gone": "deleted", "breaks": "failed", "heals": "content-changed", "still": "unchanged", "new": "added", "bad": "failed"}


def test_vectors_are_reused_once_each(spark):
    new = spark.createDataFrame([(0, "h"), (1, "h"), (2, "h"), (3, "g")], "n int, hash string")
    prior = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 2.0)], "id string, hash string, v double")
    assert rows(maintenance.reuse_vectors(new, prior, ["hash"], "n", "id", ["v"]).select("n", "v"), "n") == [(0, 1.0), (1, 2.0), (2, None), (3, None)]


def test_distribution_and_metrics(spark):
    df = spark.createDataFrame([(100.0,), (1.0,), (2.0,), (float("nan"),)], "v double")
    r = evaluation.distribution(df, [], "v").first()
    assert (r["count"], r["min"], r["p50"], r["p95"], r["max"]) == (3, 1.0, 2.0, 100.0, 100.0)
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, item string")
    ranked = spark.createDataFrame([(1, "noise", 1), (1, "a", 2), (1, "b", 4)], "query_id int, item string, rank int")
    found = {r.query_id: r for r in evaluation.query_metrics(expected, ranked).collect()}
    assert (found[1].recall_5, found[1].reciprocal_rank) == (1.0, 0.5) and (found[2].recall_5, found[2].reciprocal_rank, found[2].distinct_ratio) == (0.0, 0.0, 1.0)


def units(spark, build, text):
    table = lines.line_table(spark.createDataFrame([("f", text)], "file_id string, text string"))
    return build(table).orderBy("start_line", "start_offset").collect()


def test_markdown_units(spark):
    text = "---\ntitle: Guide\n---\n# One\n\nA **bold** word\nand more\n\n## Two\n\n- first\n- second\n\n> said\n\n| a | b |\n\n```py\nx = 1\n\ny = 2\n```\n"
    found = units(spark, lines.markdown_units, text)
    assert [u.kind for u in found] == ["record", "heading", "paragraph", "heading", "list", "quote", "table", "code"]
    assert found[0].search_text == "title: Guide" and found[2].search_text == "A bold word\nand more" and found[4].heading_trail == ["One", "Two"]
    assert found[7].search_text == "x = 1\n\ny = 2" and found[4].search_text == "first\nsecond"


def test_code_units(spark):
    text = '"""About."""\nimport os\n\n\n@wraps\nclass A:\n    def m(self):\n        pass\n\n\ndef f():\n    return 1\n'
    found = units(spark, lambda t: lines.code_units(t, "python"), text)
    assert [(u.kind, u.symbol) for u in found] == [("comment", None), ("declaration", "A"), ("declaration", "m"), ("declaration", "f")]
    assert found[1].display_text.startswith("@wraps")
    assert {u.kind for u in units(spark, lambda t: lines.code_units(t, "python"), 'x = """open\ndef f(): pass')} == {"code"}


def test_keyed_units(spark):
    found = units(spark, lambda t: lines.keyed_line_units(t, "yaml"), "a:\n  b: 1\n  c:\n    - x\n# no\nd: 2\n")
    assert [u.search_text for u in found] == ["a:", "a.b: 1", "a.c:", "a.c[]: x", "d: 2"]
    found = units(spark, lambda t: lines.keyed_line_units(t, "toml"), "k = 1\n[s.t]\nv = 'x'\n")
    assert [u.search_text for u in found] == ["k: 1", "[s.t]", "s.t.v: 'x'"]


def test_front_matter_fences_and_names(spark):
    found = units(spark, lines.markdown_units, "---\nurl: https://x.org/a\nat :  10:30\n---\n```\n~~~\n# no heading\n```\n# Heading\n\ntext\n")
    assert [(u.kind, u.search_text) for u in found] == [("record", "url: https://x.org/a\nat: 10:30"), ("code", "~~~\n# no heading"), ("heading", "Heading"), ("paragraph", "text")]
    found = units(spark, lambda t: lines.code_units(t, "stylesheet"), "a, b {\n}\n@media (min-width: 3px) {\n}\n@keyframes spin {\n}\n")
    assert [u.symbol for u in found] == ["a, b", "(min-width:", "spin"]
    found = units(spark, lambda t: lines.code_units(t, "python"), "def a():\n    pass\n\n# about b\n@wraps\ndef b():\n    pass\n")
    assert [(u.symbol, u.start_line, u.end_line) for u in found] == [("a", 1, 5), ("b", 4, 7)]


def test_entities(spark):
    shown = lambda x: spark.range(1).select(lines.visible_text(F.lit(x)).alias("t")).first().t
    assert shown("&#65;&#x42;&#x1F642; &amp;#65; &lt;b&gt; &#xD800; &#99999999; caf&#233;") == "AB\U0001f642 &#65; <b> &#xD800; &#99999999; café"


def test_values_meet_terms_without_a_cross_join(spark):
    """Every pair that matches, however: against a comparison of all pairs."""
    import random

    draw = random.Random(41)
    word = lambda: "".join(draw.choice("abcé_") for _ in range(draw.randint(1, 9)))
    values = spark.createDataFrame([("path", "/".join(word() for _ in range(draw.randint(1, 3)))) for _ in range(150)], "field string, value string").distinct()
    asked = spark.createDataFrame([(k, 0, word() + draw.choice(["", "", "/" + word()])) for k in range(120)], "query_id int, term_at int, term string").where("length(term) >= 2")
    pairs = values.crossJoin(asked).withColumn("kind", T.match_kind(F.col("value"), F.col("term"), 2)).where("kind is not null")
    expect = {(r.value, r.query_id, r.kind) for r in pairs.collect()}
    found = [(r.value, r.query_id, r.kind) for r in retrieval.matching_values(values, asked).collect()]
    assert set(found) == expect and len(found) == len(expect) and {k for *_, k in expect} == {"prefix", "substring", "fuzzy"} | ({"exact"} & {k for *_, k in expect})


def test_phrases_by_their_rarest_term(spark):
    chunks = spark.createDataFrame([(1, "to be or not to be"), (2, "be to or"), (3, "not to be to be"), (4, "a a a a")], "chunk_id int, search_text string")
    ask = lambda p: {r.chunk_id for r in retrieval.phrase_scores(chunks, spark.createDataFrame([("q", p)], "query_id string, phrase string")).collect()}
    assert ask("to be") == {1, 3} and ask("not to be") == {1, 3} and ask("be or not") == {1} and ask("a a") == {4} and ask("to be absent") == set() and ask("be") == {1, 2, 3}


def test_html_units(spark):
    html = "<head><title>T &amp; U</title></head><body>loose<nav>menu</nav><h1>Top</h1><p>one<br>two</p><ul><li>item</li></ul><table><tr><td>a</td><td>b</td></tr></table><script>no()</script></body>"
    found = lines.html_units(spark.createDataFrame([("f", html)], "file_id string, text string")).orderBy("unit").collect()
    assert [(u.kind, u.search_text) for u in found] == [("heading", "T & U"), ("text", "loose"), ("heading", "Top"), ("paragraph", "one\ntwo"), ("list", "item"), ("table", "a b")]
    assert found[1].heading_trail == ["T & U"] and found[4].heading_trail == ["Top"]


def test_fallback_and_csv(spark):
    assert [u.display_text for u in units(spark, lambda t: lines.fallback_units(t, 2), "a\nb\nc\n\n\nd")] == ["a\nb", "c", "d"]
    found = units(spark, lambda t: lines.csv_units(t, 2), "h1,h2\n1,2\n3,4\n")
    assert [u.search_text for u in found] == ["h1,h2\n1,2", "h1,h2\n3,4"]


def unit(text, trail=(), symbols=()):
    return {"display_text": text, "search_text": text, "start_line": 1, "end_line": 1, "start_offset": 0, "end_offset": len(text), "heading_trail": list(trail), "symbols": list(symbols)}


@pytest.mark.parametrize("length", [1, 30, 200, 999])
def test_chunks_fit_and_lose_nothing(length):
    config = IndexConfig(chunk_size_tokens=40, chunk_overlap_tokens=8)
    packer = Packer("a/b.txt", "text", config)
    text = " ".join(f"w{k}" for k in range(length))
    chunks = packer.pack([unit(text), unit("tail", ["H"])])
    assert all(packer.full(c) <= 40 for c in chunks)
    assert {w for c in chunks for w in c["search_text"].split()} == set(text.split()) | {"tail"}
    assert chunks[-1]["heading_trail"] == ["H"] and chunks == packer.pack([unit(text), unit("tail", ["H"])])


def test_embeddings():
    for provider in (ConceptProvider(), DigestProvider(48)):
        v = provider.embed(["retry", "again", ""])
        assert v.shape == (3, provider.dimension) and np.allclose(np.linalg.norm(v, axis=1), 1)
    v = ConceptProvider().embed(["retry", "again", "tls"])
    assert v[0] @ v[1] > 0.9 > v[0] @ v[2]
    tokens = np.array([[[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]]])
    mask = np.array([[1, 1, 0]])
    assert np.allclose(pooled(tokens, mask), [[1 / math.sqrt(5), 2 / math.sqrt(5)]]) and np.allclose(pooled(tokens, mask, "last"), [[0, 1]]) and np.allclose(pooled(tokens, mask, "cls", 1), [[1]])
    with pytest.raises(ValueError):
        pooled(tokens, np.array([[0, 0, 0]]))


def test_ignore_rules(spark):
    paths = ["a/b.log", "a/build/x", "build", "src/x.ts", ".git/config", "docs/deep/y.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = {r.p for r in df.where(~ignored(F.col("p"), ["*.log", "build/", "docs/**/*.md", "# c", ""])).collect()}
    assert kept == {"build", "src/x.ts"}


def test_refused_patterns():
    for bad in ("(a+)+$", "(.*){2,}", r"^(a+)\1$", "x" * 513, "["):
        assert T.anchor_safe(bad)
    assert T.anchor_safe("[a-z]+(?=\\d)") is None


def test_count_tokens_agrees_with_column(spark):
    text = "Hello, wörld_1! 中文 (x)"
    assert spark.range(1).select(T.unicode_token_count(F.lit(text)).alias("n")).first().n == count_tokens(text)


def test_coverage(spark, tmp_path):
    (tmp_path / "lcov.info").write_text("SF:src/a.ts\nFNF:2\nFNH:1\nLF:10\nLH:9\nend_of_record\nSF:lib/b.ts\nLF:5\nLH:0\nend_of_record\n")
    r = coverage(spark, str(tmp_path / "lcov.info"), "src/").first()
    assert (r.files, r.lines_found, r.lines_hit, r.lines_percent, r.functions_percent) == (1, 10, 9, 90.0, 50.0)


def test_bursts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 00:00:05", "2024-01-01 00:01:00"])], "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"))
    assert [r.n_events for r in sessions.bursts(df, "10 seconds").orderBy("first_ts").collect()] == [2, 1]
    assert [r.event_id for r in sessions.replay(df, 0, 2).orderBy("event_id").collect()] == [1, 2]


def test_grep():
    from gleanery.operators.grep import find

    assert find("Banana\nBANANA", "ana")[0] == [(1, 4, 1, 2), (3, 6, 1, 4), (8, 11, 2, 2), (10, 13, 2, 4)]
    assert find("\U0001f642 café\ncafé", "café")[0] == [(3, 7, 1, 4), (8, 12, 2, 1)]
    assert len(find("ab12 cd34", r"[a-z]+(?=\d)", regex=True)[0]) == 2 and len(find("abc", "(?=.)", regex=True)[0]) == 3
    assert find("aaaa", "a", most=2) == ([(0, 1, 1, 1), (1, 2, 1, 2)], True) and find("x", "") == ([], False)


def test_json_leaves():
    from gleanery.functions.jsontext import leaves

    text = '{"b": {"x": [1, 2.0, "s, // not a comment"]}, // note\n "a": null, "t": true, "big": 1e21, }'
    assert leaves(text) == [("b.x[0]", "1"), ("b.x[1]", "2"), ("b.x[2]", "s, // not a comment"), ("a", "null"), ("t", "true"), ("big", "1e+21")]
    assert leaves("{nope") is None and leaves("3") == [("$", "3")]


def test_compatibility_links_and_wrapping(spark):
    one = spark.range(1)
    held = {"dimension": 32, "model": "a", "chunker": 2, "application_version": "1"}
    assert maintenance.differences(held, held | {"model": "b", "pooling": 1}) == ["model", "pooling"]
    said = lambda **changed: maintenance.compatibility(held, held | changed)
    assert (said(), said(application_version="2"), said(chunker=3, application_version="2")) == (("compatible", []), ("migrate", ["application_version"]), ("rebuild", ["chunker"]))
    assert maintenance.compatibility({}, held) == ("missing", [])
    kinds = [one.select(T.link_kind(F.lit(x)).alias("k")).first().k for x in ("HTTPS://a", "#top", "javascript:x", "docs/a.md", None)]
    assert kinds == ["external", "fragment", "blocked", "blocked", "blocked"]
    assert [one.select(T.step_match(F.lit(c), F.lit(n), d).alias("w")).first().w for c, n, d in ((2, 3, 1), (0, 3, -1), (-1, 3, -1), (0, 0, 1))] == [0, 2, 2, -1]


def test_metadata_pool_leaves_out_other_formats_first(spark):
    rows = [(k, f"f{k}", f"f{k}/walk", "walk", "go") for k in range(150)] + [(900, "far", "far/walking.py", "walking.py", "python")]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id string, relative_path string, filename string, format string").withColumns({"heading_trail": F.array().cast("array<string>"), "symbols": F.array().cast("array<string>")})
    asked = spark.createDataFrame([("q", "walk", ["python"]), ("all", "walk", [])], "query_id string, query string, formats array<string>")
    found = retrieval.metadata_pool(chunks, asked).collect()
    assert [(r.chunk_id, r["rank"]) for r in found if r.query_id == "q"] == [(900, 1)]
    assert len([r for r in found if r.query_id == "all"]) == 100


def test_queries_beyond_a_batch_are_asked_in_blocks(spark):
    from gleanery.config import SearchConfig
    from gleanery.plans.retrieval import blocked

    chunks = spark.createDataFrame([(k, f"word{k % 7} shared") for k in range(40)], "chunk_id long, search_text string")
    asked = spark.createDataFrame([(k, f"word{k % 7}") for k in range(23)], "query_id long, query string")
    small = SearchConfig(**{**SearchConfig().__dict__, "max_batch": 6})
    found = blocked(lambda some: retrieval.bm25_pool(chunks, some, small), asked, 6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.bm25_pool(chunks, asked).collect()))
    assert blocked(lambda some: retrieval.bm25_pool(chunks, some, small), asked.limit(0), 6).count() == 0
