"""What one task does stays the same as tables grow."""

import random
from datetime import datetime, timedelta
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from gleanery.config import IndexConfig
from gleanery.functions import chunks
from gleanery.functions.text import js_trim
from gleanery.llm import language_id
from gleanery.operators import fragments, lines, retrieval
from gleanery.streaming import sessions


def test_metadata_is_dealt_out_by_number_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS_A_TASK", 10)
    none = F.array().cast("array<string>")
    chunks = spark.range(0, 100, 1, 1).select(F.col("id").alias("chunk_id"), F.lit("f").alias("file_id"), F.lit("a/f").alias("relative_path"), F.lit("f.md").alias("filename"), none.alias("heading_trail"), none.alias("symbols"))
    found = retrieval._described(chunks)
    sizes = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in sizes) == 300 and len(sizes) >= 8 and max(r.n for r in sizes) < 100


def test_terms_and_scores_are_dealt_out_by_number(spark, monkeypatch):
    chunks = spark.range(0, 100, 1, 1).select(F.col("id").alias("chunk_id"), F.concat(F.lit("tea leaf "), F.col("id").cast("string")).alias("search_text"))
    queries = spark.createDataFrame([("q", "tea 7"), ("r", "leaf")], "query_id string, query string")
    whole = {tuple(r) for r in retrieval.bm25_pool(chunks, queries).collect()}
    monkeypatch.setattr(retrieval, "TEXTS_A_TASK", 10)
    monkeypatch.setattr(retrieval, "HITS_A_TASK", 20)
    index = retrieval.TextIndex.of(chunks, queries)
    assert len(index.postings.inputFiles()) >= 8
    assert {tuple(r) for r in retrieval.bm25_pool(index, queries).collect()} == whole and len(whole) == 200


def test_nearest_of_many_equals(spark):
    chunks = spark.range(0, 300, 1, 1).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("vector"))
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [1.0, 1.0])], "query_id string, query_vector array<double>")
    found = retrieval.vector_pool(chunks, queries, retrieval.SearchConfig(vector_candidates=160)).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in found] == [*range(0, 300, 2), *range(1, 21, 2), *range(1, 300, 2), *range(0, 20, 2)]


@pytest.mark.parametrize("cells", [1, 3, 4096])
def test_bursts_by_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(sessions, "CELLS", cells)
    rng = random.Random(7)
    steps = [rng.choice([0, 1, 40, 99, 99.999999, 100, 100.000001, 101, 250, 5000]) for _ in range(300)]
    at = [datetime(1969, 12, 31, 23, 0) + timedelta(seconds=s) for s in accumulate(steps)]
    wanted, held = [], None
    for ts in at:
        if held is None or ts - held[1] >= timedelta(seconds=100):
            held = [ts, ts, 0]
            wanted.append(held)
        held[1], held[2] = ts, held[2] + 1
    events = spark.createDataFrame([(t,) for t in [*at, None]], "ts timestamp_ntz").repartition(5)
    found = sessions.bursts(events, "100 seconds")
    assert [list(r) for r in found.orderBy("first_ts").select("first_ts", "last_ts", "n_events").collect()] == wanted
    plan = found._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("HashAggregate")[0] and "session_window" not in plan


def test_ranges_are_placed_in_parts_of_texts(spark, monkeypatch):
    monkeypatch.setattr(lines, "TEXTS_A_TASK", 10)
    texts = spark.range(0, 100, 1, 1).select("id", F.lit("The heat; theat dede").alias("text"))
    found = lines.highlight_ranges(texts, ["the", "heat", "de"]).withColumn("part", F.spark_partition_id()).collect()
    assert {(r.start, r.end) for r in found} == {(0, 3), (4, 8), (10, 15), (16, 20)} and len(found) == 400 and len({r.part for r in found}) >= 8


def test_links_alone_are_those_of_the_preview(spark):
    pages = spark.createDataFrame([("<p><a href='https://a.b/c'>x <b>y</b></a><a href='https://a.b/c'>z</a><a href='/d'>d</a>",), ("",), (None,)], "html string")
    rows = pages.select(fragments.linked(F.col("html")).alias("own"), fragments.previewed(F.col("html"))["links"].alias("links")).collect()
    assert [r.own for r in rows] == [r.links for r in rows] and rows[0].own[0].label == "x y"


def test_least_score_counts_all_documents(spark):
    """Of 1,200 texts of one language 20, or 10, are far from its profile: a sample of 500 need not show how many."""
    english = "the quick brown fox jumps over the lazy dog and runs through the green field"
    docs = spark.createDataFrame([(k, english if k % 60 else "zq xj", "en") for k in range(1200)], "doc_id long, text string, lang string")
    profiles = language_id.RankProfiles({"en": [int(c) for c in language_id.ranked(language_id.ngrams(english), 300)]}, 300)
    odd, usual = profiles.predict("zq xj")[1], profiles.predict(english)[1]
    assert odd < usual and language_id.least_score(docs, profiles) == int(odd * language_id.STEPS) / language_id.STEPS / 2
    fewer = docs.where("text != 'zq xj' or doc_id < 600")
    assert language_id.least_score(fewer, profiles) == int(usual * language_id.STEPS) / language_id.STEPS / 2


def test_a_text_is_read_once_to_be_packed(monkeypatch):
    """Parts are counted from one reading, not by reading each part that may fit."""
    seen = []
    kinds, words = chunks._kinds(), chunks._WORD_OR_SIGN

    class Watched:
        def findall(self, text):
            seen.append(len(text))
            return words.findall(text)

    monkeypatch.setattr(chunks, "_WORD_OR_SIGN", Watched())
    text = " ".join(f"w{k}, x" for k in range(4000))
    unit = {"display_text": text, "search_text": text, "start_line": 1, "end_line": 1, "start_offset": 0, "end_offset": len(text), "heading_trail": [], "symbols": []}
    packed = chunks.Packer("a.txt", "text", IndexConfig()).pack([unit])
    assert len(packed) > 30 and sum(seen) < len(text) and len(kinds) == 0x110000
    # a count of another kind is asked for each part, with the same result
    assert chunks.Packer("a.txt", "text", IndexConfig(), lambda t: chunks.count_tokens(t)).pack([unit]) == packed


@pytest.mark.parametrize("text", ["", "a", "ab, c!!d\n é_1中 \x1c\u0085", "😀a😀\U000104a0b", " \t x"])
def test_counts_of_parts(text):
    counts = chunks.part_counts(text)
    assert all(counts(a, b) == chunks.count_tokens(text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))


def test_trimmed_as_in_javascript(spark):
    """U+0085 is no white space there, and what stands before it stays."""
    white = " \t\n\v\f\r ﻿       　"
    rows = spark.createDataFrame([(f"{white}a b{white}",), (white,), ("a \u0085",), (None,)], "t string").select(js_trim(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["a b", "", "a \u0085", None]


def test_line_ends_and_marks(spark):
    rows = spark.createDataFrame([("﻿﻿a\r\r\nb\rc\n\r\n",), (None,), ("﻿",)], "t string").select(lines.normalized(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["﻿a\n\nb\nc\n\n", "", ""]


def test_texts_without_marks_are_not_taken_apart(spark, monkeypatch):
    """Only bodies that hold a mark are cut into lines; the others come out trimmed, as they would otherwise."""
    texts = ["plain, with (signs)\nand 3. no mark\n", " a\n  - b\n> c", "# h", "x [y](z) *w*", "a\n\n1) b", "a\r2. b", "", "_", "a # b - c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.t for r in rows.select(lines.cleaned(F.col("t")).alias("t")).collect()]
    monkeypatch.setattr(lines, "MARKED", "")
    assert found == [r.t for r in rows.select(lines.cleaned(F.col("t")).alias("t")).collect()]
    assert found[0] == "plain, with (signs)\nand 3. no mark" and found[1] == "a\nb\nc" and found[3] == "x y w"


def test_long_scripts_and_rows_of_tags(spark):
    """Their length is no depth of a call stack, which ended the session before."""
    html = "<p>a</p><script>" + "x;\n" * 70_000 + "</script>b" + "<i>" * 20_000 + "<p>c &amp; d</p>\n" + "<i>" * 20_000 + "\n e"
    found = lines.html_units(spark.createDataFrame([("f", html)], "file_id string, text string")).orderBy("unit").collect()
    assert [(r.kind, r.search_text, r.start_line, r.end_line) for r in found] == [("paragraph", "a", 1, 1), ("text", "b", 70_001, 70_001), ("paragraph", "c & d", 70_001, 70_001), ("text", "e", 70_003, 70_003)]
