"""Units with their places: entities, HTML, XML, JSON, fences, and files in which a format's rules find nothing."""

import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions import jsontext
from gleanery.index import extracted
from gleanery.operators import lines


def test_entities_are_read_once(spark):
    shown = {
        "&#38;lt;b&gt;": "&lt;b>", "&#x00000041;": "A", "&amp;lt;": "&lt;", "&#xD800; &#0; &#9999999999;": "&#xD800; &#0; &#9999999999;", "a&nbsp;b &QUOT;x&#39;": "a b \"x'",
        "&#x1F642;&#128578;": "🙂🙂", "&unknown; & &#; &#x;": "&unknown; & &#; &#x;", "<b>1 &lt; 2</b>": "1 < 2", "": "",
    }
    rows = spark.createDataFrame(list(shown.items()), "raw string, expect string").select("expect", lines.visible_text(F.col("raw")).alias("got")).collect()
    assert [r.got for r in rows] == [r.expect for r in rows]


def units(spark, fmt, text, name="f"):
    found = extracted(spark.createDataFrame([(name, fmt, text)], "file_id string, format string, text string")).orderBy("start_offset", "end_offset").collect()
    return [(r.search_text, r.start_line, r.end_line, r.start_offset, r.end_offset) for r in found]


def test_places_of_json_leaves(spark):
    text = '{ // c\r\n "a": [1,\n 2, {"k": "v,"}],\n "a.b": null,\n}'
    assert units(spark, "json", text) == [("a[0]: 1", 2, 2, 14, 15), ("a[1]: 2", 3, 3, 18, 19), ("a[2].k: v,", 3, 3, 27, 31), ("a.b: null", 4, 4, 43, 47)]
    assert units(spark, "json", '"alone"') == [("$: alone", 1, 1, 0, 7)]
    assert units(spark, "json", "{broken\nlines") == [("{broken\nlines", 1, 2, 0, 13)]  # 30-line records


def test_every_leaf_of_json_has_the_place_of_its_value():
    import json
    import random

    draw = random.Random(2)

    def value(depth):
        kind = draw.randrange(4 if depth else 2)
        if kind == 2:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        if kind == 3:
            return {draw.choice(["a", "b c", "x.y", '"', "[0]"]) + str(k): value(depth - 1) for k in range(draw.randint(0, 3))}
        return draw.choice([None, True, draw.randint(-9, 999), draw.random(), "", 'q"\\', "}],:{[", "é中🙂", "// no"])

    for _ in range(300):
        text = json.dumps(value(4), indent=draw.choice([None, 2]), ensure_ascii=draw.random() < 0.5)
        for leaf in jsontext.placed_leaves(text):
            assert jsontext._shown(json.loads(text[leaf["start_offset"] : leaf["end_offset"]])) == leaf["value"]
            assert leaf["start_line"] == text.count("\n", 0, leaf["start_offset"]) + 1


def test_places_of_xml_and_html(spark):
    xml = "<a>\n <b>one</b>\n\n <c k='1'>two\n2</c></a>\n"
    assert units(spark, "xml", xml) == [("b: one", 2, 2, 5, 15), ("c: two\n2", 4, 5, 18, 36)]
    html = "<html><head>\n<title>T &amp; U</title>\n</head><body>\n\nloose<nav>menu\n</nav>\n<h1>Top</h1>\n<p>one<script>x\ny</script> two</p>\n</body></html>"
    assert units(spark, "html", html) == [("T & U", 2, 2, 13, 37), ("loose", 5, 5, 53, 58), ("Top", 7, 7, 75, 87), ("one two", 8, 9, 88, 122)]
    for text, start, end in ((xml, 5, 15), (html, 75, 87)):
        assert text[start:end] in ("<b>one</b>", "<h1>Top</h1>")


@pytest.mark.parametrize("fmt, text", [("xml", "<a/>\nplain only\n"), ("yaml", "# only\n# comments\n"), ("toml", "# none\n\n\n# more\n")])
def test_files_without_units_of_their_own_keep_their_text(spark, fmt, text):
    found = units(spark, fmt, text)
    assert found and "".join(u[0] for u in found).replace("\n", "") == text.replace("\n", "")


def test_yaml_keys(spark):
    text = "a:\n  b: 1\n  c:\n    - d\n    - e: 2\nf: 3\n"
    assert [u[:2] for u in units(spark, "yaml", text)] == [("a:", 1), ("a.b: 1", 2), ("a.c:", 3), ("a.c[]: d", 4), ("a.c.e: 2", 5), ("f: 3", 6)]


def test_long_files_take_time_by_their_length(spark):
    """100,000 lines of alternating fences, and as many indented keys."""
    began = time.monotonic()
    text = "\n".join(("```", "code ~~~", "~~~", "```", "words")[k % 5] for k in range(100_000))
    files = spark.createDataFrame([("f", text)], "file_id string, text string")
    kinds = {r.kind: r.n for r in lines.markdown_units(lines.line_table(files)).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"code": 20_000, "paragraph": 20_000}
    keys = "\n".join(" " * (k % 40) + f"k{k}: {k}" for k in range(100_000))
    table = lines.line_table(spark.createDataFrame([("y", keys)], "file_id string, text string"))
    last = lines.keyed_line_units(table, "yaml").where("start_line = 99999").first()
    assert last.symbol.count(".") == 38 and last.symbol.endswith("k99998")
    assert time.monotonic() - began < 120


def test_only_changed_files_are_opened(spark, tmp_path, monkeypatch):
    """One file with a whole-second time and one that is new, of many: these two are read, whatever lies between their times."""
    import os

    from gleanery.functions.embedding import DigestProvider
    from gleanery.index import Indexer
    from gleanery.sources import files as source
    from gleanery.sources.store import SnapshotStore

    root = tmp_path / "r"
    root.mkdir()
    at = 1_700_000_000_123_000_000
    for k in range(12):
        (root / f"n[{k}].txt").write_text(f"words {k}")
        os.utime(root / f"n[{k}].txt", ns=(at + k * 10**9, at + k * 10**9))
    os.utime(root / "n[0].txt", ns=(1_700_000_000_000_000_000,) * 2)
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), DigestProvider())
    indexer.run(source.listed(spark, str(root)))
    (root / "new*.txt").write_text("new words")
    found = source.listed(spark, str(root), None, indexer.known())
    assert sorted(r.relative_path for r in found.where("text is not null").collect()) == ["n[0].txt", "new*.txt"] and found.count() == 13
    monkeypatch.setattr(source, "BY_NAME", 1)
    again = source.listed(spark, str(root), None, indexer.known())
    assert sorted(r.relative_path for r in again.where("text is not null").collect()) == ["n[0].txt", "new*.txt"] and again.count() == 13
    assert indexer.run(found) == {"content": 1, "unchanged": 12}
