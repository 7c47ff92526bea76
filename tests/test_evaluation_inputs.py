"""Judgment files, time left, headings as fragments and batches of a model's inputs."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions.embedding import Profile
from gleanery.functions.text import anchor_id
from gleanery.operators.evaluation import judgments, remaining_ms


def judged(**change):
    one = {"id": "a", "query": "lamp oil", "expectedFiles": ["x.md", "y.md", "x.md"], "category": "concept", "rationale": "both tell of it", "relevantSections": {"x.md": ["Oil"]}}
    return {"version": 1, "name": "lamps", "corpus": "notes", "judgments": [one | change, one | {"id": "b", "relevantSections": None}]}


def test_judgments(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps(judged(), indent=1))
    rows = sorted((r.query_id, r.item, r.sections) for r in judgments(spark, str(path)).collect())
    assert rows == [("a", "x.md", ["Oil"]), ("a", "y.md", None), ("b", "x.md", None), ("b", "y.md", None)]


@pytest.mark.parametrize("change", [{"id": "b"}, {"id": " "}, {"query": ""}, {"expectedFiles": []}, {"expectedFiles": ["x.md", " "]}, {"category": "odd"}, {"rationale": None}, {"relevantSections": {"z.md": ["Oil"]}}, {"relevantSections": {"x.md": []}}])
def test_judgments_refused(spark, tmp_path, change):
    path = tmp_path / "j.json"
    path.write_text(json.dumps(judged(**change)))
    with pytest.raises(ValueError, match="invalid or repeat"):
        judgments(spark, str(path))


def test_judgment_sets_refused(spark, tmp_path):
    path = tmp_path / "j.json"
    for change in ({"version": 2}, {"name": " "}, {"judgments": []}):
        path.write_text(json.dumps(judged() | change))
        with pytest.raises(ValueError, match="another version"):
            judgments(spark, str(path))


def test_time_left(spark):
    rows = spark.createDataFrame([(0, 10, 5), (4, 10, 1000), (10, 10, 70)], "done int, total int, ms int")
    assert [r[0] for r in rows.select(remaining_ms(F.col("done"), F.col("total"), F.col("ms"))).collect()] == [None, 1500, None]


def test_fragments(spark):
    rows = spark.createDataFrame([("  Größe & Gewicht -- 2 ",), ("ﬁnal, step!",), ("!?",), (None,)], "h string")
    assert [r[0] for r in rows.select(anchor_id(F.col("h"))).collect()] == ["große-gewicht-2", "final-step", "", None]


def test_batches_by_rows_and_tokens():
    profile = Profile(batch_rows=3, batch_tokens=100, document_prefix="d: ", query_prefix="q: ", suffix=".")
    assert list(profile.batches([10, 20, 30, 40, 60, 500, 1])) == [range(0, 3), range(3, 4), range(4, 5), range(5, 6), range(6, 7)]
    assert list(profile.batches([])) == [] and list(profile.batches([50, 50])) == [range(0, 2)]
    assert profile.composed("x") == "d: x." and profile.composed("x", query=True) == "q: x."
    with pytest.raises(ValueError):
        Profile(batch_rows=0)
