"""Benchmark definitions, warm medians, comparable settings and report tables."""

import json
import random

import pytest

from gleanery.operators import evaluation

GOOD = {"schemaVersion": 1, "queries": ["a b"], "ignorePatterns": [], "warmRuns": 10, "annThreshold": 1}


def test_definitions():
    assert evaluation.Definition.read(json.dumps(GOOD)) == evaluation.Definition(("a b",), 10, (), 1)
    for change in ({"schemaVersion": 2}, {"queries": []}, {"queries": [" "]}, {"ignorePatterns": [1]}, {"warmRuns": 9}, {"warmRuns": True}, {"annThreshold": 0}, {"queries": None}):
        with pytest.raises(ValueError):
            evaluation.Definition.read(json.dumps(GOOD | change))
    for text in ("[]", "not json"):
        with pytest.raises(ValueError):
            evaluation.Definition.read(text)


def test_warm_medians(spark):
    draw = random.Random(1)
    rows = [(m, q, run, float(draw.randint(1, 50))) for m in "xy" for q in range(7) for run in range(1, draw.randint(2, 9))]
    rows += [("y", 99, 1, 1000.0)]  # never warm
    found = {r.model: (r.queries, r.p50) for r in evaluation.warm_medians(spark.createDataFrame(rows, "model string, query_id long, run int, ms double"), ["model"]).collect()}
    upper = lambda values: sorted(values)[len(values) // 2]
    for model in "xy":
        medians = [upper(own) for q in range(7) if (own := [ms for m, k, run, ms in rows if (m, k) == (model, q) and run > 1])]
        assert found[model] == (len(medians), upper(medians))


def test_settings_of_reports():
    one = {"provider": "small", "dimension": 8, "chunk_size_tokens": 400, "revision": "r1"}
    assert evaluation.incomparable(one, one | {"provider": "base", "dimension": 16}) == []
    assert evaluation.incomparable(one, one | {"revision": "r2", "more": 1}) == ["more", "revision"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("small", 0.5, None), ("base", 0.75, "a|b")], "model string, recall double, note string")
    evaluation.write_report(rows, "model", str(tmp_path / "r"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))) == "| model | recall | note |\n| --- | --- | --- |\n| base | 0.75 | a\\\\|b |\n| small | 0.5 | - |\n"


def test_section_hits_in_the_summary(spark):
    metrics = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, True), (2, 0.0, 0.0, 0.0, 1.0, False), (3, 1.0, 1.0, 0.5, 1.0, None)], "query_id int, recall_5 double, recall_10 double, reciprocal_rank double, distinct_ratio double, section_hit boolean")
    row = evaluation.summary(metrics).first()
    assert row.queries == 3 and row.section_hit == 0.5 and row.reciprocal_rank == 0.5
