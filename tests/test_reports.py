"""Reports of a listing, and the match nearest to a line."""

from pyspark.sql import functions as F

from gleanery.operators.evaluation import corpus_report
from gleanery.operators.grep import matches, nearest_match


def test_corpus_report(spark):
    shape = "format string, read_status string, last_error string, size long"
    rows = [("text", "ready", None, 5), ("text", "ready", None, 6), (None, "ready", None, None), ("json", "malformed", "not valid UTF-8", 7), ("json", "unsafe", None, 0), ("bin", "unsupported", "looks like binary data", 9), ("text", None, None, 1)]
    found = {(r.part, r.name): (r.files, r.bytes) for r in corpus_report(spark.createDataFrame(rows, shape)).collect()}
    assert found == {
        ("all", "files"): (7, 28), ("status", "ready"): (3, 11), ("status", "malformed"): (1, 7), ("status", "unsafe"): (1, 0), ("status", "unsupported"): (1, 9), ("status", "unknown"): (1, 1),
        ("format", "text"): (2, 11), ("format", "unknown"): (1, None), ("failure", "not valid UTF-8"): (1, 7), ("failure", "unsafe"): (1, 0),
    }
    assert corpus_report(spark.createDataFrame([], shape)).count() == 0


def test_nearest_match(spark):
    rows = matches(spark.createDataFrame([(1, "a\nb\na\n\na"), (2, "b"), (3, None)], "n int, text string"), F.col("text"), "a")
    asked = rows.select("n", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 4, 5, 9)))).alias("line"), F.col("found.matches").alias("m"))
    found = asked.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("line", nearest_match(F.col("m"), F.col("line")).alias("place")))).alias("p"))
    assert {r.n: [x.place for x in r.p] for r in found.collect()} == {1: [0, 0, 1, 1, 2, 2, 2], 2: [-1] * 7, 3: [-1] * 7}
