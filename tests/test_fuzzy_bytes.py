"""Fuzzy matches of terms with letters of several bytes, as the SQL counts edits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.plans import catalogue

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string", [(k, f"wort {k} für alle", ["fr", "de", "en"][k % 3], f"src{k % 4}") for k in range(60)]),
    "benchmark": ("item_id long, text string", [(1, "Für den"), (2, "fé Mond"), (3, "srcä alle")]),
    "embeddings": ("vec_id long, label int, embedding array<float>", [(k, k % 2, [1.0, float(k % 5)]) for k in range(20)]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fuzzy")
    duck = duckdb.connect()
    for name, (kind, rows) in TABLES.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{root}/{name}.parquet")
        duck.sql(f"create view {name} as select * from '{root}/{name}.parquet/*.parquet'")
    return str(root), duck


@pytest.mark.parametrize("name", ["rrf_fusion", "diverse_excerpts", "hybrid_search"])
def test_query_agrees_with_sql_on_letters_of_two_bytes(spark, tables, name):
    root, duck = tables
    shown = lambda df: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert shown(catalogue.queries()[name](spark, root).toPandas()) == shown(duck.sql(catalogue.oracle_sql()[name]).df())


def test_edits_in_bytes_and_characters(spark):
    kinds = [T.match_kind(F.lit("fr"), F.lit(t), 2, b).alias(f"k{k}") for k, (t, b) in enumerate([("für", False), ("für", True), ("fur", True)])]
    assert tuple(spark.range(1).select(*kinds).first()) == ("fuzzy", None, "fuzzy")
