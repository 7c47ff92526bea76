"""Every query against its SQL on the smallest tables, as the driver compares them."""

import glob
import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from gleanery.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not glob.glob(f"{SF}/*.parquet"):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def shown(value):
    if pd.isna(value):
        return "null"
    if isinstance(value, numbers.Number) and not isinstance(value, (bool, np.bool_)):
        return str(round(float(value), 6) + 0.0)
    return str(value)


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    found = plain(catalogue.queries()[name](spark, SF).toPandas())
    assert found == plain(duck.sql(catalogue.oracle_sql()[name]).df())


def test_sql_belongs_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and catalogue.FLAGSHIP in catalogue.queries()
