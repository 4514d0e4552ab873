"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from granary.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(round(x, 6)) if isinstance(x, float) or isinstance(x, int) and not isinstance(x, bool) else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found, expected = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) and rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_points_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
