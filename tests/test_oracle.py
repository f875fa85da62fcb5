"""Every registered query against its SQL in DuckDB, over the whole tables at each scale."""

from __future__ import annotations

import datetime as dt
import importlib

import duckdb
import pytest
from pyspark.errors import SparkRuntimeException

from tarnwork.plans import pricing_summary
from tarnwork.sources import TABLES
from tests.tables import SCALES, line, lineitem, own, sf_dir

ENTRY = importlib.import_module("__spark_entry__")

# The same type under its name in either system.
DUCKDB_TYPE = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT"}


def duckdb_over(base: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", own(ENTRY.oracle_sql()))
def test_query_equals_its_sql(spark, name, scale):
    actual = ENTRY.queries()[name](spark, sf_dir(scale))
    expected = duckdb_over(sf_dir(scale)).sql(ENTRY.oracle_sql()[name])

    assert actual.columns == expected.columns
    assert [DUCKDB_TYPE[t] for _, t in actual.dtypes] == [str(t) for t in expected.types]

    rows = [tuple(row) for row in actual.collect()]
    assert rows, "an empty result tests nothing"
    # Values are compared exactly: nothing is rounded on either side.
    assert rows == expected.fetchall()


def test_every_query_has_sql():
    assert own(ENTRY.queries()) == own(ENTRY.oracle_sql())


def test_sql_refuses_what_the_query_refuses(spark):
    """A third decimal fails on either side."""
    connection = duckdb.connect()
    connection.execute(
        "CREATE TABLE lineitem AS SELECT 'A' AS l_returnflag, 'F' AS l_linestatus, 1.0::DOUBLE AS l_quantity,"
        " 1.005::DOUBLE AS l_extendedprice, 0.1::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax,"
        " TIMESTAMP '2000-01-01' AS l_shipdate"
    )
    with pytest.raises(duckdb.Error, match="not a whole number of hundredths"):
        connection.sql(ENTRY.oracle_sql()["pricing_summary"]).fetchall()
    connection.execute("UPDATE lineitem SET l_extendedprice = 1.25")
    assert len(connection.sql(ENTRY.oracle_sql()["pricing_summary"]).fetchall()) == 1
    with pytest.raises(SparkRuntimeException, match="not a whole number of hundredths"):
        pricing_summary(lineitem(spark, [line(price=1.005)]), dt.date(2001, 1, 1)).collect()


def test_entry_is_the_flagship_on_the_smallest_tables(spark):
    df = ENTRY.entry(spark)
    assert df.columns == [
        "l_returnflag",
        "l_linestatus",
        "sum_qty",
        "sum_base_price",
        "sum_disc_price",
        "sum_charge",
        "avg_qty",
        "avg_price",
        "avg_disc",
        "count_order",
    ]
    assert df.count() == 6
