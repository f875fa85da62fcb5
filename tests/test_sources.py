from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tarnwork.sources import TABLES, day_start, load
from tests.tables import SCALES, sf_dir


@pytest.mark.parametrize("scale", SCALES)
def test_catalog_is_the_given_tables(scale):
    files = {f.removesuffix(".parquet") for f in os.listdir(sf_dir(scale)) if f.endswith(".parquet")}
    assert files == set(TABLES)


@pytest.mark.parametrize("name", TABLES)
def test_every_table_loads(spark, name):
    df = load(spark, sf_dir("0.001"), name)
    assert df.columns and not df.isEmpty()


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
@pytest.mark.parametrize("infer", ["true", "false"])
@pytest.mark.parametrize("stored", ["timestamp", "timestamp_ntz"])
def test_days_are_those_of_the_stored_utc_clock(spark, set_for, tmp_path, zone, infer, stored):
    # pyarrow writes no Spark schema into the file, so Spark has to infer the type.
    table = pq.read_table(f"{sf_dir('0.001')}/events.parquet")
    times = table["ts"].to_pylist()
    if stored == "timestamp":
        at = table.schema.get_field_index("ts")
        table = table.set_column(at, "ts", table["ts"].cast(pa.timestamp("us", tz="UTC")))
    pq.write_table(table, f"{tmp_path}/events.parquet")
    day = dt.date(2024, 1, 15)
    before_day = sum(ts.date() < day for ts in times)
    assert 0 < before_day < len(times)
    settings = {"spark.sql.session.timeZone": zone, "spark.sql.parquet.inferTimestampNTZ.enabled": infer}
    with set_for(**settings):
        df = load(spark, str(tmp_path), "events")
        assert df.where(F.col("ts") < day_start(df, "ts", day)).count() == before_day


def test_missing_column_fails_when_analysed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(AnalysisException):
        load(spark, str(tmp_path), "lineitem").select("l_shipdate")


def test_a_table_may_be_a_directory(spark, tmp_path):
    nation = load(spark, sf_dir("0.001"), "nation")
    nation.repartition(4).write.parquet(f"{tmp_path}/nation.parquet")
    copy = load(spark, f"{tmp_path}/", "nation")
    assert sorted(copy.collect()) == sorted(nation.collect())


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="unknown table 'lineitems'"):
        load(spark, sf_dir("0.001"), "lineitems")
