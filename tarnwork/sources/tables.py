"""The tables queries read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table from ``base``; ``<name>.parquet`` may be a file or a directory.

    The schema comes from a parquet footer, so a missing column fails when the
    plan is analysed. A declared schema would read it as nulls instead.

    Times keep the type that Spark gives them, for the filter on a UTC instant skips row
    groups and one on a ``timestamp_ntz`` does not. Compare them with ``day_start``.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def day_start(df: DataFrame, column: str, day: dt.date) -> Column:
    """The start of a day on the stored UTC clock, to compare a column of ``df`` with.

    For a ``timestamp`` it is an instant, the same in any session's time zone.
    """
    if isinstance(df.schema[column].dataType, T.TimestampType):
        midnight = dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc)
        return F.timestamp_seconds(F.lit(int(midnight.timestamp())))
    return F.lit(day)
