"""The Spark session, with the settings that change results pinned."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only settings that decide *what* a query returns. Sizing (shuffle partitions,
# split size, memory, checkpoint folder) belongs to the cluster.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # An overflow must fail the job, not wrap around into a plausible number.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_session(app_name: str = "tarnwork", **settings: str) -> SparkSession:
    """Return the running session, or start one, with the result settings applied.

    ``settings`` takes further Spark settings with ``__`` for the dots, e.g.
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    for key, value in RESULT_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
