from __future__ import annotations

import importlib

import pytest

from tarnwork.session import RESULT_SETTINGS, get_session
from tests.tables import own, sf_dir

ENTRY = importlib.import_module("__spark_entry__")


def test_result_settings_are_applied(spark):
    for key, value in RESULT_SETTINGS.items():
        assert spark.conf.get(key) == value


def test_running_session_is_reused_and_put_right(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    assert get_session() is spark
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_checkpoint_folder_is_left_to_the_cluster(spark):
    assert not any("checkpoint" in key for key in RESULT_SETTINGS)


@pytest.mark.parametrize(
    "settings",
    [
        {"spark.sql.ansi.enabled": "false"},
        {"spark.sql.session.timeZone": "America/Los_Angeles"},
        {"spark.sql.session.timeZone": "Asia/Tokyo", "spark.sql.parquet.inferTimestampNTZ.enabled": "false"},
        {"spark.sql.session.timeZone": "America/Los_Angeles", "spark.sql.parquet.inferTimestampNTZ.enabled": "false"},
        {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"},
        {"spark.sql.codegen.wholeStage": "false"},
        {"spark.sql.files.maxPartitionBytes": "100000"},
    ],
    ids=lambda settings: ",".join(key.removeprefix("spark.sql.") for key in settings),
)
@pytest.mark.parametrize("name", own(ENTRY.queries()))
def test_queries_do_not_depend_on_the_callers_session(spark, set_for, name, settings):
    query = ENTRY.queries()[name]
    expected = query(spark, sf_dir("0.01")).collect()
    with set_for(**settings):
        assert query(spark, sf_dir("0.01")).collect() == expected
