from __future__ import annotations

import contextlib
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tarnwork.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        spark__master="local[8, 4]",  # a failed task runs again, as on a cluster
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def set_for(spark):
    """A context in which the session has other settings."""

    @contextlib.contextmanager
    def context(**settings):
        settings = {key.replace("__", "."): value for key, value in settings.items()}
        before = {key: spark.conf.get(key) for key in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    return context
