"""Where the given tables lie, and small lineitem tables for single cases."""

from __future__ import annotations

import datetime as dt
import re

TESTDATA = "/root/testdata"
SCALES = ("0.001", "0.01", "0.1")

LINEITEM = (
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def own(names) -> list[str]:
    """The queries of this part; the numbered ones and the pipeline have tests of their own."""
    return sorted(n for n in names if not re.match(r"op\d+_|pipeline$", n))


def sf_dir(scale: str) -> str:
    return f"{TESTDATA}/sf{scale}"


def line(
    quantity=1.0,
    price=100.0,
    discount=0.1,
    tax=0.05,
    flag="A",
    status="F",
    shipped=dt.datetime(2000, 1, 1),
):
    return (quantity, price, discount, tax, flag, status, shipped)


def lineitem(spark, rows):
    return spark.createDataFrame(rows, LINEITEM)
