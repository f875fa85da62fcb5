from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tarnwork.functions import charged, discounted, hundredths
from tarnwork.sources import load
from tests.tables import SCALES, sf_dir

AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def test_every_cent_and_rate_survives_the_double(spark):
    # 0.07 * 100 is 7.000000000000001 and 0.29 * 100 is 28.999999999999996.
    cents = spark.range(-200_000, 200_000).select("id", (F.col("id") / 100).alias("amount"))
    assert cents.where(hundredths("amount") != F.col("id")).count() == 0


def test_large_amounts(spark):
    amounts = ["90071992547.41", "999999999.99", "-123456789.01"]
    df = spark.createDataFrame([(float(a),) for a in amounts], "a double")
    got = [r[0] for r in df.select(hundredths("a")).collect()]
    assert got == [int(Decimal(a).scaleb(2)) for a in amounts]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("amount", [0.001, 1.005, -12.345, 1e14 + 0.25, 1e16, float("inf"), float("nan")])
def test_what_is_not_whole_hundredths_fails(spark, set_for, amount, ansi):
    df = spark.createDataFrame([(1.0,), (amount,)], "a double")
    with set_for(spark__sql__ansi__enabled=ansi):
        with pytest.raises(SparkRuntimeException, match="not a whole number of hundredths"):
            df.agg(F.sum(hundredths("a"))).collect()


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert df.select(hundredths("a")).first()[0] is None


def test_prices(spark):
    df = spark.createDataFrame([(104_999.91, 0.07, 0.08)], "p double, d double, t double")
    price, discount, tax = (hundredths(c) for c in "pdt")
    row = df.select(discounted(price, discount).alias("d"), charged(price, discount, tax).alias("c")).first()
    net = Decimal("104999.91") * (1 - Decimal("0.07"))
    assert Decimal(row["d"]).scaleb(-4) == net
    assert Decimal(row["c"]).scaleb(-6) == net * (1 + Decimal("0.08"))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_product_out_of_range_fails_in_any_session(spark, set_for, ansi):
    df = spark.createDataFrame([(1e13, 0.0, 0.08)], "p double, d double, t double")
    price, discount, tax = (hundredths(c) for c in "pdt")
    with set_for(spark__sql__ansi__enabled=ansi):
        with pytest.raises(SparkRuntimeException, match="a product passes the bigint range"):
            df.select(charged(price, discount, tax)).collect()
        null = spark.createDataFrame([(None, 0.0, 0.08)], "p double, d double, t double")
        assert null.select(charged(price, discount, tax)).first()[0] is None


@pytest.mark.parametrize("scale", SCALES)
def test_given_amounts_have_two_decimals(spark, scale):
    """What counting in hundredths rests on, checked on every row."""
    df = load(spark, sf_dir(scale), "lineitem")
    for name in AMOUNTS:
        whole = F.rint(F.col(name) * 100)
        assert df.where((whole / 100 != F.col(name)) | F.col(name).isNull()).count() == 0, name
