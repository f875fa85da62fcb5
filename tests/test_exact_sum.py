from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException, SparkRuntimeException
from pyspark.sql import functions as F

from tarnwork.operators import exact_sum

BIGINT = st.integers(-(10**12), 10**12)


def total(spark, values, scale=0, partitions=3, **kwargs):
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(partitions)
    return df.agg(exact_sum(F.col("v"), scale, **kwargs).alias("t")).first()["t"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(BIGINT, st.none()), min_size=1, max_size=50), scale=st.sampled_from([0, 2, 6]))
def test_equals_python_integers(spark, values, scale):
    known = [v for v in values if v is not None]
    expected = Decimal(sum(known)).scaleb(-scale) if known else None
    assert total(spark, values, scale) == expected


@pytest.mark.parametrize("values", [[-1], [-1, 1], [-(2**20), 2**20 - 1], [-(2**40) - 1, 2**40], [0]])
def test_signs_around_the_word_boundary(spark, values):
    assert total(spark, values) == sum(values)


def test_passes_the_bigint_range(spark):
    rows, value = 1000, 9 * 10**16
    df = spark.range(rows).select(F.lit(value).alias("v"))
    with pytest.raises(ArithmeticException):
        df.agg(F.sum("v")).first()
    assert df.agg(exact_sum(F.col("v"), 6).alias("t")).first()["t"] == Decimal(rows * value).scaleb(-6)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_narrow_sum_fails_loudly_out_of_range(spark, set_for, ansi):
    df = spark.range(1000).select(F.lit(9 * 10**16).alias("v"))
    with set_for(spark__sql__ansi__enabled=ansi):
        with pytest.raises(SparkRuntimeException, match="a sum passes the bigint range"):
            df.agg(exact_sum(F.col("v"), 2, wide=False)).first()


def test_narrow_and_wide_agree(spark):
    values = [5, -7, 123_456, None, 10**6]
    assert total(spark, values, 2) == total(spark, values, 2, wide=False) == Decimal("11234.54")


def test_scale_and_type(spark):
    df = spark.range(3).agg(exact_sum(F.col("id"), 4).alias("t"))
    assert df.dtypes == [("t", "decimal(38,4)")]
    assert str(df.first()["t"]) == "0.0003"


@pytest.mark.parametrize("wide", [True, False])
def test_largest_scale_keeps_every_digit(spark, wide):
    values = [2**62, -1]
    assert total(spark, values, 9, wide=wide) == Decimal(sum(values)).scaleb(-9)


@pytest.mark.parametrize("scale", [-1, 10])
def test_scale_that_would_round_is_refused(scale):
    with pytest.raises(ValueError, match="scale must be between 0 and 9"):
        exact_sum(F.col("v"), scale)


@pytest.mark.parametrize("wide", [True, False])
def test_null_without_values(spark, wide):
    assert total(spark, [None, None], wide=wide) is None
    empty = spark.range(0).agg(exact_sum(F.col("id"), 0, wide).alias("t"))
    assert empty.first()["t"] is None


def test_any_partitioning_gives_the_same_total(spark):
    values = [(-1) ** i * (i * 7_919_000_017 % 10**12) for i in range(2000)]
    assert {total(spark, values, 6, partitions=n) for n in (1, 2, 7, 31)} == {Decimal(sum(values)).scaleb(-6)}
