"""Pricing summary: what was shipped up to a day, by return flag and line status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions import charged, discounted, hundredths
from tarnwork.operators import exact_sum
from tarnwork.sources import day_start


def pricing_summary(lineitem: DataFrame, shipped_by: dt.date) -> DataFrame:
    """Sums, averages and the row count of the lines shipped on or before a day.

    One pass, and one shuffle of at most one row per scan task and group: a group
    that holds a third of the table is added up inside the scan tasks.
    """
    # `<` the next day keeps lines with a time of day on the last day, without
    # a function on the column that would keep the filter out of the scan.
    end = day_start(lineitem, "l_shipdate", shipped_by + dt.timedelta(days=1))
    # Counted once per row here, and used by several sums.
    counted = lineitem.where(F.col("l_shipdate") < end).select(
        "l_returnflag",
        "l_linestatus",
        *(hundredths(f"l_{name}").alias(name) for name in ("quantity", "extendedprice", "discount", "tax")),
    )
    quantity, price, discount, tax = map(F.col, ("quantity", "extendedprice", "discount", "tax"))
    sum_qty = exact_sum(quantity, 2, wide=False)
    sum_price = exact_sum(price, 2)
    sum_discount = exact_sum(discount, 2, wide=False)
    return (
        counted.groupBy("l_returnflag", "l_linestatus")
        .agg(
            sum_qty.alias("sum_qty"),
            sum_price.alias("sum_base_price"),
            exact_sum(discounted(price, discount), 4).alias("sum_disc_price"),
            exact_sum(charged(price, discount, tax), 6).alias("sum_charge"),
            _mean(sum_qty, quantity).alias("avg_qty"),
            _mean(sum_price, price).alias("avg_price"),
            _mean(sum_discount, discount).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _mean(total: Column, values: Column) -> Column:
    # Without values the total is null, and null / 0 is null.
    return total.cast("double") / F.count(values)
