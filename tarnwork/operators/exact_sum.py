"""Exact sums of scaled whole numbers, over groups too large for one bigint."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20
# 28 digits of total times 10**-scale has to fit a decimal of 38 digits unrounded.
MAX_SCALE = 9


def exact_sum(units: Column, scale: int, wide: bool = True) -> Column:
    """Sum a bigint column counted in 10**-scale, as ``decimal(38, scale)``.

    A plain bigint sum of charges overflows at some 10**8 rows in one group. The
    low 20 bits and the rest are therefore summed apart, both as bigint with
    ordinary partial aggregation, and put together once per group. That holds
    for 8.7 * 10**12 rows per group while ``abs(units) <= 10**12``.

    ``wide=False`` keeps to one bigint, which holds for as many rows while
    ``abs(units) <= 10**6``. Beyond either range the query fails, in any session.

    The result does not depend on the order of addition, so a task that runs
    again on another executor changes nothing. Like ``sum``, it skips nulls and
    is null for a group without values.
    """
    if not 0 <= scale <= MAX_SCALE:
        raise ValueError(f"scale must be between 0 and {MAX_SCALE}, not {scale}")
    if wide:
        high = F.try_sum(F.shiftright(units, LOW_BITS)).cast("decimal(19,0)")
        low = F.try_sum(units.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).cast("decimal(19,0)")
        total = high * F.lit(Decimal(1 << LOW_BITS)) + low
    else:
        total = F.try_sum(units).cast("decimal(19,0)")
    lost = total.isNull() & (F.count(units) > 0)
    checked = F.when(lost, F.raise_error(F.lit("a sum passes the bigint range"))).otherwise(total)
    return (checked * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
