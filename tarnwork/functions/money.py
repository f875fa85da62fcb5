"""Money as whole numbers.

Amounts and rates are stored as doubles with two decimals. Counting them in
hundredths makes every product an exact bigint that stays in generated code:
doubles lose cents once a sum is long, and depend on the order of addition;
decimals are exact but were about nine times slower per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A double holds every whole number up to here.
MAX_WHOLE = 2**53


def hundredths(name: str) -> Column:
    """A column of amounts or rates, in hundredths (scale 2).

    An amount with more decimals, NaN or infinity fails the query: rounding row by
    row would falsify the total. Division rounds correctly, so a stored amount of
    two decimals is the very double that its hundredths divided by 100 give.

    In SQL, because one expression is one call to the JVM and chained column
    methods are fifteen.
    """
    whole = f"rint(`{name}` * 100)"
    return F.expr(
        f"CASE WHEN {whole} / 100 <> `{name}` OR abs({whole}) > {MAX_WHOLE}"
        f" THEN raise_error('not a whole number of hundredths: ' || CAST(`{name}` AS STRING))"
        f" ELSE CAST({whole} AS BIGINT) END"
    )


def discounted(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` of two columns in hundredths, at scale 4."""
    return _product(price, 100 - discount)


def charged(price: Column, discount: Column, tax: Column) -> Column:
    """``price * (1 - discount) * (1 + tax)`` of three columns in hundredths, at scale 6."""
    return _product(discounted(price, discount), 100 + tax)


def _product(a: Column, b: Column) -> Column:
    """``a * b``; a product past the bigint range fails the query in any session."""
    product = F.try_multiply(a, b)
    lost = product.isNull() & a.isNotNull() & b.isNotNull()
    return F.when(lost, F.raise_error(F.lit("a product passes the bigint range"))).otherwise(product)
