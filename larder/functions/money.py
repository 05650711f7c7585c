"""Exact money arithmetic.

An order line is assigned to a `numeric(12,2)` slot, so it is rounded half away
from zero per line and then summed (`to_money` on each line). The costing view
sums `quantity * unit_price` at scale 5 unrounded. Spark's decimal cast rounds
half away from zero and, with ANSI mode on, raises on overflow, like Postgres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schemas import MONEY, QTY


def to_money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def to_qty(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(QTY)


def money_zero() -> Column:
    return F.lit(0).cast(MONEY)


def margin_pct(profit: Column, price: Column) -> Column:
    """round(profit / price * 100, 2); NULL when the price is NULL or 0.

    A `sum` widens to decimal(35+, 5); dividing such a wide type leaves only
    scale 6 and rounds twice. Narrowing the numerator to decimal(18,5) first
    keeps an 18-digit quotient, so the one rounding that counts is the last.
    """
    ratio = profit.cast("decimal(18,5)") / price.cast("decimal(18,5)") * F.lit(100)
    return F.when(price.isNull() | (price == 0), F.lit(None)).otherwise(F.round(ratio, 2))
