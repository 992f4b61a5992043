"""Exact money and count arithmetic.

Sums are taken in decimal, never in double, so results are identical on
every engine and every partitioning. Output types are fixed: counts and
quantity sums ``bigint``, money ``decimal(38,2)``, averages ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_OUT = "decimal(38,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_total(qty="quantity", price="unit_price") -> Column:
    """quantity x unit price, exact (int x decimal(10,2) -> decimal(21,2))."""
    return _c(qty) * _c(price)


def money(x) -> Column:
    return _c(x).cast(MONEY_OUT)


def sum_money(x) -> Column:
    return F.sum(_c(x)).cast(MONEY_OUT)


def sum_qty(x="quantity") -> Column:
    return F.sum(_c(x)).cast("bigint")


def count_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def avg_money(x) -> Column:
    """AVG of a decimal expression as double: exact sum, then one division."""
    return (F.sum(_c(x)).cast("double") / F.count(_c(x))).cast("double")
