"""Expressions over a security's sessions. Missing sessions occupy a slot; nulls are never filled."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("security_id",)


def sessions(keys=KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("pos")


def last_n(n: int, keys=KEYS) -> WindowSpec:
    return sessions(keys).rowsBetween(-(n - 1), 0)


def at_least(value: Column, counted: Column, least: int, over: WindowSpec) -> Column:
    """value, if the frame holds at least ``least`` non-null values of ``counted``."""
    return F.when(F.count(counted).over(over) >= least, value)


def ratio_to(column: str, n: int, keys=KEYS) -> Column:
    """Change against n sessions ago; null when either side is missing or zero."""
    old = F.lag(column, n).over(sessions(keys))
    return F.when(old != 0, F.col(column) / old - 1)


def average_rank(value: Column, *partition: str) -> Column:
    """Percentile rank in (0, 1] with average ties among the partition's non-null values; null stays null.

    All three counts come from one partitioning and one order, so a rank costs one exchange, one sort and one pass over the
    partition: the mean of the first and last place of equal values, over the number of values.
    """
    order = Window.partitionBy(*partition).orderBy(value.asc_nulls_last())
    last = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    known = F.count(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(value.isNotNull(), F.try_divide((F.rank().over(order) + last) / F.lit(2.0), known))
