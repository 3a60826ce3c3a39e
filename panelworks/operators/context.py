"""Market context: indexes and rates on the session calendar, derived valuation, reconciled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _on_calendar(rows: DataFrame, days: DataFrame, values: list[str], *by: str) -> DataFrame:
    """Every session with the values of its date; a date that a series has twice counts as missing."""
    one = rows.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("_n"), *(F.max(v).alias(v) for v in values)).where("_n = 1").drop("_n")
    grid = days.select("date", "pos")
    if by:
        grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid))  # a row a series and session
    return grid.join(one, [*by, "date"], "left")


def index_context(days: DataFrame, quotes: DataFrame, first_public: DataFrame) -> DataFrame:
    """(index, date, momentum_20, momentum_60, momentum_252, volatility_60) on every session of ``days`` (date, pos).

    ``quotes`` (index, date, close) may follow another calendar: a session without a quote is missing. Quotes before an index's
    first public date (``first_public``: index, date; one without is never public) were made up later and count as missing.
    """
    gate = first_public.select("index", F.col("date").alias("_public"))
    rows = _on_calendar(quotes, days, ["close"], "index").join(gate, "index", "left")
    rows = rows.withColumn("close", F.when((F.col("date") >= F.col("_public")) & (F.col("close") > 0), F.col("close")))
    w = Window.partitionBy("index").orderBy("pos")
    rows = rows.withColumn("step", F.log(F.try_divide("close", F.lag("close").over(w))))
    last60 = w.rowsBetween(-59, 0)
    return rows.select(
        "index", "date", *((F.try_divide("close", F.lag("close", n).over(w)) - 1).alias(f"momentum_{n}") for n in (20, 60, 252)),
        F.when(F.count("step").over(last60) >= 30, F.stddev_samp("step").over(last60) * 252**0.5).alias("volatility_60"),
    )


def rate_context(days: DataFrame, rates: DataFrame) -> DataFrame:
    """(date, rate, change_20, curve) from rates in percent (date, overnight, three_months, twelve_months): the three-month rate, its change
    over 20 sessions, and twelve months over one night."""
    along = Window.orderBy("pos")  # a row a session
    rows = _on_calendar(rates, days, ["overnight", "three_months", "twelve_months"])
    return rows.select(
        "date", (F.col("three_months") / 100).alias("rate"), ((F.col("three_months") - F.lag("three_months", 20).over(along)) / 100).alias("change_20"), ((F.col("twelve_months") - F.col("overnight")) / 100).alias("curve")
    )


def reconciled_records(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Two versions of one record table, unique by keys: ``matched`` rows keep their values, others are ``conflict`` or on one side only."""
    left, right = (x.select(*keys, F.struct(*values).alias(n)) for x, n in ((a, "a"), (b, "b")))
    met = left.join(right, keys, "full_outer")
    status = F.when(F.col("a").isNull(), "second_only").when(F.col("b").isNull(), "first_only").when(F.col("a").eqNullSafe(F.col("b")), "matched").otherwise("conflict")
    met = met.withColumn("status", status)
    return met.select(*keys, "status", *(F.when(F.col("status") == "matched", F.col(f"a.{v}")).alias(v) for v in values))


def valuation_derived(rows: DataFrame) -> DataFrame:
    """``ep``, ``bp``, ``size`` and ``turnover_proxy`` of (pe, pb, market_value, amount); null where a denominator isn't positive."""
    over = lambda n, d: F.when(F.col(d) > 0, n / F.col(d))
    return rows.withColumns({"ep": over(F.lit(1.0), "pe"), "bp": over(F.lit(1.0), "pb"), "size": F.when(F.col("market_value") > 0, F.log("market_value")), "turnover_proxy": over(F.col("amount"), "market_value")})
