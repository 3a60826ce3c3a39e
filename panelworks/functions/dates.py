"""Dates as positions on a calendar, so that bounds become equi-joins. Calendars have a row a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_sessions(days: DataFrame) -> DataFrame:
    """(day, pos): every calendar day up to the last session with the position of the first session from it on; ``days`` (date, pos).

    Days before the first session are not in it; their position is 0.
    """
    before = F.coalesce(F.date_add(F.lag("date").over(Window.orderBy("pos")), 1), F.col("date"))
    return days.withColumn("since", before).select(F.explode(F.sequence("since", "date")).alias("day"), "pos")


def position_from(rows: DataFrame, days: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the position of the first session from the date ``column`` on; null for no date and beyond the calendar."""
    first = F.broadcast(days.agg(F.min("date").alias("_first")))  # one row
    met = rows.join(next_sessions(days).select(F.col("day").alias(column), F.col("pos").alias("_pos")), column, "left").crossJoin(first)
    return met.withColumn(name, F.when(F.col(column) < F.col("_first"), 0).otherwise(F.col("_pos"))).drop("_pos", "_first")


def on_days(spans: DataFrame, dates: DataFrame, first: str, until: str) -> DataFrame:
    """A row for each of ``dates`` (date) in a span's [first, until); a null ``until`` is open, a null ``first`` has none."""
    ranked = dates.distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).cast("int").alias("_n")))  # one row
    placed = position_from(position_from(spans, ranked, first, "_a"), ranked, until, "_b").crossJoin(n)
    stop = F.coalesce("_b", "_n")
    placed = placed.where(F.col("_a").isNotNull() & (F.col("_a") < stop)).withColumn("_to", stop - 1)
    unfolded = placed.withColumn("pos", F.explode(F.sequence("_a", "_to"))).drop("_a", "_b", "_n", "_to")
    return unfolded.join(ranked, "pos").drop("pos")
