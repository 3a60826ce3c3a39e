"""Streaming form of the daily aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Append-mode daily bars of a stream (code, ts, price, and tie where ts repeats); days close when the watermark passes them.

    As in the batch form: open and close are the first and last positive price by (ts, tie), the amount is an exact sum and
    null where a price is missing.
    """
    traded, order = F.col("price") > 0, F.struct(*(c for c in ("ts", "tie") if c in ticks.columns))
    return (
        ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("day"), "code")
        .agg(
            F.min_by("price", F.when(traded, order)).alias("open"), F.max_by("price", F.when(traded, order)).alias("close"),
            F.max(F.when(traded, F.col("price"))).alias("high"), F.min(F.when(traded, F.col("price"))).alias("low"),
            F.when(F.count("price") == F.count(F.lit(1)), F.sum(F.col("price").cast("decimal(18,4)"))).cast("double").alias("amount"),
            F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("price") < 0).alias("negative"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        )
        .select("code", F.to_date("day.start").alias("date"), "open", "close", "high", "low", "amount", "ticks", "negative", "first_ts", "last_ts")
    )
