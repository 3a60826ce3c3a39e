"""Point-in-time joins, data quality and minute aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.sources.tables import dense_panel


def versions_asof(observations: DataFrame, versions: DataFrame) -> DataFrame:
    """Each observation with the last version published by then; a version of an older period than one seen before is passed over.

    Versions become half-open intervals, merged with the observations in one shuffle by security: a union sorted by
    time and a running last, so that no range join is needed.
    """
    seen = Window.partitionBy("security_id").orderBy("published_at", "version").rowsBetween(Window.unboundedPreceding, 0)
    kept = versions.withColumn("top", F.max("period_end").over(seen)).where("period_end = top").drop("top")
    facts = kept.select("security_id", F.col("published_at").alias("at"), F.lit(0).alias("kind"), "version", F.struct("period_end", "value", "version").alias("fact"))
    asks = observations.select("security_id", F.col("date").cast("timestamp").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("version"), F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"))
    along = Window.partitionBy("security_id").orderBy("at", "kind", "version").rowsBetween(Window.unboundedPreceding, 0)
    both = facts.unionByName(asks).withColumn("known", F.last("fact", True).over(along))
    return both.where("kind = 1").select("security_id", F.col("at").cast("date").alias("date"), "known.period_end", "known.value", "known.version")


def missing_sessions(bars: DataFrame) -> DataFrame:
    """Sessions between a security's first and last bar without a bar."""
    return dense_panel(bars.select("security_id", "date", F.lit(1).alias("close"))).where("NOT quoted").select("security_id", "date")


def daily_from_ticks(ticks: DataFrame) -> DataFrame:
    """Daily bars and diagnostics of (code, ts, price, tie): first and last traded price, extremes, counts, exact amount."""
    traded = F.col("price") > 0
    order = F.struct("ts", "tie")
    return ticks.groupBy("code", F.to_date("ts").alias("date")).agg(
        F.min_by("price", F.when(traded, order)).alias("open"),
        F.max_by("price", F.when(traded, order)).alias("close"),
        F.max(F.when(traded, F.col("price"))).alias("high"),
        F.min(F.when(traded, F.col("price"))).alias("low"),
        F.when(F.count("price") == F.count(F.lit(1)), F.sum(F.col("price").cast("decimal(18,4)"))).cast("double").alias("amount"),
        F.count(F.lit(1)).alias("ticks"),
        F.count_if(F.col("price") < 0).alias("negative"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def unique_period(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows with the one listing period that holds their date; ``candidates`` other than 1 makes a gap (null period)."""
    inside = (F.col("p.security_id") == F.col("r.security_id")) & (F.col("r.date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("r.date") < F.col("valid_to")))
    met = rows.alias("r").join(periods.alias("p"), inside, "left")
    found = met.groupBy("r.security_id", "r.date").agg(F.count("period_id").alias("candidates"), F.max("period_id").alias("period_id"))
    return found.withColumn("period_id", F.when(F.col("candidates") == 1, F.col("period_id")))


def daily_from_minutes(minutes: DataFrame, sessions: DataFrame) -> DataFrame:
    """A day's bar of (code, ts, tie, open, high, low, close, volume, amount) with what makes its parts usable, in one aggregation.

    A row is traded where volume and amount are positive, quiet where both are 0, else its flow is unknown. ``open`` is the first traded row's; it
    is valid where it is positive and no unknown flow comes before it, no figure is negative, no volume is fractional and no time occurs twice. ``high`` and ``low`` are of
    traded rows, null where a flow is unknown or a traded price is not positive. Sums are null where any part is missing; amounts are
    summed as decimals. ``ratio_in_range`` tells whether amount over volume lies within the reported range, ``on_session`` whether the day is one of ``sessions`` (date).
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    rows = minutes.withColumns({c: finite(c) for c in ("open", "high", "low", "close", "volume", "amount")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    traded, quiet = yes((F.col("volume") > 0) & (F.col("amount") > 0)), yes((F.col("volume") == 0) & (F.col("amount") == 0))
    order, count = F.struct("ts", "tie"), F.count(F.lit(1))
    bad = lambda c: F.count_if(traded & ~yes(F.col(c) > 0))
    days = rows.groupBy("code", F.to_date("ts").alias("date")).agg(
        count.alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (count - F.count_distinct("ts")).alias("repeated_times"),
        F.min(F.when(traded, order)).alias("first_trade"), F.min(F.when(~traded & ~quiet, order)).alias("first_unknown"), F.min_by("open", F.when(traded, order)).alias("open"), F.max_by("close", order).alias("close"),
        F.max(F.when(traded, F.col("high"))).alias("high"), F.min(F.when(traded, F.col("low"))).alias("low"), bad("high").alias("bad_high"), bad("low").alias("bad_low"), F.count_if(traded).alias("traded_rows"), F.count_if(~traded & ~quiet).alias("unknown_rows"),
        F.count_if(yes(F.col("volume") < 0) | yes(F.col("amount") < 0)).alias("negative_rows"), F.count_if(yes(F.col("volume") % 1 != 0)).alias("fractional_rows"),
        F.when(F.count("volume") == count, F.sum(F.col("volume").cast("decimal(24,4)"))).alias("volume"), F.when(F.count("amount") == count, F.sum(F.col("amount").cast("decimal(24,4)"))).alias("amount"),
        F.max("high").alias("reported_high"), F.min("low").alias("reported_low"), F.count_if(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull() | F.col("amount").isNull()).alias("incomplete_rows"),
    )
    known = (F.col("traded_rows") > 0) & (F.col("unknown_rows") == 0)
    clean = (F.col("negative_rows") == 0) & (F.col("fractional_rows") == 0) & (F.col("repeated_times") == 0)
    ratio = F.when(F.col("volume") > 0, F.try_divide(F.col("amount").cast("double"), F.col("volume").cast("double")))
    out = days.withColumns({
        "open_valid": yes(F.col("open") > 0) & ~yes(F.col("first_unknown") < F.col("first_trade")) & clean,
        "high": F.when(known & (F.col("bad_high") == 0), F.col("high")), "low": F.when(known & (F.col("bad_low") == 0), F.col("low")),
        "ratio_in_range": yes((ratio >= F.col("reported_low") - 1e-8) & (ratio <= F.col("reported_high") + 1e-8)),
        "volume": F.when(F.col("fractional_rows") == 0, F.col("volume").cast("double")), "amount": F.col("amount").cast("double"),
    })
    on = sessions.select("date", F.lit(True).alias("on_session")).distinct()
    return out.join(on, "date", "left").withColumn("on_session", yes(F.col("on_session"))).drop("first_trade", "first_unknown", "bad_high", "bad_low", "reported_high", "reported_low")
