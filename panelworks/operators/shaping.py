"""Samples, weights, monthly targets, blended scores, and completed horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.normal import inverse_normal
from panelworks.functions.windows import average_rank
from panelworks.operators.features import HORIZONS


def zscore(value: Column, *partition: str) -> Column:
    """Standardised within the partition; 0 where the deviation is 0 or unknown."""
    w = Window.partitionBy(*partition)
    sd = F.stddev_samp(value).over(w)
    return F.when(value.isNull(), None).when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((value - F.avg(value).over(w)) / sd)


def month_ends(days: DataFrame) -> DataFrame:
    """Last sessions of complete months: the next session lies in another month. One row per session meets in the window."""
    nxt = F.lead("date").over(Window.orderBy("date"))
    return days.select("date", nxt.alias("next")).where(F.trunc("date", "month") < F.trunc("next", "month")).select("date")


def monthly_targets(rows: DataFrame, least: int = 6) -> DataFrame:
    """Percentile, above-median, quintile, gaussian and hybrid targets of ``fwd_return`` per date; null where fewer than ``least`` names have one.

    Gaussian: the normal value of the percentile (rank - 0.5) / n. Hybrid: the mean of it and of 1 above the median, -1 else.
    """
    known = rows.where("fwd_return IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    middle = known.groupBy("date").agg(F.median("fwd_return").alias("middle"))
    placed = known.withColumn("n", n).withColumn("percentile", average_rank(F.col("fwd_return"), "date") - 0.5 / F.col("n"))
    enough = F.col("n") >= least
    return placed.join(middle, "date").select(
        "date", "security_id",
        F.when(enough, F.col("percentile")).alias("percentile"),
        F.when(enough, (F.col("fwd_return") > F.col("middle")).cast("int")).alias("above_median"),
        F.when(enough, F.floor(5 * F.col("percentile")).cast("int")).alias("quintile"),
        F.when(enough, inverse_normal(F.col("percentile"))).alias("gaussian"),
        F.when(enough, 0.5 * inverse_normal(F.col("percentile")) + F.when(F.col("fwd_return") > F.col("middle"), 0.5).otherwise(-0.5)).alias("hybrid"),
    )


def sampled(rows: DataFrame, names: int = 256, seed: int = 7) -> DataFrame:
    """At most ``names`` rows a date, chosen by a hash of seed, date and id: the same at every run and partitioning.

    A hash with more zeros in front comes before all with fewer, so counts by zeros tell how many zeros a date's chosen rows
    have at least; only rows with as many are sorted, some multiple of ``names`` a date however many rows it has.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string"), F.col("security_id").cast("string")))
    hashed = rows.withColumn("_digest", digest).withColumn("_zeros", F.length("_digest") - F.length(F.ltrim("_digest", F.lit("0"))))
    counts = hashed.groupBy("date", "_zeros").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("date").orderBy(F.desc("_zeros")).rowsBetween(Window.unboundedPreceding, -1))
    least = counts.select(F.col("date").alias("_date"), "_zeros", before.alias("_before")).where(F.coalesce("_before", F.lit(0)) < names)
    least = least.groupBy("_date").agg(F.min("_zeros").alias("_least"))
    first = hashed.join(F.broadcast(least), F.col("date").eqNullSafe(F.col("_date")) & (F.col("_zeros") >= F.col("_least")))  # a row a date
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("_digest", "security_id")))
    return placed.where(F.col("place") <= names).select(*rows.columns, "place")


def balanced_weights(rows: DataFrame, *by: str) -> DataFrame:
    """``weight`` 1 over the group's size, scaled to mean 1: rows / (groups * size)."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    totals = sizes.agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups"))
    return rows.join(sizes, list(by)).join(F.broadcast(totals)).withColumn("weight", F.col("rows") / (F.col("groups") * F.col("size"))).drop("size", "rows", "groups")  # totals is one row


def recency_weights(rows: DataFrame, as_of: str, half_life: float) -> DataFrame:
    """``weight`` times a half for every ``half_life`` months of age; later rows count as new."""
    at = F.lit(as_of).cast("date")
    age = (F.year(at) - F.year("date")) * 12 + F.month(at) - F.month("date")
    return rows.withColumn("weight", F.col("weight") * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life))


def complete_horizons(rows: DataFrame, horizons=HORIZONS, status: str = "insufficient_model_inputs") -> DataFrame:
    """A row for each (date, security_id) and horizon; rows that were missing have null values and the given status."""
    wanted = rows.select("date", "security_id").distinct().withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in horizons))))
    found = wanted.join(rows, ["date", "security_id", "horizon"], "left")
    return found.withColumn("status", F.coalesce("status", F.lit(status)))


def blended(scores: DataFrame, factor: str, weight: float) -> DataFrame:
    """``base_score``: the standardised score plus ``weight`` times the standardised factor, per date."""
    return scores.withColumn("base_score", zscore(F.col("score"), "date") + weight * zscore(F.col(factor), "date"))


def smoothed(scores: DataFrame, weight: float) -> DataFrame:
    """``score`` mixed with the security's score of the calendar month before; null without one."""
    w = Window.partitionBy("security_id").orderBy("date")
    adjacent = F.trunc(F.lag("date").over(w), "month") == F.add_months(F.trunc("date", "month"), -1)
    return scores.withColumn("score", (1 - weight) * F.col("base_score") + weight * F.when(adjacent, F.lag("base_score").over(w)))


def deciles(value: Column, *partition: str) -> Column:
    """Relevance 0 to 9 from the percentile rank."""
    return F.least(F.floor(average_rank(value, *partition) * 10), F.lit(9)).cast("int")
