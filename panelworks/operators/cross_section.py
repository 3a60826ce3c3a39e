"""Per-date transforms, example shaping, scores, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.windows import average_rank
from panelworks.operators.features import HORIZONS

INPUTS = ("momentum_60", "momentum_5", "volatility_20", "adv20_amount")
#: What ``examples`` reads of a row beside its key.
LABELS = ("status", *(f"fwd_return_{h}" for h in HORIZONS), *(f"label_end_{h}" for h in HORIZONS))


def ranks(factors: DataFrame, columns=INPUTS, carried: tuple[str | Column, ...] = ()) -> DataFrame:
    """Percentile ranks of eligible rows per date: one exchange by date, and a sort for each column.

    Columns ``carried`` (no ranked ones) come along as they are, so that ranks need not meet their rows again; expressions of
    ranked columns are made from their values afterwards, and ``status`` is known, so neither is dealt and sorted.
    """
    ok = factors.where("status = 'ok'").select("date", "security_id", *columns, *(c for c in carried if isinstance(c, str) and c != "status"))
    along = (F.lit("ok").alias(c) if isinstance(c, str) and c == "status" else c for c in carried)
    return ok.select("date", "security_id", *(average_rank(F.col(c), "date").alias(c) for c in columns), *along)


def factor_score(ranked: DataFrame) -> DataFrame:
    """Half the sum of the signed ranks: momentum and liquidity for, short-term return and volatility against."""
    return ranked.withColumn("score", 0.5 * (F.col("momentum_60") - F.col("momentum_5") - F.col("volatility_20") + F.col("adv20_amount")))


def winsorised(factors: DataFrame, column: str, width: float = 5 * 1.4826) -> DataFrame:
    """Clipped at the date's median plus or minus width times MAD, then standardised (deviation 0 gives 0)."""
    ok = factors.where(f"status = 'ok' AND {column} IS NOT NULL").select("date", "security_id", F.col(column).alias("x"))
    middle = ok.groupBy("date").agg(F.median("x").alias("m"))
    spread = ok.join(middle, "date").groupBy("date").agg(F.first("m").alias("m"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    clipped = ok.join(spread, "date").withColumn("x", F.greatest(F.least("x", F.col("m") + width * F.col("mad")), F.col("m") - width * F.col("mad")))
    w = Window.partitionBy("date")
    sd = F.stddev_samp("x").over(w)
    return clipped.select("date", "security_id", F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col("x") - F.avg("x").over(w)) / sd).alias("z"))


def examples(factors: DataFrame, *more: str) -> DataFrame:
    """A row per horizon: date, security_id, status, horizon, fwd_return, label_end, and the columns ``more``."""
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_return_{h}").alias("fwd_return"), F.col(f"label_end_{h}").alias("label_end")) for h in HORIZONS))
    return factors.select("date", "security_id", "status", *more, F.explode(each).alias("x")).select("date", "security_id", "status", "x.*", *more)


def rank_targets(rows: DataFrame, least: int = 20) -> DataFrame:
    """Centred rank of the forward return per date and horizon; null below ``least`` names."""
    known = rows.where("fwd_return IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy("date", "horizon"))
    return known.withColumn("target", F.when(n >= least, average_rank(F.col("fwd_return"), "date", "horizon") - (n + 1) / (2 * n)))


def purged_split(rows: DataFrame, boundary: str, as_of: str) -> DataFrame:
    """``part``: train if everything ends before the boundary, calibrate if it starts after it and is known by as_of."""
    b, a = F.lit(boundary).cast("date"), F.lit(as_of).cast("date")
    part = F.when((F.col("date") < b) & (F.col("label_end") < b), "train").when((F.col("date") >= b) & (F.col("label_end") <= a), "calibrate")
    return rows.where("fwd_return IS NOT NULL").withColumn("part", F.coalesce(part, F.lit("purged")))


def daily_ic(predictions: DataFrame, least: int = 20, by: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Spearman correlation of score and outcome per group ``by`` and date on complete pairs, where both vary."""
    both = predictions.where("score IS NOT NULL AND fwd_return IS NOT NULL")
    ranked = both.select(*by, "date", average_rank(F.col("score"), *by, "date").alias("s"), average_rank(F.col("fwd_return"), *by, "date").alias("f"))
    return correlations(ranked, least, by)


def correlations(ranked: DataFrame, least: int = 20, by: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Correlation of the ranks ``s`` and ``f`` per group ``by`` and date with ``least`` names or more, where both vary."""
    ic = F.try_divide(F.covar_pop("s", "f"), F.stddev_pop("s") * F.stddev_pop("f"))  # corr itself fails where nothing varies
    daily = ranked.groupBy(*by, "date").agg(ic.alias("rank_ic"), F.count(F.lit(1)).alias("names"), (F.min("s") < F.max("s")).alias("vs"), (F.min("f") < F.max("f")).alias("vf"))
    return daily.where((F.col("names") >= least) & F.col("vs") & F.col("vf")).drop("vs", "vf")


def ic_summary(ic: DataFrame) -> DataFrame:
    yearly = ic.groupBy("horizon", F.year("date").alias("year")).agg(F.avg("rank_ic").alias("year_ic"), F.sum("rank_ic").alias("total"), F.count(F.lit(1)).alias("dates"))
    return yearly.groupBy("horizon").agg(
        (F.sum("total") / F.sum("dates")).alias("mean_ic"), F.avg("year_ic").alias("mean_annual_ic"), F.avg((F.col("year_ic") > 0).cast("double")).alias("positive_years"), F.sum("dates").alias("dates")
    )


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """The n best names of each date: score descending, then id."""
    place = Window.partitionBy("date").orderBy(F.desc("score"), "security_id")
    return scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def book_returns(selected: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Equal-weight return of each date's book; null when any holding's outcome is missing.

    Without ``outcomes`` the selected rows hold theirs as ``fwd_return``.
    """
    met = selected if outcomes is None else selected.join(outcomes.where("horizon = 1").select("date", "security_id", "fwd_return"), ["date", "security_id"], "left")
    return met.groupBy("date").agg(F.when(F.count("fwd_return") == F.count(F.lit(1)), F.avg("fwd_return")).alias("book_return"), F.count(F.lit(1)).alias("holdings"))


def curve(returns: DataFrame) -> DataFrame:
    """Logarithm of wealth, and drawdown, along the dates of one book (a row per date)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.where("book_return IS NOT NULL").withColumn("log_wealth", F.sum(F.log1p("book_return")).over(w))
    return wealth.withColumn("drawdown", F.expm1(F.col("log_wealth") - F.max("log_wealth").over(w)))
