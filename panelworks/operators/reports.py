"""Market rankings, candidate choice, curve and holdings reports, probability calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_market(scores: DataFrame, *by: str, limit: int | None = None) -> DataFrame:
    """``scores`` with ``place`` in each group: the highest score first, ties by security, unscored last; ``limit`` places at most."""
    out = scores.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), "security_id")))
    return out if limit is None else out.where(F.col("place") <= limit)


def best_candidates(statistics: DataFrame, order: list[str], *by: str) -> DataFrame:
    """Per group the candidate (kind, statistic) with the highest statistic; ties go to the first in the declared order, null loses."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = Window.partitionBy(*by).orderBy(F.desc_nulls_last("statistic"), place)
    known = statistics.where(place > 0)
    return known.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def month_coverage(records: DataFrame, first: str, last: str, *by: str) -> DataFrame:
    """Every month of [first, last] for every group, with its records and whether all their cutoffs lie before the month.

    ``records`` (by..., month, cutoff); a month without a record has 0 records and is not ``proven``.
    """
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"), F.make_ym_interval(F.lit(0), F.lit(1)))).alias("month")
    wanted = records.select(*by).distinct().select(*by, months)
    found = records.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("records"), F.min(F.coalesce(F.col("cutoff") < F.col("month"), F.lit(False))).alias("proven"))
    out = wanted.join(found, [*by, "month"], "left")
    return out.withColumns({"records": F.coalesce("records", F.lit(0)), "proven": F.coalesce("proven", F.lit(False))})


def rebased_curves(levels: DataFrame, calendar: DataFrame, *by: str) -> DataFrame:
    """Levels divided by the first session's, one row a session; a curve with a missing session is invalid (null) throughout.

    ``levels`` (by..., date, level) is unique by key, ``calendar`` (date) lists the sessions and is small.
    """
    wanted = levels.select(*by).distinct().join(F.broadcast(calendar.select("date")))
    met = wanted.join(levels, [*by, "date"], "left")
    whole = Window.partitionBy(*by)
    met = met.withColumns({"missing": F.count_if(~F.coalesce(F.col("level") > 0, F.lit(False))).over(whole), "base": F.min_by("level", "date").over(whole)})
    return met.select(*by, "date", "missing", F.when(F.col("missing") == 0, F.col("level") / F.col("base")).alias("curve"))


def curve_metrics(curves: DataFrame, *by: str, sessions_a_year: int = 252) -> DataFrame:
    """Growth, yearly growth by sessions and by calendar days, Sharpe ratio without a risk-free rate, drawdown.

    ``curves`` (by..., date, curve); the figures of a group with a null or non-positive point are null.
    """
    along, so_far = Window.partitionBy(*by).orderBy("date"), Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = curves.withColumns({"step": F.try_divide("curve", F.lag("curve").over(along)) - 1, "fall": F.try_divide("curve", F.max("curve").over(so_far)) - 1})
    sums = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("curve") > 0).alias("good"), F.min_by("curve", "date").alias("a"), F.max_by("curve", "date").alias("b"),
        F.date_diff(F.max("date"), F.min("date")).alias("days"), F.avg("step").alias("mean"), F.stddev_samp("step").alias("deviation"), F.min("fall").alias("drawdown"),
    )
    whole, growth = F.col("points") == F.col("good"), F.try_divide("b", "a")
    n = F.col("points") - 1
    figures = {
        "growth": growth - 1, "session_cagr": F.pow(growth, F.try_divide(F.lit(float(sessions_a_year)), n)) - 1, "calendar_cagr": F.pow(growth, F.try_divide(F.lit(365.25), F.col("days"))) - 1,
        "sharpe": F.when(F.col("deviation") > 0, F.col("mean") / F.col("deviation") * sessions_a_year**0.5), "drawdown": F.col("drawdown"),
    }
    return sums.select(*by, "points", *(F.when(whole, v).alias(k) for k, v in figures.items()))


def holdings_violations(holdings: DataFrame) -> DataFrame:
    """(rule, rows): how many holdings (account, security_id, quantity, sellable, cost) break each rule; 0 for rules that hold."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("account", "security_id"))
    rules = {
        "duplicate_key": F.col("copies") > 1, "missing_key": F.col("account").isNull() | F.col("security_id").isNull(), "missing_quantity": F.col("quantity").isNull(),
        "negative_quantity": F.col("quantity") < 0, "negative_sellable": F.col("sellable") < 0, "sellable_over_held": F.col("sellable") > F.col("quantity"), "negative_cost": F.col("cost") < 0,
    }
    counts = holdings.withColumn("copies", copies).agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules))).alias("x")).select("x.*")


def residual_correction(rows: DataFrame, *by: str) -> DataFrame:
    """Mean residual and interpolated residual quantiles of each group, from ``actual`` and ``point``."""
    r = F.col("actual") - F.col("point")
    return rows.groupBy(*by).agg(F.count(r).alias("rows"), F.avg(r).alias("mean_residual"), *(F.percentile(r, q / 100).alias(f"q{q}") for q in (10, 50, 90)))


def logistic_calibration(rows: DataFrame, rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(horizon, slope, intercept): P(up) = 1 / (1 + exp(-(slope * margin + intercept))), with a penalty of slope**2 / 2 a horizon.

    ``rows`` (horizon, margin, up 0 or 1). Newton's method: every round is one aggregate of six sums a horizon over all
    rows, so the driver only sees a few numbers a horizon. Rows with a null margin or outcome take no part; horizons with
    one outcome only are left out.
    """
    spark = rows.sparkSession
    known = rows.where("margin IS NOT NULL AND up IS NOT NULL").select("horizon", F.col("margin").cast("double").alias("x"), F.col("up").cast("double").alias("y"))
    mixed = known.groupBy("horizon").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").collect()
    fits, done = {r.horizon: (0.0, 0.0) for r in mixed}, not mixed
    for _ in range(0 if done else rounds):
        at = spark.createDataFrame([(h, *c) for h, c in fits.items()], "horizon int, a double, b double")
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        met = known.join(F.broadcast(at), "horizon").select("horizon", "x", (F.col("y") - p).alias("e"), (p * (1 - p)).alias("v"))
        x, e, v = F.col("x"), F.col("e"), F.col("v")
        sums = met.groupBy("horizon").agg(F.sum(e * x), F.sum(e), F.sum(v * x * x), F.sum(v * x), F.sum(v)).collect()
        moved = 0.0
        for h, ex, e0, vxx, vx, v0 in sums:
            a, b = fits[h]
            step = np.linalg.solve([[vxx + 1.0, vx], [vx, v0]], [ex - a, e0])
            fits[h], moved = (a + float(step[0]), b + float(step[1])), max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return spark.createDataFrame([(h, *c) for h, c in sorted(fits.items())], "horizon int, slope double, intercept double")


def centred_margins(rows: DataFrame) -> DataFrame:
    """``margin`` less its mean on the date and horizon."""
    return rows.withColumn("margin", F.col("margin") - F.avg("margin").over(Window.partitionBy("date", "horizon")))
