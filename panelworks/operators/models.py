"""Fits as aggregates: coefficients are a few numbers a horizon, from one pass of sums over all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.order import positions

LEVELS = (0.1, 0.5, 0.9)
REJECTED = ("invalid_quantile_order", "invalid_return_range", "unrepresentable_prediction")


def affine(train: DataFrame, *by: str) -> DataFrame:
    """(by..., slope, intercept): weighted least squares of fwd_return on score with a slope of 0 or more."""
    w, x, y = F.col("weight"), F.col("score"), F.col("fwd_return")
    sums = train.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    mx, my = F.try_divide("wx", "w"), F.try_divide("wy", "w")
    spread = F.try_divide("wxx", "w") - mx * mx
    slope = F.when(spread > 0, F.greatest(F.lit(0.0), F.try_divide(F.try_divide("wxy", "w") - mx * my, spread))).otherwise(0.0)
    return sums.select(*by, slope.alias("slope"), my.alias("my"), mx.alias("mx")).select(*by, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def residual_quantiles(rows: DataFrame, levels=LEVELS, width: float = 0.01, least: int = 30) -> DataFrame:
    """(horizon, q10, q50, q90) of ``residual``: order statistics number ceil(level * n), where n is at least ``least``."""
    placed = positions(rows.select("horizon", "residual"), ("horizon",), "residual", (), width).where(F.col("n") >= least)
    picked = [F.max(F.when(F.col("position") == F.ceil(F.lit(q) * F.col("n")), F.col("residual"))).alias(f"q{round(q * 100)}") for q in levels]
    return placed.groupBy("horizon").agg(*picked)


def log_residual(actual: Column, point: Column, scale: Column) -> Column:
    """Standardised difference of log1p returns; null where it is undefined."""
    return F.when((actual > -1) & (point > -1) & (scale > 0), (F.log1p(actual) - F.log1p(point)) / scale)


def intervals(rows: DataFrame, quantiles: DataFrame) -> DataFrame:
    """q10, q50, q90 around ``expected_return`` from residual quantiles; ``quantiles`` has one row a horizon."""
    named = quantiles.select("horizon", *(F.col(f"q{round(q * 100)}").alias(f"_q{round(q * 100)}") for q in LEVELS))
    valid = (F.col("expected_return") > -1) & (F.col("scale") > 0)
    out = rows.join(F.broadcast(named), "horizon", "left")
    for q in (f"q{round(q * 100)}" for q in LEVELS):
        out = out.withColumn(q, F.when(valid, F.expm1(F.log1p("expected_return") + F.col("scale") * F.col(f"_{q}")))).drop(f"_{q}")
    return out


def task_statuses(rows: DataFrame) -> DataFrame:
    """Status of each task and their aggregate, by precedence; a task that failed has its values removed."""

    def bad(*columns):
        found = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns]
        return F.array_contains(F.array(*found), True)

    p, e, q = F.col("probability_up"), F.col("expected_return"), ("q10", "q50", "q90")
    crossed = (F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))
    out = rows.withColumns({
        "probability_status": F.when(bad("probability_up") | (p < 0) | (p > 1), "unrepresentable_prediction").otherwise("ok"),
        "return_status": F.when(bad("expected_return"), "unrepresentable_prediction").when(e < -1, "invalid_return_range").otherwise("ok"),
        "interval_status": F.when(bad(*q), "unrepresentable_prediction").when(crossed, "invalid_quantile_order").when(F.least(*q) < -1, "invalid_return_range").otherwise("ok"),
    })
    every = F.array("probability_status", "return_status", "interval_status")
    ladder = F.lit("ok")
    for status in REJECTED:  # the last named takes precedence
        ladder = F.when(F.array_contains(every, status), status).otherwise(ladder)
    out = out.withColumn("status", ladder)
    owner = {"probability_up": "probability_status", "expected_return": "return_status", **dict.fromkeys(q, "interval_status")}
    return out.withColumns({c: F.when(F.col(s) == "ok", F.col(c)) for c, s in owner.items()})


def contributions(ranked: DataFrame, weights: dict[str, float], top: int = 3) -> DataFrame:
    """The ``top`` features of each row by absolute contribution, weight * (2 * rank - 1); ties by name."""
    each = F.array(*(F.struct(F.lit(c).alias("feature"), (w * (2 * F.col(c) - 1)).alias("contribution"), F.col(c).alias("feature_value")) for c, w in weights.items()))
    known = F.filter(each, lambda x: x["contribution"].isNotNull())
    ordered = F.array_sort(F.transform(known, lambda x: F.struct((-F.round(F.abs(x["contribution"]), 9)).alias("size"), x["feature"].alias("feature"), x.alias("x"))))
    return ranked.select("date", "security_id", F.posexplode(F.slice(ordered, 1, top)).alias("place", "c")).select("date", "security_id", (F.col("place") + 1).alias("place"), "c.x.*")


def walk_forward(rows: DataFrame, years: DataFrame) -> DataFrame:
    """Forecasts of each year with an affine fit on examples whose label ended before that year.

    ``years`` (year) is a small table. Sums are taken per year of label end first, so an example is read once and
    not once a fold; each fold adds up the years before it.
    """
    w, x, y = F.lit(1.0), F.col("score"), F.col("fwd_return")
    known = rows.where("score IS NOT NULL AND fwd_return IS NOT NULL")
    each = known.groupBy("horizon", F.year("label_end").alias("ended")).agg(
        F.sum(w).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")
    )
    sums = F.broadcast(years).join(each, F.col("ended") < F.col("year")).groupBy("year", "horizon").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    spread = F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) ** 2
    slope = F.when(spread > 0, F.greatest(F.lit(0.0), (F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / F.col("n") ** 2) / spread)).otherwise(0.0)
    fits = sums.withColumn("slope", slope).select("year", "horizon", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
    found = rows.where("score IS NOT NULL").withColumn("year", F.year("date")).join(F.broadcast(fits), ["year", "horizon"])  # years x horizons
    return found.select("date", "security_id", "horizon", (F.col("intercept") + F.col("slope") * F.col("score")).alias("expected_return"), "fwd_return")


def ridge(train: DataFrame, features: list[str], target: str, alpha: float) -> dict:
    """Weighted ridge on standardised features: one aggregate of weighted sums and cross products, one small solve.

    Rows with a null feature or target are left out. Returns means, deviations, coefficients and the intercept.
    """
    known = train.where(" AND ".join(f"{c} IS NOT NULL" for c in (*features, target)))
    columns = [F.lit(1.0), *(F.col(c) for c in (*features, target))]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = known.agg(*(F.sum(F.col("weight") * columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
    gram = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"] or 0.0
    n, p = gram[0, 0], len(features)
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov)[:p] / n)
    sd[sd == 0] = 1.0
    beta = np.linalg.solve(cov[:p, :p] / np.outer(sd, sd) + alpha * np.eye(p), cov[:p, p] / sd)
    return {"mean": mean[:p].tolist(), "sd": sd.tolist(), "coef": beta.tolist(), "intercept": float(mean[p])}


def ridge_score(features: list[str], fit: dict) -> Column:
    parts = zip(features, fit["mean"], fit["sd"], fit["coef"])
    return sum(((F.col(c) - m) / s * b for c, m, s, b in parts), F.lit(fit["intercept"]))
