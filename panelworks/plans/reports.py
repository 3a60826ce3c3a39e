"""Queries of market rankings, candidate choice, coverage, curves, holdings and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import reports as rp
from panelworks.plans.panel import _BARS, _rounded
from panelworks.sources import tables as src

_KINDS = ["AIR", "MAIL", "RAIL"]
_FIRST, _LAST = "1992-01-01", "1998-12-01"


def ranked_market(spark, d):
    bars = src.weekly_bars(spark, d)
    score = F.when((F.col("security_id") + F.year("date")) % 6 != 0, F.round("volume", 2))
    return rp.ranked_market(bars.select("security_id", "date", score.alias("score")), "date")


def best_candidates(spark, d):
    lines = src.table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    statistics = lines.groupBy(F.col("l_suppkey").alias("security_id"), F.year("l_shipdate").alias("year"), kind.alias("kind")).agg(F.floor(F.sum("l_quantity") / 100).cast("double").alias("statistic"))
    return rp.best_candidates(statistics, _KINDS[::-1], "security_id", "year")


def month_coverage(spark, d):
    orders = src.table(spark, d, "orders")
    records = orders.select(F.col("o_custkey").alias("security_id"), F.trunc("o_orderdate", "month").alias("month"), F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 50).cast("int")).alias("cutoff"))
    return rp.month_coverage(records, _FIRST, _LAST, "security_id")


def _curves(spark, d):
    bars = src.weekly_bars(spark, d)
    groups = bars.groupBy((F.col("security_id") % 20).alias("book"), "date").agg(F.sum("volume").alias("level"))
    calendar = bars.where("date >= DATE '1993-01-04' AND date < DATE '1998-01-01'").select("date").distinct()
    return rp.rebased_curves(groups, calendar, "book")


def rebased_curves(spark, d):
    return _rounded(_curves(spark, d))


def curve_metrics(spark, d):
    return _rounded(rp.curve_metrics(_curves(spark, d), "book"), 6)


def holdings_violations(spark, d):
    lines = src.table(spark, d, "lineitem")
    return rp.holdings_violations(lines.select(
        F.when(F.col("l_orderkey") % 97 != 0, F.col("l_orderkey")).alias("account"), (F.col("l_partkey") % 40).alias("security_id"), F.when(F.col("l_partkey") % 31 != 0, F.col("l_quantity") - 2).alias("quantity"),
        (F.col("l_linenumber") * 8 - 10).alias("sellable"), (F.col("l_extendedprice") - 1000).alias("cost"),
    ))


def residual_correction(spark, d):
    lines = src.table(spark, d, "lineitem")
    return _rounded(rp.residual_correction(lines.select(F.year("l_shipdate").alias("year"), F.col("l_discount").alias("actual"), (F.col("l_quantity") / 1000).alias("point")), "year"), 6)


def logistic_calibration(spark, d):
    lines = src.table(spark, d, "lineitem")
    rows = lines.select(F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").cast("int").alias("horizon"), (F.col("l_quantity") / 25).alias("margin"), (F.col("l_extendedprice") > 30000).cast("int").alias("up"))
    return _rounded(rp.logistic_calibration(rp.centred_margins(rows)), 6)


QUERIES = {f.__name__: f for f in (ranked_market, best_candidates, month_coverage, rebased_curves, curve_metrics, holdings_violations, residual_correction, logistic_calibration)}

_CURVES = f"""{_BARS}, g AS (SELECT security_id % 20 AS book, date, sum(volume) AS level FROM bars GROUP BY 1, 2), cal AS (SELECT DISTINCT date FROM bars WHERE date >= DATE '1993-01-04' AND date < DATE '1998-01-01'),
  m AS (SELECT b.book, c.date, level FROM (SELECT DISTINCT book FROM g) b CROSS JOIN cal c LEFT JOIN g USING (book, date)),
  r AS (SELECT book, date, count(*) FILTER (level IS NULL OR level <= 0) OVER (PARTITION BY book) AS missing, level, first_value(level) OVER (PARTITION BY book ORDER BY date) AS base FROM m),
  curves AS (SELECT book, date, missing, CASE WHEN missing = 0 THEN level / base END AS curve FROM r)"""
_RULES = {
    "duplicate_key": "copies > 1", "missing_key": "account IS NULL OR security_id IS NULL", "missing_quantity": "quantity IS NULL", "negative_quantity": "quantity < 0",
    "negative_sellable": "sellable < 0", "sellable_over_held": "sellable > quantity", "negative_cost": "cost < 0",
}
ORACLES = {
    "ranked_market": f"""WITH {_BARS}, s AS (SELECT security_id, date, CASE WHEN (security_id + year(date)) % 6 <> 0 THEN round(volume, 2) END AS score FROM bars)
      SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, security_id)::INT AS place FROM s""",
    "best_candidates": """WITH s AS (SELECT l_suppkey AS security_id, year(l_shipdate)::INT AS year, ['AIR', 'MAIL', 'RAIL'][(l_orderkey % 3 + 1)::INT] AS kind, floor(sum(l_quantity) / 100) AS statistic FROM lineitem GROUP BY 1, 2, 3)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY security_id, year ORDER BY statistic DESC, kind DESC) = 1""",
    "month_coverage": f"""WITH r AS (SELECT o_custkey AS security_id, date_trunc('month', o_orderdate)::DATE AS month, o_orderdate::DATE - (o_orderkey % 50)::INT AS cutoff FROM orders),
      w AS (SELECT security_id, m::DATE AS month FROM (SELECT DISTINCT security_id FROM r), generate_series(DATE '{_FIRST}', DATE '{_LAST}', INTERVAL 1 MONTH) AS t(m))
      SELECT security_id, month, count(cutoff) AS records, coalesce(bool_and(cutoff < month), false) AS proven FROM w LEFT JOIN r USING (security_id, month) GROUP BY 1, 2""",
    "rebased_curves": f"WITH {_CURVES} SELECT book, date, missing, round(curve, 8) AS curve FROM curves",
    "curve_metrics": f"""WITH {_CURVES}, s AS (SELECT *, curve / lag(curve) OVER w - 1 AS step, curve / max(curve) OVER w - 1 AS fall FROM curves WINDOW w AS (PARTITION BY book ORDER BY date)),
      a AS (SELECT book, count(*) AS points, count(*) = count(curve) AS whole, arg_max(curve, date) / arg_min(curve, date) AS growth, max(date) - min(date) AS days, avg(step) AS mean, stddev_samp(step) AS dev, min(fall) AS fall FROM s GROUP BY book)
      SELECT book, points, CASE WHEN whole THEN round(growth - 1, 6) END AS growth, CASE WHEN whole THEN round(growth ** (252 / (points - 1)) - 1, 6) END AS session_cagr, CASE WHEN whole THEN round(growth ** (365.25 / days) - 1, 6) END AS calendar_cagr,
      CASE WHEN whole AND dev > 0 THEN round(mean / dev * sqrt(252), 6) END AS sharpe, CASE WHEN whole THEN round(fall, 6) END AS drawdown FROM a""",
    "holdings_violations": """WITH h AS (SELECT CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey END AS account, l_partkey % 40 AS security_id, CASE WHEN l_partkey % 31 <> 0 THEN l_quantity - 2 END AS quantity, l_linenumber * 8 - 10 AS sellable, l_extendedprice - 1000 AS cost FROM lineitem),
      c AS (SELECT *, count(*) OVER (PARTITION BY account, security_id) AS copies FROM h) """ + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS rows FROM c" for n, c in _RULES.items()),
    "residual_correction": """WITH r AS (SELECT year(l_shipdate)::INT AS year, l_discount - l_quantity / 1000 AS r FROM lineitem)
      SELECT year, count(r) AS rows, round(avg(r), 6) AS mean_residual, round(quantile_cont(r, 0.1), 6) AS q10, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.9), 6) AS q90 FROM r GROUP BY year""",
}
