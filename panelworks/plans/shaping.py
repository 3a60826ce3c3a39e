"""Queries that shape examples and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import normal as nm
from panelworks.operators import cross_section as xs
from panelworks.operators import shaping as sh
from panelworks.plans.panel import _EXAMPLES, _FACTORS, _PANEL, _RANKS, _core, _days, _rank, _rounded
from panelworks.sources import tables as src

_AS_OF, _HALF_LIFE = "1999-12-31", 12.0


def _month_rows(spark, d):
    factors = _core(spark, d)
    return factors.join(F.broadcast(sh.month_ends(_days(spark, d))), "date")  # one row a month


def month_ends(spark, d):
    return sh.month_ends(_days(spark, d))


def monthly_targets(spark, d):
    rows = _month_rows(spark, d).select("date", "security_id", F.col("fwd_return_5").alias("fwd_return"))
    return _rounded(sh.monthly_targets(rows))


def sampled_names(spark, d):
    return sh.sampled(_core(spark, d).where("status = 'ok'").select("date", "security_id"), 16)


def example_weights(spark, d):
    rows = xs.examples(_core(spark, d)).where("fwd_return IS NOT NULL AND status = 'ok'").select("date", "security_id", "horizon")
    return _rounded(sh.recency_weights(sh.balanced_weights(rows, "date", "horizon"), _AS_OF, _HALF_LIFE))


def completed_horizons(spark, d):
    rows = xs.examples(_core(spark, d)).where("fwd_return IS NOT NULL")
    return _rounded(sh.complete_horizons(rows).select("date", "security_id", "horizon", "status", "fwd_return"), 6)


def smoothed_scores(spark, d):
    factors = _month_rows(spark, d)
    scores = xs.factor_score(xs.ranks(factors)).join(factors.select("date", "security_id", "near_high_252"), ["date", "security_id"])
    return _rounded(sh.smoothed(sh.blended(scores, "near_high_252", 0.25), 0.3).select("date", "security_id", "base_score", "score"), 6)


def relevance_deciles(spark, d):
    rows = xs.examples(_core(spark, d)).where("status = 'ok' AND fwd_return IS NOT NULL")
    return rows.select("date", "security_id", "horizon", sh.deciles(F.col("fwd_return"), "date", "horizon").alias("relevance"))


QUERIES = {f.__name__: f for f in (month_ends, monthly_targets, sampled_names, example_weights, completed_horizons, smoothed_scores, relevance_deciles)}

_MONTHS = "months AS (SELECT date FROM (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM days) WHERE date_trunc('month', date) < date_trunc('month', nxt))"


def _z(column):
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN coalesce(stddev_samp({column}) OVER d, 0) = 0 THEN 0 ELSE ({column} - avg({column}) OVER d) / stddev_samp({column}) OVER d END"


def _ratio(terms, x):
    sides = [" + ".join(f"{c!r}::DOUBLE * pow({x}, {i})" for i, c in enumerate(side)) for side in terms]
    return f"({sides[0]}) / ({sides[1]})"


_GAUSS = f"CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_ratio(nm.MIDDLE, '(0.180625 - (p - 0.5) * (p - 0.5))')} ELSE sign(p - 0.5) * {_ratio(nm.TAIL, '(sqrt(-ln(least(p, 1 - p))) - 1.6)')} END"
_MONTH_RANKS = f"{_RANKS}, {_MONTHS}"
ORACLES = {
    "month_ends": f"WITH {_PANEL}, {_MONTHS} SELECT date FROM months",
    "monthly_targets": f"""WITH {_FACTORS}, {_MONTHS}, x AS (SELECT date, security_id, fwd_return_5 AS y FROM f JOIN months USING (date) WHERE fwd_return_5 IS NOT NULL),
      t AS (SELECT *, {_rank("y", "date")} - 0.5::DOUBLE / count(*) OVER (PARTITION BY date) AS p, count(*) OVER (PARTITION BY date) AS n, median(y) OVER (PARTITION BY date) AS m FROM x)
      SELECT date, security_id, round(CASE WHEN n >= 6 THEN p END, 8) AS percentile, CASE WHEN n >= 6 THEN (y > m)::INT END AS above_median, CASE WHEN n >= 6 THEN floor(5 * p)::INT END AS quintile,
        round(CASE WHEN n >= 6 THEN {_GAUSS} END, 8) AS gaussian, round(CASE WHEN n >= 6 THEN 0.5::DOUBLE * {_GAUSS} + CASE WHEN y > m THEN 0.5 ELSE -0.5 END END, 8) AS hybrid FROM t""",
    "sampled_names": f"""WITH {_FACTORS}, s AS (SELECT date, security_id, row_number() OVER (PARTITION BY date ORDER BY md5('7|' || date || '|' || security_id), security_id)::INT AS place FROM f WHERE status = 'ok')
      SELECT * FROM s WHERE place <= 16""",
    "example_weights": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}), k AS (SELECT date, security_id, horizon FROM e WHERE fwd_return IS NOT NULL AND status = 'ok')
      SELECT date, security_id, horizon, round((SELECT count(*) FROM k) / ((SELECT count(*) FROM (SELECT DISTINCT date, horizon FROM k)) * (count(*) OVER (PARTITION BY date, horizon))::DOUBLE)
        * pow(0.5::DOUBLE, greatest((1999 - year(date)) * 12 + 12 - month(date), 0) / {_HALF_LIFE}::DOUBLE), 8) AS weight FROM k""",
    "completed_horizons": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}), k AS (SELECT * FROM e WHERE fwd_return IS NOT NULL), w AS (SELECT * FROM (SELECT DISTINCT date, security_id FROM k), (SELECT unnest([1, 5, 20, 60])::INT AS horizon))
      SELECT w.date, w.security_id, w.horizon, coalesce(status, 'insufficient_model_inputs') AS status, round(fwd_return, 6) AS fwd_return FROM w LEFT JOIN k USING (date, security_id, horizon)""",
    "smoothed_scores": f"""WITH {_MONTH_RANKS}, s AS (SELECT date, security_id, score, near_high_252 FROM scored JOIN months USING (date) JOIN f USING (date, security_id)),
      b AS (SELECT date, security_id, {_z("score")} + 0.25 * {_z("near_high_252")} AS base_score FROM s WINDOW d AS (PARTITION BY date))
      SELECT date, security_id, round(base_score, 6) AS base_score, round(0.7 * base_score + 0.3 * CASE WHEN date_trunc('month', lag(date) OVER w) = date_trunc('month', date) - INTERVAL 1 MONTH THEN lag(base_score) OVER w END, 6) AS score
      FROM b WINDOW w AS (PARTITION BY security_id ORDER BY date)""",
    "relevance_deciles": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}) SELECT date, security_id, horizon, least(floor({_rank("fwd_return", "date", "horizon")} * 10), 9)::INT AS relevance FROM e WHERE status = 'ok' AND fwd_return IS NOT NULL""",
}
