"""Queries that fit, forecast, evaluate and select."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import evaluation as ev
from panelworks.operators import models as md
from panelworks.plans.panel import _EXAMPLES, _FACTORS, _RANKS, _by_date, _core, _rank, _rounded, _squashed
from panelworks.sources.store import materialised

_WEIGHTS = {"momentum_60": 0.25, "momentum_5": -0.25, "volatility_20": -0.25, "adv20_amount": 0.25}
_SPLIT, _AS_OF = "1998-01-05", "2000-01-03"
_KINDS = {"score": 0, "momentum_60": 1, "near_high_252": 2}


def _scored(spark, d):
    """Scored examples, written once per session and input folder."""

    def make():
        sigma = (F.col("volatility_20") / 252**0.5).alias("sigma")
        scores = xs.factor_score(xs.ranks(_by_date(spark, d), carried=(*xs.LABELS, sigma))).where("score IS NOT NULL")
        rows = xs.examples(scores.withColumn("score", F.round("score", 9)), "score", "sigma")
        return rows.where("fwd_return IS NOT NULL AND sigma > 0").withColumn("scale", F.col("sigma") * F.sqrt("horizon"))

    return materialised(spark, d, "scored", make)


def _forecasts(spark, d):
    """Forecasts after the split date, written once per session and input folder."""

    def make():
        rows = _scored(spark, d)
        train = rows.where(f"label_end < DATE '{_SPLIT}'").withColumn("weight", F.lit(1.0))
        fits = md.affine(train, "horizon")
        base = train.groupBy("horizon").agg(F.avg((F.col("fwd_return") > 0).cast("double")).alias("baseline_probability"))
        point = rows.join(F.broadcast(fits), "horizon").join(F.broadcast(base), "horizon")  # one row a horizon each
        point = point.withColumn("expected_return", F.col("intercept") + F.col("slope") * F.col("score")).withColumn("probability_up", F.round(1 / (1 + F.exp(-F.col("score"))), 9))
        point = point.withColumn("residual", md.log_residual(F.col("fwd_return"), F.col("expected_return"), F.col("scale")))
        quantiles = md.residual_quantiles(point.where(f"label_end < DATE '{_SPLIT}'"))
        return md.intervals(point.where(f"date >= DATE '{_SPLIT}'").drop("slope", "intercept", "residual"), quantiles)

    return materialised(spark, d, "forecasts", make)


def _candidate_ic(spark, d):
    """Daily correlations of the candidates, whose scores of a key lie in one row from the start."""
    raw = F.col("momentum_60").alias("raw")  # the rank takes its name
    ranked = xs.factor_score(xs.ranks(_by_date(spark, d), carried=(*xs.LABELS, raw, "near_high_252")))
    values = {k: F.round("raw" if k == "momentum_60" else k, 9) for k in _KINDS}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("score")) for k, v in values.items()))
    return ev.gathered_ic(xs.examples(ranked.withColumn("all", kinds), "all"), len(_KINDS))


def affine_fit(spark, d):
    train = _scored(spark, d).where(f"label_end < DATE '{_SPLIT}'").withColumn("weight", 1 / F.col("horizon"))
    return _rounded(md.affine(train, "horizon"), 6)


def forecasts(spark, d):
    rounded = {"expected_return": F.round("expected_return", 6)} | {f"bounded_{q}": F.round(_squashed(q), 6) for q in ("q10", "q50", "q90")}
    return _forecasts(spark, d).select("date", "security_id", "horizon", "probability_up", *(v.alias(c) for c, v in rounded.items()))  # the probability has nine digits already


def task_statuses(spark, d):
    rows = _forecasts(spark, d).withColumn("q50", F.when(F.col("security_id") % 7 == 0, F.col("q90") + 1).otherwise(F.col("q50"))).withColumn("expected_return", F.when(F.col("security_id") % 11 == 0, None).otherwise(F.col("expected_return")))
    out = md.task_statuses(rows)
    return out.groupBy("horizon", "status", "probability_status", "return_status", "interval_status").agg(F.count(F.lit(1)).alias("rows"), F.count("q50").alias("intervals"), F.count("expected_return").alias("points"))


def contributions(spark, d):
    return _rounded(md.contributions(xs.ranks(_by_date(spark, d)), _WEIGHTS))


def walk_forward(spark, d):
    rows = _scored(spark, d)
    return _rounded(md.walk_forward(rows, rows.select(F.year("date").alias("year")).distinct()), 6)


def ridge_scores(spark, d):
    factors = _core(spark, d)
    targets = xs.rank_targets(xs.examples(factors)).where("horizon = 20").select("date", "security_id", "label_end", "target")
    rows = xs.ranks(factors).join(targets, ["date", "security_id"], "left")
    fit = md.ridge(rows.where(f"label_end < DATE '{_SPLIT}'").withColumn("weight", F.lit(1.0)), list(xs.INPUTS), "target", 100.0)
    return _rounded(rows.select("date", "security_id", md.ridge_score(list(xs.INPUTS), fit).alias("score")))


def probability_skill(spark, d):
    return _rounded(ev.probability_skill(_forecasts(spark, d)), 6)


def calibration_equal(spark, d):
    return _rounded(ev.calibration_equal(_forecasts(spark, d)), 6)


def calibration_error(spark, d):
    return _rounded(ev.calibration_error(ev.calibration_fixed(_forecasts(spark, d))), 6)


def interval_quality(spark, d):
    bounded = _forecasts(spark, d).withColumns({c: _squashed(c) for c in ("fwd_return", "q10", "q50", "q90")})
    return _rounded(ev.interval_quality(bounded), 6)


def bootstrap_ic(spark, d):
    return _rounded(ev.block_bootstrap(xs.daily_ic(_scored(spark, d)), "rank_ic"), 6)


def candidate_table(spark, d):
    return _rounded(ev.ic_table(_candidate_ic(spark, d)), 6)


def paired_ic(spark, d):
    return _rounded(ev.paired_difference(_candidate_ic(spark, d), "score", "momentum_60"), 6)


def nested_selection(spark, d):
    return _rounded(ev.nested_selection(_candidate_ic(spark, d), _KINDS), 6)


def release_gates(spark, d):
    skill = ev.probability_skill(_forecasts(spark, d))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual")) for m in ("skill", "direction_accuracy")))
    metrics = skill.select("horizon", F.explode(each).alias("x")).select("horizon", "x.*")
    return _rounded(ev.gates(metrics, spark.createDataFrame([("skill", 0.0), ("direction_accuracy", 0.5)], "metric string, least double")), 6)


def status_coverage(spark, d):
    return ev.status_coverage(xs.examples(_core(spark, d)), _AS_OF)


QUERIES = {f.__name__: f for f in (affine_fit, forecasts, task_statuses, contributions, walk_forward, ridge_scores, probability_skill, calibration_equal, calibration_error, interval_quality, bootstrap_ic, candidate_table, paired_ic, nested_selection, release_gates, status_coverage)}

_SCORED = f"""{_RANKS}, e AS ({_EXAMPLES}),
x AS MATERIALIZED (SELECT e.date, e.security_id, e.horizon, e.fwd_return, e.label_end, round(score, 9) AS score, f.volatility_20 / sqrt(252::DOUBLE) * sqrt(e.horizon) AS scale
  FROM e JOIN scored USING (date, security_id) JOIN f USING (date, security_id) WHERE score IS NOT NULL AND e.fwd_return IS NOT NULL AND f.volatility_20 > 0)"""
_FIT = f"""fit AS (SELECT horizon, greatest(0, regr_slope(fwd_return, score)) AS slope, avg(fwd_return) AS my, avg(score) AS mx, avg((fwd_return > 0)::INT) AS baseline_probability FROM x WHERE label_end < DATE '{_SPLIT}' GROUP BY 1)"""
_FORECAST = f"""{_SCORED}, {_FIT},
pt AS MATERIALIZED (SELECT x.*, baseline_probability, my + slope * (score - mx) AS expected_return, round(1 / (1 + exp(-score)), 9) AS probability_up FROM x JOIN fit USING (horizon)),
rs AS (SELECT horizon, (ln(1 + fwd_return) - ln(1 + expected_return)) / scale AS r FROM pt WHERE label_end < DATE '{_SPLIT}' AND fwd_return > -1 AND expected_return > -1),
rn AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY r) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM rs),
rq AS (SELECT horizon, {", ".join(f"max(r) FILTER (i = ceil({q}::DOUBLE * n)) AS r{round(q * 100)}" for q in md.LEVELS)} FROM rn WHERE n >= 30 GROUP BY 1),
p AS MATERIALIZED (SELECT pt.*, {", ".join(f"(1 + expected_return) * exp(scale * r{q}) - 1 AS q{q}" for q in (10, 50, 90))} FROM pt LEFT JOIN rq USING (horizon) WHERE date >= DATE '{_SPLIT}')"""
_CAND = f"""{_RANKS}, e AS ({_EXAMPLES}),
wide AS (SELECT date, security_id, round(scored.score, 9) AS score, round(f.momentum_60, 9) AS momentum_60, round(near_high_252, 9) AS near_high_252 FROM f JOIN scored USING (date, security_id)),
cs AS MATERIALIZED (SELECT e.horizon, e.date, e.security_id, e.fwd_return, k.kind, CASE k.kind WHEN 'score' THEN score WHEN 'momentum_60' THEN momentum_60 ELSE near_high_252 END AS score
  FROM e JOIN wide USING (date, security_id), (SELECT unnest(['score', 'momentum_60', 'near_high_252']) AS kind) k
  WHERE e.fwd_return IS NOT NULL AND score IS NOT NULL AND momentum_60 IS NOT NULL AND near_high_252 IS NOT NULL),
cr AS (SELECT kind, horizon, date, {_rank("score", "kind", "horizon", "date")} AS s, {_rank("fwd_return", "kind", "horizon", "date")} AS t FROM cs),
ci AS (SELECT kind, horizon, date, corr(s, t) AS rank_ic FROM cr GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND min(s) < max(s) AND min(t) < max(t))"""
_SKILL = """SELECT horizon, round(avg(pow(probability_up - (fwd_return > 0)::INT, 2)), 6) AS brier, round(avg(pow(baseline_probability - (fwd_return > 0)::INT, 2)), 6) AS baseline_brier,
  round(avg(abs(expected_return - fwd_return)), 6) AS mae, round(avg(((expected_return > 0) = (fwd_return > 0))::INT), 6) AS direction_accuracy, round(avg((fwd_return > 0)::INT), 6) AS up_ratio, count(*) AS rows,
  round(1 - avg(pow(probability_up - (fwd_return > 0)::INT, 2)) / avg(pow(baseline_probability - (fwd_return > 0)::INT, 2)), 6) AS skill FROM p GROUP BY 1"""
_BINNED = "avg(probability_up) AS predicted, avg((fwd_return > 0)::INT) AS observed, count(*) AS rows"
ORACLES = {
    "affine_fit": f"""WITH {_SCORED} SELECT horizon, round(greatest(0, regr_slope(fwd_return, score)), 6) AS slope, round(avg(fwd_return) - greatest(0, regr_slope(fwd_return, score)) * avg(score), 6) AS intercept FROM x WHERE label_end < DATE '{_SPLIT}' GROUP BY 1""",
    "forecasts": f"WITH {_FORECAST} SELECT date, security_id, horizon, round(expected_return, 6) AS expected_return, probability_up, {', '.join(f'round({q} / (1 + abs({q})), 6) AS bounded_{q}' for q in ('q10', 'q50', 'q90'))} FROM p",
    "task_statuses": f"""WITH {_FORECAST}, t AS (SELECT horizon, q50, CASE WHEN security_id % 7 = 0 THEN 'invalid_quantile_order' ELSE 'ok' END AS interval_status, CASE WHEN security_id % 11 = 0 THEN 'unrepresentable_prediction' ELSE 'ok' END AS return_status FROM p)
      SELECT horizon, CASE WHEN return_status <> 'ok' THEN return_status ELSE interval_status END AS status, 'ok' AS probability_status, return_status, interval_status, count(*) AS rows, count(*) FILTER (interval_status = 'ok') AS intervals, count(*) FILTER (return_status = 'ok') AS points FROM t GROUP BY ALL""",
    "contributions": f"""WITH {_RANKS}, c AS ({" UNION ALL ".join(f"SELECT date, security_id, '{c}' AS feature, {w}::DOUBLE * (2 * {c} - 1) AS contribution, {c} AS feature_value FROM k WHERE {c} IS NOT NULL" for c, w in _WEIGHTS.items())}),
      o AS (SELECT *, row_number() OVER (PARTITION BY date, security_id ORDER BY round(abs(contribution), 9) DESC, feature)::INT AS place FROM c)
      SELECT date, security_id, place, feature, round(contribution, 8) AS contribution, round(feature_value, 8) AS feature_value FROM o WHERE place <= 3""",
    "walk_forward": f"""WITH {_SCORED}, y AS (SELECT DISTINCT year(date) AS y FROM x), w AS (SELECT y, horizon, greatest(0, coalesce(regr_slope(fwd_return, score), 0)) AS slope, avg(fwd_return) AS my, avg(score) AS mx FROM y JOIN x ON year(label_end) < y GROUP BY 1, 2)
      SELECT date, security_id, horizon, round(my + slope * (score - mx), 6) AS expected_return, round(fwd_return, 6) AS fwd_return FROM x JOIN w USING (horizon) WHERE y = year(date)""",
    "probability_skill": f"WITH {_FORECAST} {_SKILL}",
    "calibration_equal": f"""WITH {_FORECAST}, b AS (SELECT *, ntile(10) OVER (PARTITION BY horizon ORDER BY probability_up, date, security_id)::INT AS bin FROM p), g AS (SELECT horizon, bin, {_BINNED} FROM b GROUP BY 1, 2)
      SELECT horizon, bin, round(predicted, 6) AS predicted, round(observed, 6) AS observed, rows FROM g""",
    "calibration_error": f"""WITH {_FORECAST}, g AS (SELECT horizon, least(floor(probability_up * 10), 9) AS bin, {_BINNED} FROM p GROUP BY 1, 2)
      SELECT horizon, round(sum(rows * abs(predicted - observed)) / sum(rows), 6) AS ece, sum(rows)::BIGINT AS rows FROM g GROUP BY 1""",
    "interval_quality": f"""WITH {_FORECAST}, lp AS (SELECT horizon, {", ".join(f"{c} / (1 + abs({c})) AS {c}" for c in ("fwd_return", "q10", "q50", "q90"))} FROM p) SELECT horizon, round(avg((fwd_return BETWEEN q10 AND q90)::INT), 6) AS coverage,
      {", ".join(f"round(avg(greatest({q} * (fwd_return - q{round(q * 100)}), ({q} - 1) * (fwd_return - q{round(q * 100)}))), 6) AS pinball_{round(q * 100)}" for q in md.LEVELS)}, count(q50) AS rows FROM lp GROUP BY 1""",
    "bootstrap_ic": f"""WITH {_SCORED}, rk AS (SELECT horizon, date, {_rank("score", "horizon", "date")} AS s, {_rank("fwd_return", "horizon", "date")} AS t FROM x),
      ic AS (SELECT horizon, date, corr(s, t) AS v FROM rk GROUP BY 1, 2 HAVING count(*) >= 20 AND min(s) < max(s) AND min(t) < max(t)),
      l AS (SELECT horizon, v, row_number() OVER (PARTITION BY horizon ORDER BY date) - 1 AS i FROM ic), z AS (SELECT horizon, count(*) AS n FROM l GROUP BY 1),
      b AS (SELECT horizon, n, rep, unnest(range(0, ceil(n / 60.0)::BIGINT)) AS blk FROM z, range(2000) r(rep)),
      st AS (SELECT *, ('0x' || substr(md5(rep || '|' || blk), 1, 8))::BIGINT % n AS start FROM b),
      ix AS (SELECT horizon, rep, (start + s) % n AS i FROM st, range(60) q(s) WHERE blk * 60 + s < n),
      m AS (SELECT horizon, rep, avg(v) AS m FROM ix JOIN l USING (horizon, i) GROUP BY 1, 2),
      c AS (SELECT horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
      SELECT horizon, round(avg(v), 6) AS mean, count(*) AS dates, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM l JOIN c USING (horizon) GROUP BY 1""",
    "candidate_table": f"WITH {_CAND} SELECT kind, horizon, round(avg(rank_ic), 6) AS mean_ic, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS ratio, round(avg((round(rank_ic, 9) > 0)::INT), 6) AS positive, count(*) AS dates FROM ci GROUP BY 1, 2",
    "paired_ic": f"WITH {_CAND} SELECT horizon, date, round(a.rank_ic - b.rank_ic, 6) AS difference FROM ci a JOIN ci b USING (horizon, date) WHERE a.kind = 'score' AND b.kind = 'momentum_60'",
    "nested_selection": f"""WITH {_CAND}, y AS (SELECT kind, horizon, year(date)::INT AS y, avg(rank_ic) AS a FROM ci GROUP BY 1, 2, 3), o AS (SELECT DISTINCT horizon, y AS outer_year FROM y),
      s AS (SELECT horizon, outer_year, kind, avg(a) AS m, median(a) AS md, min(a) AS w, count(*) FILTER (round(a, 9) > 0) AS pos FROM y JOIN o USING (horizon) WHERE y < outer_year GROUP BY 1, 2, 3),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY horizon, outer_year ORDER BY m DESC, list_position(['score', 'momentum_60', 'near_high_252'], kind)) = 1)
      SELECT b.horizon, b.kind, outer_year, round(m, 6) AS inner_mean, round(md, 6) AS inner_median, round(w, 6) AS inner_worst, pos AS positive_years, round(a, 6) AS outer_ic
      FROM b LEFT JOIN y ON y.horizon = b.horizon AND y.kind = b.kind AND y.y = outer_year""",
    "release_gates": f"""WITH {_FORECAST}, s AS ({_SKILL}), m AS (SELECT 'skill' AS metric, horizon, skill AS actual, 0.0::DOUBLE AS least FROM s UNION ALL SELECT 'direction_accuracy', horizon, direction_accuracy, 0.5 FROM s)
      SELECT metric, horizon, actual, least, actual >= least AS passed FROM m""",
    "status_coverage": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}) SELECT horizon, count(*) AS rows, count(*) FILTER (label_end <= DATE '{_AS_OF}') AS mature, count(*) FILTER (label_end > DATE '{_AS_OF}') AS immature, count(*) FILTER (label_end IS NULL) AS pending,
      count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (label_end <= DATE '{_AS_OF}' AND fwd_return IS NULL) AS mature_without_return FROM e GROUP BY 1""",
}
