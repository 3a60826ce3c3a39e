"""Queries of the choice of prediction heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import evaluation as ev
from panelworks.operators import heads as hd
from panelworks.plans.evaluation import _CAND, _SCORED, _candidate_ic, _scored
from panelworks.plans.panel import _rank, _rounded
from panelworks.sources.store import materialised

_MODELS = {"factor": (1.0, 3, 0), "linear": (0.5, 5, 1), "blend": (0.8, 7, 2)}
_YEARS, _CUTOFF, _WIDTH = [1996, 1997], "1998-06-01", 0.8


def _models(spark, d):
    """Stand-ins of three candidates with their common samples, gathered by key once: their outputs are functions of the scored examples, their failures of the security."""

    def make():
        y = F.round(F.col("fwd_return") / (1 + F.abs("fwd_return")), 9)
        kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.lit(k).alias("k"), F.lit(c).alias("c"), F.lit(j).alias("j")) for n, (k, c, j) in _MODELS.items()))
        rows = _scored(spark, d).select("date", "security_id", "horizon", "label_end", y.alias("fwd_return"), F.col("score").alias("s"), F.explode(kinds).alias("m")).select("*", "m.*")
        point = F.round(0.02 * F.col("k") * F.col("s"), 9)
        failed = F.lit("insufficient_model_inputs")
        found = rows.select(
            "kind", "date", "security_id", "horizon", "label_end", "fwd_return", F.round(F.col("s") * F.col("k") + 0.01 * (F.col("security_id") % F.col("c")), 9).alias("score"),
            F.round(0.5 + F.col("k") * (1 / (1 + F.exp(-0.1 * F.col("s"))) - 0.5), 9).alias("probability_up"), F.lit(0.52).alias("baseline_probability"), point.alias("expected_return"),
            (point - _WIDTH).alias("q10"), point.alias("q50"), (point + _WIDTH).alias("q90"), F.lit(-0.9).alias("baseline_q10"), F.lit(0.1).alias("baseline_q50"), F.lit(0.9).alias("baseline_q90"),
            F.when(F.col("security_id") % 13 == F.col("j"), failed).otherwise("ok").alias("score_status"),
            F.when(F.col("security_id") % 11 == F.col("j"), failed).otherwise("ok").alias("probability_status"),
            F.when((F.col("security_id") % 19 == 4) & (F.col("horizon") == 5) & (F.col("kind") == "blend"), "invalid_quantile_order").when(F.col("security_id") % 17 == F.col("j"), failed).otherwise("ok").alias("interval_status"),
            F.when(F.col("security_id") % 7 == F.col("j"), failed).otherwise("ok").alias("return_status"),
        )
        return hd.common_samples(found, len(_MODELS), _CUTOFF)

    return materialised(spark, d, "models", make)


def task_coverage(spark, d):
    return hd.task_coverage(_models(spark, d))


def component_metrics(spark, d):
    return _rounded(hd.component_metrics(_models(spark, d)), 6)


def _heads(spark, d):
    common = _models(spark, d)
    return hd.choose_heads(hd.component_metrics(common), hd.task_coverage(common), list(_MODELS), _YEARS)


def component_heads(spark, d):
    return _rounded(_heads(spark, d), 6)


def combined_forecasts(spark, d):
    return _rounded(hd.combine_heads(_models(spark, d), _heads(spark, d)))


def paired_interval(spark, d):
    difference = ev.paired_difference(_candidate_ic(spark, d), "score", "momentum_60")
    return _rounded(ev.block_bootstrap(difference, "difference"), 6)


QUERIES = {f.__name__: f for f in (task_coverage, component_metrics, component_heads, combined_forecasts, paired_interval)}

_VALUES = ", ".join(f"('{n}', {k}::DOUBLE, {c}, {j})" for n, (k, c, j) in _MODELS.items())
_TASKS = {"score": "score_status", "probability_up": "probability_status", "intervals": "interval_status", "expected_return": "return_status"}
_MODEL = f"""{_SCORED}, md AS MATERIALIZED (SELECT kind, date, security_id, horizon, label_end, round(fwd_return / (1 + abs(fwd_return)), 9) AS fwd_return, round(score * k + 0.01::DOUBLE * (security_id % c), 9) AS score,
  round(0.5 + k * (1 / (1 + exp(-0.1::DOUBLE * x.score)) - 0.5), 9) AS probability_up, 0.52::DOUBLE AS baseline_probability, round(0.02::DOUBLE * k * x.score, 9) AS expected_return,
  round(0.02::DOUBLE * k * x.score, 9) - {_WIDTH}::DOUBLE AS q10, round(0.02::DOUBLE * k * x.score, 9) AS q50, round(0.02::DOUBLE * k * x.score, 9) + {_WIDTH}::DOUBLE AS q90, -0.9::DOUBLE AS baseline_q10, 0.1::DOUBLE AS baseline_q50, 0.9::DOUBLE AS baseline_q90,
  CASE WHEN security_id % 13 = j THEN 'insufficient_model_inputs' ELSE 'ok' END AS score_status, CASE WHEN security_id % 11 = j THEN 'insufficient_model_inputs' ELSE 'ok' END AS probability_status,
  CASE WHEN security_id % 19 = 4 AND horizon = 5 AND kind = 'blend' THEN 'invalid_quantile_order' WHEN security_id % 17 = j THEN 'insufficient_model_inputs' ELSE 'ok' END AS interval_status,
  CASE WHEN security_id % 7 = j THEN 'insufficient_model_inputs' ELSE 'ok' END AS return_status FROM x, (VALUES {_VALUES}) v(kind, k, c, j))"""
_MATURE = f"fwd_return >= -1 AND label_end <= DATE '{_CUTOFF}'"
_SAMPLES = f"""{_MODEL}, cm AS MATERIALIZED (SELECT *, {", ".join(f"{s} = 'ok' AND {_MATURE} AS m_{t}, count(*) FILTER ({s} = 'ok' AND {_MATURE}) OVER (PARTITION BY date, security_id, horizon) = {len(_MODELS)} AS c_{t}" for t, s in _TASKS.items())} FROM md),
pr AS MATERIALIZED (SELECT *, unnest([year(date)::VARCHAR, 'all']) AS period, (fwd_return > 0)::INT AS up FROM cm)"""


def _loss(prefix):
    return "(" + " + ".join(f"greatest({q} * (fwd_return - {prefix}q{round(q * 100)}), ({q} - 1) * (fwd_return - {prefix}q{round(q * 100)}))" for q in (0.1, 0.5, 0.9)) + ") / 3"


_COVERAGE = " UNION ALL ".join(
    f"""SELECT '{t}' AS task, horizon, kind, year(date)::INT AS year, count(*) AS raw_rows, count(*) FILTER ({s} = 'ok') AS scorable_rows, count(*) FILTER (m_{t}) AS mature_rows, count(*) FILTER ({s} = 'insufficient_model_inputs') AS input_unavailable_rows,
  count(*) FILTER ({s} IN ('unrepresentable_prediction', 'invalid_return_range', 'invalid_quantile_order')) AS model_rejected_rows, count(*) FILTER (c_{t}) AS common_rows FROM cm GROUP BY ALL"""
    for t, s in _TASKS.items()
)
_METRICS = f"""{_SAMPLES},
rk AS (SELECT horizon, kind, period, date, {_rank("score", "kind", "horizon", "period", "date")} AS s, {_rank("fwd_return", "kind", "horizon", "period", "date")} AS t FROM pr WHERE c_score),
ic AS (SELECT horizon, kind, period, date, corr(s, t) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 20 AND min(s) < max(s) AND min(t) < max(t)),
ia AS (SELECT horizon, kind, period, avg(ic) AS score, count(*) AS score_dates FROM ic GROUP BY ALL),
bn AS (SELECT horizon, kind, period, probability_up AS p, up, ntile(10) OVER (PARTITION BY horizon, kind, period ORDER BY probability_up, date, security_id) AS bin FROM pr WHERE c_probability_up),
be AS (SELECT horizon, kind, period, count(*) AS n, abs(avg(p) - avg(up)) AS gap FROM bn GROUP BY horizon, kind, period, bin), ec AS (SELECT horizon, kind, period, sum(n * gap) / sum(n) AS ece FROM be GROUP BY ALL),
mx AS (SELECT horizon, kind, period, {", ".join(f"count(*) FILTER (c_{t}) AS {t}_samples" for t in _TASKS)}, avg(pow(probability_up - up, 2)) FILTER (c_probability_up) AS probability_up, avg(pow(baseline_probability - up, 2)) FILTER (c_probability_up) AS baseline_brier,
  avg({_loss("")}) FILTER (c_intervals) AS intervals, avg({_loss("baseline_")}) FILTER (c_intervals) AS baseline_pinball, avg((fwd_return BETWEEN q10 AND q90)::INT) FILTER (c_intervals) AS interval_coverage,
  avg(pow(expected_return - fwd_return, 2)) FILTER (c_expected_return) AS expected_return FROM pr GROUP BY ALL),
mt AS MATERIALIZED (SELECT mx.*, score, coalesce(score_dates, 0) AS score_dates, ece FROM mx LEFT JOIN ia USING (horizon, kind, period) LEFT JOIN ec USING (horizon, kind, period))"""
_FIGURES = ("score", "probability_up", "baseline_brier", "intervals", "baseline_pinball", "interval_coverage", "expected_return", "ece")
_GATE = {"probability_up": "coalesce(probability_up < baseline_brier AND ece <= 0.05, false)", "intervals": "coalesce(intervals < baseline_pinball AND interval_coverage BETWEEN 0.75 AND 0.85, false)"}
_CHOICE = f"""{_METRICS}, cv AS ({_COVERAGE}), rj AS (SELECT task, horizon, kind, sum(model_rejected_rows) AS rejected FROM cv GROUP BY ALL),
ls AS ({" UNION ALL ".join(f"SELECT '{t}' AS task, horizon, kind, period, {'-' if t == 'score' else ''}{t} AS loss, {_GATE.get(t, 'true')} AS gate FROM mt" for t in _TASKS)}),
ov AS (SELECT task, horizon, kind, loss, gate, list_position(['factor', 'linear', 'blend'], kind) AS place FROM ls WHERE period = 'all'),
yl AS (SELECT * FROM ls WHERE period IN ({", ".join(f"'{y}'" for y in _YEARS)}) AND loss IS NOT NULL),
us AS (SELECT ov.* FROM ov JOIN (SELECT task, horizon, kind FROM yl GROUP BY ALL HAVING count(*) = {len(_YEARS)}) USING (task, horizon, kind) WHERE loss IS NOT NULL),
bs AS (SELECT * FROM us WHERE kind IN ('factor', 'linear') QUALIFY row_number() OVER (PARTITION BY task, horizon ORDER BY loss, place) = 1),
wn AS (SELECT a.task, a.horizon, a.kind, count(*) FILTER (a.loss < b.loss) / {len(_YEARS)}::DOUBLE AS wins FROM yl a JOIN bs USING (task, horizon) JOIN yl b ON b.task = a.task AND b.horizon = a.horizon AND b.period = a.period AND b.kind = bs.kind GROUP BY ALL),
ok AS (SELECT us.* FROM us JOIN bs ON bs.task = us.task AND bs.horizon = us.horizon JOIN wn ON wn.task = us.task AND wn.horizon = us.horizon AND wn.kind = us.kind JOIN rj ON rj.task = us.task AND rj.horizon = us.horizon AND rj.kind = us.kind WHERE us.gate AND rejected = 0 AND (us.kind IN ('factor', 'linear') OR (wins >= 0.6 AND us.loss < bs.loss))),
ch AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY task, horizon ORDER BY loss, place) = 1),
hs AS MATERIALIZED (SELECT g.horizon, g.task, ch.kind, ch.loss, bs.kind AS base FROM (SELECT DISTINCT horizon, task FROM ov) g LEFT JOIN ch USING (horizon, task) LEFT JOIN bs USING (horizon, task))"""


def _from_head(task, column):
    return f"max(CASE WHEN task = '{task}' AND {_TASKS[task]} = 'ok' THEN round({column}, 8) END) AS {column}"


_COLUMNS = {"score": ("score",), "probability_up": ("probability_up", "baseline_probability"), "intervals": ("q10", "q50", "q90", "baseline_q10", "baseline_q50", "baseline_q90"), "expected_return": ("expected_return",)}
ORACLES = {
    "task_coverage": f"WITH {_SAMPLES} {_COVERAGE}",
    "component_metrics": f"WITH {_METRICS} SELECT horizon, kind, period, score_dates, {', '.join(f'{t}_samples' for t in _TASKS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _FIGURES)} FROM mt",
    "component_heads": f"WITH {_CHOICE} SELECT horizon, task, kind, round(loss, 6) AS loss, base FROM hs",
    "combined_forecasts": f"""WITH {_CHOICE}, j AS (SELECT md.*, task FROM md LEFT JOIN hs ON hs.horizon = md.horizon AND hs.kind = md.kind),
      o AS (SELECT date, security_id, horizon, {", ".join(f"coalesce(max(CASE WHEN task = '{t}' THEN {s} END), 'insufficient_model_inputs') AS {s}" for t, s in _TASKS.items())},
      {", ".join(_from_head(t, c) for t, cs in _COLUMNS.items() for c in cs)} FROM j GROUP BY 1, 2, 3)
      SELECT *, CASE WHEN interval_status = 'invalid_quantile_order' THEN interval_status WHEN 'insufficient_model_inputs' IN ({", ".join(_TASKS.values())}) THEN 'insufficient_model_inputs' ELSE 'ok' END AS status FROM o""",
    "paired_interval": f"""WITH {_CAND}, l AS (SELECT horizon, a.rank_ic - b.rank_ic AS v, row_number() OVER (PARTITION BY horizon ORDER BY date) - 1 AS i FROM ci a JOIN ci b USING (horizon, date) WHERE a.kind = 'score' AND b.kind = 'momentum_60'),
      z AS (SELECT horizon, count(*) AS n FROM l GROUP BY 1), b AS (SELECT horizon, n, rep, unnest(range(0, ceil(n / 60.0)::BIGINT)) AS blk FROM z, range(2000) r(rep)),
      st AS (SELECT *, ('0x' || substr(md5(rep || '|' || blk), 1, 8))::BIGINT % n AS start FROM b), ix AS (SELECT horizon, rep, (start + s) % n AS i FROM st, range(60) q(s) WHERE blk * 60 + s < n),
      m AS (SELECT horizon, rep, avg(v) AS m FROM ix JOIN l USING (horizon, i) GROUP BY 1, 2), c AS (SELECT horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
      SELECT horizon, round(avg(v), 6) AS mean, count(*) AS dates, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM l JOIN c USING (horizon) GROUP BY 1""",
}
