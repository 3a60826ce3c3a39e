"""Queries over the panel, its factors, scores and books, with their SQL; also the SQL that other plans build on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import features as fe
from panelworks.operators import pointintime as pit
from panelworks.operators import shaping as sh
from panelworks.sources import tables as src
from panelworks.sources.store import held, materialised

FLAGSHIP = "factor_ranks"


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that sums of another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_LEAST_ADV = 30_000.0


def _squashed(column):
    """x / (1 + |x|): keeps order; the stand-in prices swing so widely that plain sums would compare noise."""
    return F.col(column) / (1 + F.abs(column))


def _days(spark, d):
    return materialised(spark, d, "days", lambda: src.calendar(src.bar_keys(spark, d)))


def _panel(spark, d):
    """The dense panel; stand-in flags: some bars are no quote, some are not valid."""
    flags = {
        "quote_present": F.col("quoted") & ((F.col("security_id") * 5 + F.col("pos")) % 89 != 0),
        "data_valid": F.when(F.col("quoted"), (F.col("security_id") * 7 + F.col("pos")) % 97 != 0),
    }
    return src.panel(spark, d).withColumns(flags)


def _factors(spark, d):
    """Factors are read by most queries, so they are written once per session and input folder."""
    return materialised(spark, d, "factors", lambda: fe.price_factors(_panel(spark, d), _days(spark, d), _LEAST_ADV))


_RANKED_A_TASK = 150_000  # rows of the core table; a rank holds a task's rows twice, before and after its sort
_CORE = ("security_id", "date", "pos", "quoted", "close", "amount", *xs.INPUTS, "near_high_252", "status", *(f"fwd_return_{h}" for h in fe.HORIZONS), *(f"label_end_{h}" for h in fe.HORIZONS))


def _core(spark, d):
    """The few factors that scores, labels and books need, without the windows of the others; from the whole table where that is written."""
    if held(spark, d, "factors"):
        return _factors(spark, d).select(*_CORE)
    return materialised(spark, d, "core", lambda: fe.price_factors(_panel(spark, d), _days(spark, d), _LEAST_ADV).select(*_CORE))


def _by_date(spark, d):
    """The same rows dealt by date for ranks: the more rows, the more partitions (a date's rows stay together), so that sorts keep to memory."""
    rows = _core(spark, d)
    return rows.repartition(src.deals(spark, rows.count(), _RANKED_A_TASK), "date")


def _predictions(spark, d):
    return xs.examples(xs.factor_score(xs.ranks(_by_date(spark, d), carried=xs.LABELS)), "score")


def weekly_bars(spark, d):
    return _rounded(src.weekly_bars(spark, d))


def dense_panel(spark, d):
    return _rounded(src.panel(spark, d).select("security_id", "date", "pos", "close", "quoted"))


def price_factors(spark, d):
    return _rounded(_factors(spark, d).drop("close", "amount", "volume", "quoted"), 6)


def market_context(spark, d):
    found = fe.market_context(_factors(spark, d), _days(spark, d))
    return _rounded(found.withColumns({f"market_momentum_{n}": _squashed(f"market_momentum_{n}") for n in (20, 60, 252)}), 6)


def single_factor_risk(spark, d):
    days = _days(spark, d)
    found = fe.single_factor_risk(_factors(spark, d), days, sh.month_ends(days))
    return _rounded(found.withColumn("residual_variance", _squashed("residual_variance")), 6)


def feature_coverage(spark, d):
    return _rounded(fe.coverage(_factors(spark, d), _ROUNDED))


def factor_ranks(spark, d):
    return _rounded(xs.factor_score(xs.ranks(_by_date(spark, d))))


def winsorised_momentum(spark, d):
    return _rounded(xs.winsorised(_factors(spark, d), "momentum_20"), 6)


def rank_targets(spark, d):
    return _rounded(xs.rank_targets(xs.examples(_core(spark, d))).select("date", "security_id", "horizon", "target"))


def purged_split(spark, d):
    parts = xs.purged_split(xs.examples(_core(spark, d)), "1998-01-05", "2000-01-03")
    return parts.groupBy("horizon", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("label_end").alias("last_label"))


def daily_ic(spark, d):
    return _rounded(xs.daily_ic(_predictions(spark, d)), 6)


def ic_summary(spark, d):
    return _rounded(xs.ic_summary(xs.daily_ic(_predictions(spark, d))), 6)


def book_curve(spark, d):
    scores = xs.factor_score(xs.ranks(_by_date(spark, d), carried=("fwd_return_1",)))
    return _rounded(xs.curve(xs.book_returns(xs.top_n(scores, 5).withColumnRenamed("fwd_return_1", "fwd_return"))), 6)


def _versions(spark, d):
    orders = src.table(spark, d, "orders")
    return orders.select(
        F.col("o_custkey").alias("security_id"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 90).cast("int"))).alias("published_at"),
        F.trunc("o_orderdate", "month").alias("period_end"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value"),
    )


def versions_asof(spark, d):
    asks = src.table(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.last_day("o_orderdate").alias("date")).distinct()
    return pit.versions_asof(asks, _versions(spark, d))


def missing_sessions(spark, d):
    return pit.missing_sessions(src.weekly_bars(spark, d))


def daily_from_ticks(spark, d):
    ticks = src.table(spark, d, "events").select(F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tie"))
    return _rounded(pit.daily_from_ticks(ticks), 4)


QUERIES = {f.__name__: f for f in (weekly_bars, dense_panel, price_factors, market_context, single_factor_risk, feature_coverage, factor_ranks, winsorised_momentum, rank_targets, purged_split, daily_ic, ic_summary, book_curve, versions_asof, missing_sessions, daily_from_ticks)}

_BARS = """bars AS (
  SELECT l_suppkey AS security_id, date_trunc('week', l_shipdate)::DATE AS date,
    arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
    arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""
_PANEL = f"""{_BARS},
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)),
spans AS (SELECT security_id, min(date) AS a, max(date) AS b FROM bars GROUP BY 1),
panel AS (
  SELECT s.security_id, d.date, d.pos, open, close, high, low, volume, amount, close IS NOT NULL AS quoted,
    close IS NOT NULL AND (s.security_id * 5 + d.pos) % 89 <> 0 AS quote_present, CASE WHEN close IS NOT NULL THEN (s.security_id * 7 + d.pos) % 97 <> 0 END AS data_valid
  FROM spans s JOIN days d ON d.date BETWEEN s.a AND s.b LEFT JOIN bars USING (security_id, date))"""


def _lag(n):
    return f"lag(close, {n}) OVER w"


def _roll(n):
    return f"OVER (PARTITION BY security_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_ROOT = "sqrt(252::DOUBLE)"
_MEAN20, _MEAN120 = (f"CASE WHEN count(amount) {_roll(n)} >= {m} THEN avg(amount) {_roll(n)} END" for n, m in ((20, 12), (120, 60)))
_FACTORS = f"""{_PANEL},
r0 AS (SELECT security_id, date, pos, open, high, low, close AS raw, quote_present AS quoted, coalesce(data_valid, false) AS valid, CASE WHEN data_valid THEN close END AS close,
  CASE WHEN quote_present THEN amount END AS amount, CASE WHEN quote_present THEN volume END AS volume, row_number() OVER (PARTITION BY security_id ORDER BY pos) - 1 AS local FROM panel),
r1 AS (SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS return_1 FROM r0 WINDOW w AS (PARTITION BY security_id ORDER BY pos)),
r2 AS (SELECT *, CASE WHEN return_1 > -1 THEN ln(1 + return_1) END AS log_return, abs(return_1) / nullif(amount, 0) AS illiquid, CASE WHEN close IS NOT NULL THEN volume END AS both_v FROM r1),
f1 AS (SELECT security_id, date, pos, quoted, valid, close, amount, volume, return_1, log_return,
  sum(quoted::INT) {_roll(100000)} AS history_sessions,
  {_MEAN20} AS adv20_amount,
  {", ".join(f"CASE WHEN {_lag(n)} <> 0 THEN close / {_lag(n)} - 1 END AS momentum_{n}" for n in (5, 20, 60, 120, 252))},
  {_lag(20)} / nullif({_lag(252)}, 0) - 1 AS momentum_252_skip20,
  {_lag(20)} / nullif({_lag(60)}, 0) - 1 AS momentum_60_skip20,
  {", ".join(f"CASE WHEN count(log_return) {_roll(n)} >= {m} THEN stddev_samp(log_return) {_roll(n)} * {_ROOT} END AS volatility_{n}" for n, m in ((20, 12), (60, 30), (252, 126)))},
  CASE WHEN count(log_return) {_roll(60)} >= 30 THEN sqrt(avg(CASE WHEN log_return IS NOT NULL THEN pow(least(log_return, 0), 2) END) {_roll(60)}) * {_ROOT} END AS downside_volatility_60,
  CASE WHEN count(return_1) {_roll(20)} >= 12 THEN max(return_1) {_roll(20)} END AS max_return_20,
  CASE WHEN count(return_1) {_roll(60)} >= 30 THEN skewness(return_1) {_roll(60)} END AS return_skew_60,
  {", ".join(f"CASE WHEN count(close) {_roll(252)} >= 60 THEN close / nullif({f}(close) {_roll(252)}, 0) - 1 END AS {n}" for f, n in (("max", "near_high_252"), ("min", "near_low_252")))},
  {", ".join(f"CASE WHEN count(close) {_roll(n)} >= {m} THEN close / nullif(avg(close) {_roll(n)}, 0) - 1 END AS bias_{n}" for n, m in ((20, 12), (60, 30)))},
  CASE WHEN count(illiquid) {_roll(20)} >= 12 THEN avg(illiquid) {_roll(20)} * 1e8 END AS amihud_20,
  CASE WHEN {_MEAN20} > 0 THEN ln({_MEAN20}) END AS log_amount_20,
  {_MEAN20} / nullif({_MEAN120}, 0) AS amount_ratio_20_120,
  {", ".join(f"CASE WHEN count({c}) {_roll(20)} >= 12 THEN stddev_samp({c}) {_roll(20)} / nullif(avg({c}) {_roll(20)}, 0) END AS {c}_cv_20" for c in ("amount", "volume"))},
  CASE WHEN count(both_v) {_roll(20)} >= 20 THEN corr(close, both_v) {_roll(20)} END AS price_volume_corr_20,
  (high - low) / nullif(raw, 0) AS intraday_range, raw / nullif(open, 0) - 1 AS intraday_return,
  local - coalesce(last_value(CASE WHEN quoted THEN local END IGNORE NULLS) {_roll(100000)}, -1) AS sessions_since_quote,
  {", ".join(f"lead(close, {h}) OVER w / nullif(close, 0) - 1 AS fwd_return_{h}" for h in fe.HORIZONS)}
  FROM r2 WINDOW w AS (PARTITION BY security_id ORDER BY pos)),
f AS MATERIALIZED (SELECT f1.*, {", ".join(f"d{h}.date AS label_end_{h}" for h in fe.HORIZONS)}, CASE WHEN NOT valid OR close IS NULL THEN 'data_issue' WHEN NOT quoted THEN 'no_trade_quote'
  WHEN adv20_amount < {_LEAST_ADV} THEN 'below_liquidity_floor' WHEN history_sessions < 60 THEN 'insufficient_history' ELSE 'ok' END AS status
  FROM f1 {" ".join(f"LEFT JOIN days d{h} ON d{h}.pos = f1.pos + {h}" for h in fe.HORIZONS)})"""


def _rank(column, *by):
    part = ", ".join(by)
    return f"""CASE WHEN {column} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {column} IS NULL ORDER BY {column})
      + (count(*) OVER (PARTITION BY {part}, {column}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {part}, {column} IS NULL) END"""


_RANKS = f"""{_FACTORS},
k AS MATERIALIZED (SELECT date, security_id, {", ".join(f"{_rank(c, 'date')} AS {c}" for c in xs.INPUTS)} FROM f WHERE status = 'ok'),
scored AS (SELECT *, 0.5::DOUBLE * (momentum_60 - momentum_5 - volatility_20 + adv20_amount) AS score FROM k)"""
_EXAMPLES = " UNION ALL ".join(f"SELECT date, security_id, status, {h}::INT AS horizon, fwd_return_{h} AS fwd_return, label_end_{h} AS label_end FROM f" for h in fe.HORIZONS)
_IC = f"""{_RANKS}, e AS ({_EXAMPLES}),
both_known AS (SELECT e.horizon, e.date, score, fwd_return FROM e JOIN scored USING (date, security_id) WHERE score IS NOT NULL AND fwd_return IS NOT NULL),
rk AS (SELECT horizon, date, {_rank("score", "horizon", "date")} AS s, {_rank("fwd_return", "horizon", "date")} AS t FROM both_known),
ic AS (SELECT horizon, date, corr(s, t) AS rank_ic, count(*) AS names FROM rk GROUP BY 1, 2 HAVING count(*) >= 20 AND min(s) < max(s) AND min(t) < max(t))"""
_ROUNDED = ["return_1", "log_return", "adv20_amount", "momentum_5", "momentum_20", "momentum_60", "momentum_120", "momentum_252", "momentum_252_skip20", "momentum_60_skip20", "volatility_20", "volatility_60", "volatility_252", "log_amount_20", "amount_ratio_20_120", "amount_cv_20", "volume_cv_20", "downside_volatility_60", "max_return_20", "return_skew_60", "near_high_252", "near_low_252", "bias_20", "bias_60", "amihud_20", "intraday_range", "intraday_return", "price_volume_corr_20", "fwd_return_1", "fwd_return_5", "fwd_return_20", "fwd_return_60"]
_MARKET = """SELECT d.date, d.pos, median(return_1) FILTER (quoted) AS market_return, avg((bias_60 > 0)::INT) FILTER (quoted AND bias_60 IS NOT NULL) AS market_breadth_60, count(return_1) FILTER (quoted) AS names
  FROM days d LEFT JOIN f USING (date) GROUP BY 1, 2"""
ORACLES = {
    "weekly_bars": f"WITH {_BARS} SELECT security_id, date, round(open, 8) AS open, round(close, 8) AS close, round(high, 8) AS high, round(low, 8) AS low, round(volume, 8) AS volume, round(amount, 8) AS amount FROM bars",
    "dense_panel": f"WITH {_PANEL} SELECT security_id, date, pos::INT AS pos, round(close, 8) AS close, quoted FROM panel",
    "price_factors": f"WITH {_FACTORS} SELECT security_id, date, pos::INT AS pos, history_sessions::BIGINT AS history_sessions, sessions_since_quote::INT AS sessions_since_quote, label_end_1, label_end_5, label_end_20, label_end_60, status, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM f",
    "market_context": f"""WITH {_FACTORS}, m AS ({_MARKET}),
      c AS (SELECT *, {", ".join(f"CASE WHEN count(market_return) OVER w{n} = {n} THEN exp(sum(ln(1 + market_return)) OVER w{n}) - 1 END AS market_momentum_{n}" for n in (20, 60, 252))},
        CASE WHEN count(market_return) OVER w60 >= 30 THEN stddev_samp(market_return) OVER w60 * {_ROOT} END AS market_volatility_60 FROM m
        WINDOW {", ".join(f"w{n} AS (ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 60, 252))})
      SELECT date, round(market_return, 6) AS market_return, round(market_breadth_60, 6) AS market_breadth_60, names, {", ".join(f"round(market_momentum_{n} / (1 + abs(market_momentum_{n})), 6) AS market_momentum_{n}" for n in (20, 60, 252))},
        round(market_volatility_60, 6) AS market_volatility_60 FROM c""",
    "single_factor_risk": f"""SELECT * EXCLUDE (rv) FROM (WITH {_FACTORS}, m AS ({_MARKET}),
      e AS (SELECT date, pos FROM days QUALIFY date_trunc('month', date) < date_trunc('month', lead(date) OVER (ORDER BY date))),
      g AS (SELECT e.date FROM e JOIN m ON m.pos BETWEEN e.pos - 252 AND e.pos - 1 GROUP BY 1 HAVING count(market_return) >= 60 AND var_samp(market_return) > 0)
      SELECT e.date, h.security_id, regr_count(h.return_1, x)::BIGINT AS n, round(regr_slope(h.return_1, x), 6) AS beta, round(regr_intercept(h.return_1, x), 6) AS intercept,
        (regr_syy(h.return_1, x) - pow(regr_sxy(h.return_1, x), 2) / regr_sxx(h.return_1, x)) / (regr_count(h.return_1, x) - 2) * 252 AS rv, round(rv / (1 + abs(rv)), 6) AS residual_variance
      FROM e JOIN g USING (date) JOIN f c ON c.date = e.date JOIN (SELECT f.security_id, f.pos, return_1, market_return AS x FROM f JOIN m USING (date)) h ON h.security_id = c.security_id AND h.pos BETWEEN e.pos - 252 AND e.pos - 1
      GROUP BY 1, 2 HAVING regr_count(h.return_1, x) >= 60)""",
    "feature_coverage": f"WITH {_FACTORS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known, count(*) AS rows, round(count({c}) / count(*)::DOUBLE, 8) AS share, count({c}) / count(*)::DOUBLE >= 0.2 AS kept FROM f" for c in _ROUNDED),
    "factor_ranks": f"WITH {_RANKS} SELECT date, security_id, {', '.join(f'round({c}, 8) AS {c}' for c in (*xs.INPUTS, 'score'))} FROM scored",
    "winsorised_momentum": f"""WITH {_FACTORS}, x AS (SELECT date, security_id, momentum_20 AS x FROM f WHERE status = 'ok' AND momentum_20 IS NOT NULL),
      m AS (SELECT date, median(x) AS m FROM x GROUP BY 1), s AS (SELECT date, any_value(m) AS m, median(abs(x - m)) AS mad FROM x JOIN m USING (date) GROUP BY 1),
      c AS (SELECT date, security_id, greatest(least(x, m + 7.413 * mad), m - 7.413 * mad)::DOUBLE AS x FROM x JOIN s USING (date))
      SELECT date, security_id, round(CASE WHEN coalesce(stddev_samp(x) OVER w, 0) = 0 THEN 0 ELSE (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) AS z FROM c WINDOW w AS (PARTITION BY date)""",
    "rank_targets": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}) SELECT date, security_id, horizon, round(CASE WHEN count(*) OVER w >= 20 THEN {_rank("fwd_return", "date", "horizon")} - (count(*) OVER w + 1) / (2.0::DOUBLE * count(*) OVER w) END, 8) AS target
      FROM e WHERE fwd_return IS NOT NULL WINDOW w AS (PARTITION BY date, horizon)""",
    "purged_split": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}) SELECT horizon, CASE WHEN date < DATE '1998-01-05' AND label_end < DATE '1998-01-05' THEN 'train' WHEN date >= DATE '1998-01-05' AND label_end <= DATE '2000-01-03' THEN 'calibrate' ELSE 'purged' END AS part,
      count(*) AS rows, min(date) AS first_date, max(label_end) AS last_label FROM e WHERE fwd_return IS NOT NULL GROUP BY 1, 2""",
    "daily_ic": f"WITH {_IC} SELECT horizon, date, round(rank_ic, 6) AS rank_ic, names FROM ic",
    "ic_summary": f"""WITH {_IC}, y AS (SELECT horizon, year(date) AS y, avg(rank_ic) AS a, sum(rank_ic) AS t, count(*) AS n FROM ic GROUP BY 1, 2)
      SELECT horizon, round(sum(t) / sum(n), 6) AS mean_ic, round(avg(a), 6) AS mean_annual_ic, round(avg((a > 0)::INT), 6) AS positive_years, sum(n)::BIGINT AS dates FROM y GROUP BY 1""",
    "book_curve": f"""WITH {_RANKS}, p AS (SELECT date, security_id, row_number() OVER (PARTITION BY date ORDER BY score DESC, security_id) AS place FROM scored WHERE score IS NOT NULL),
      b AS (SELECT p.date, CASE WHEN count(fwd_return_1) = count(*) THEN avg(fwd_return_1) END AS book_return, count(*) AS holdings FROM p JOIN f USING (date, security_id) WHERE place <= 5 GROUP BY 1),
      c AS (SELECT *, sum(ln(1 + book_return)) OVER (ORDER BY date) AS log_wealth FROM b WHERE book_return IS NOT NULL)
      SELECT date, round(book_return, 6) AS book_return, holdings, round(log_wealth, 6) AS log_wealth, round(exp(log_wealth - max(log_wealth) OVER (ORDER BY date)) - 1, 6) AS drawdown FROM c""",
    "versions_asof": """WITH v AS (SELECT o_custkey AS security_id, o_orderdate + to_days((o_orderkey % 90)::INT) AS published_at, date_trunc('month', o_orderdate)::DATE AS period_end, o_orderkey AS version, o_totalprice AS value FROM orders),
      k AS (SELECT * FROM v QUALIFY period_end = max(period_end) OVER (PARTITION BY security_id ORDER BY published_at, version ROWS UNBOUNDED PRECEDING)),
      a AS (SELECT DISTINCT o_custkey AS security_id, last_day(o_orderdate) AS date FROM orders)
      SELECT a.security_id, a.date, arg_max(k.period_end, row(published_at, version)) AS period_end, arg_max(value, row(published_at, version)) AS value, arg_max(version, row(published_at, version)) AS version
      FROM a LEFT JOIN k ON a.security_id = k.security_id AND published_at <= a.date GROUP BY 1, 2""",
    "missing_sessions": f"WITH {_PANEL} SELECT security_id, date FROM panel WHERE NOT quoted",
    "daily_from_ticks": """SELECT user_id AS code, ts::DATE AS date, round(arg_min(value, row(ts, event_id)) FILTER (value > 0), 4) AS open, round(arg_max(value, row(ts, event_id)) FILTER (value > 0), 4) AS close,
      round(max(value) FILTER (value > 0), 4) AS high, round(min(value) FILTER (value > 0), 4) AS low, round(CASE WHEN count(value) = count(*) THEN sum(value::DECIMAL(18,4)) END::DOUBLE, 4) AS amount,
      count(*) AS ticks, count(*) FILTER (value < 0) AS negative, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""",
}
