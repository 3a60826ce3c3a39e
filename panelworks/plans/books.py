"""Queries of monthly books and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import books as bk
from panelworks.operators import cross_section as xs
from panelworks.operators import shaping as sh
from panelworks.plans.panel import _FACTORS, _RANKS, _core, _days, _rounded
from panelworks.sources import tables as src

_NAMES = 5


def _monthly(spark, d):
    factors = _core(spark, d)
    calendar = _days(spark, d)
    ends = sh.month_ends(calendar)
    scores = xs.factor_score(xs.ranks(factors.join(F.broadcast(ends), "date"))).select("date", "security_id", F.round("score", 9).alias("score"))  # one row a month
    return factors, xs.top_n(scores, _NAMES), bk.signal_intervals(ends, calendar)


def interval_returns(spark, d):
    factors, selected, intervals = _monthly(spark, d)
    found = bk.interval_returns(selected, factors.select("security_id", "date", "close"), intervals)
    return _rounded(found.select("signal", "security_id", "entry", "exit", "gross_return"), 6)


def monthly_book(spark, d):
    factors, selected, intervals = _monthly(spark, d)
    return _rounded(bk.monthly_book(bk.interval_returns(selected, factors.select("security_id", "date", "close"), intervals)), 6)


def book_summary(spark, d):
    factors, selected, intervals = _monthly(spark, d)
    prices = factors.select("security_id", "date", F.last("close", True).over(_along()).alias("close"))  # last known prices
    found = bk.summary(bk.monthly_book(bk.interval_returns(selected, prices, intervals)).where("missing = 0"))
    growth = found.select("*", F.log1p("total_return").alias("log_growth"), F.log1p("cagr").alias("yearly_log_growth"))  # stand-in returns are huge
    return _rounded(growth.drop("total_return", "cagr"), 6)


def _slots(spark, d):
    """Books of one name each: the first, second, ... of a month's names by id, by quarter."""
    from pyspark.sql import Window

    factors, selected, intervals = _monthly(spark, d)
    returns = bk.interval_returns(selected, factors.select("security_id", "date", "close"), intervals)
    return returns.withColumns({"slot": F.row_number().over(Window.partitionBy("signal").orderBy("security_id")), "quarter": _quarter("signal")})


def quarterly_book_summary(spark, d):
    """With the months whose outcomes are not known."""
    found = bk.summary(bk.monthly_book(_slots(spark, d), "slot", "quarter"), "slot", "quarter")
    growth = found.select("*", F.log1p("total_return").alias("log_growth"), F.log1p("cagr").alias("yearly_log_growth"))
    return _rounded(growth.drop("total_return", "cagr"), 6)


def _quarter(date):
    return F.year(date) * 4 + F.quarter(date)


def _along():
    from pyspark.sql import Window

    return Window.partitionBy("security_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def book_turnover(spark, d):
    return _rounded(bk.turnover(_monthly(spark, d)[1]))


def trading_capacity(spark, d):
    factors, selected, _ = _monthly(spark, d)
    return _rounded(bk.capacity(selected, factors), 4)


def order_ledger(spark, d):
    line = src.table(spark, d, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    trades = line.select(F.col("l_suppkey").alias("account"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"), signed.alias("quantity"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_partkey"))
    found = bk.positions_ledger(trades.groupBy("account", "ts", "tie").agg(F.sum("quantity").alias("quantity"), F.max("price").alias("price")))
    return _rounded(found, 2)


def _pool(spark, d):
    factors, selected, intervals = _monthly(spark, d)
    ends = sh.month_ends(_days(spark, d))
    return xs.ranks(factors.join(F.broadcast(ends), "date")).select("date", "security_id"), factors, selected, intervals  # one row a month


def benchmarked_book(spark, d):
    pool, factors, selected, intervals = _pool(spark, d)
    found = bk.benchmarked_book(selected, pool, factors.select("security_id", "date", "close"), intervals)
    return _rounded(found, 6)


def _months(spark, d):
    """The one-name books beside the mean of the month's names, returns drawn together; stand-in correlation and turnover."""
    from pyspark.sql import Window

    small = lambda c: c / (1 + F.abs(c)) / 4
    rows = _slots(spark, d)
    mean = F.avg("gross_return").over(Window.partitionBy("signal"))
    return rows.select("slot", "quarter", "signal", small(F.col("gross_return")).alias("book"), small(mean).alias("benchmark"), (F.col("security_id") % 7 / 10 - 0.25).alias("ic"), (F.col("security_id") % 5 / 5).alias("turnover"))


def book_metrics(spark, d):
    return _rounded(bk.book_metrics(_months(spark, d), "slot", "quarter"), 6)


def metric_checks(spark, d):
    found = bk.book_metrics(_months(spark, d), "slot", "quarter").select("slot", "quarter", *(F.round(m, 6).alias(m) for m in _CHECKS))
    return _rounded(bk.metric_checks(found, _CHECKS), 6)


def constraint_audit(spark, d):
    """Books a customer, weights by value of orders; estimates of priorities as names."""
    orders = src.table(spark, d, "orders")
    line = orders.groupBy(F.col("o_custkey").alias("book"), F.substring("o_orderpriority", 1, 1).cast("long").alias("security_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    from pyspark.sql import Window

    weights = line.select("book", "security_id", (F.col("v").cast("double") / F.sum("v").over(Window.partitionBy("book")).cast("double") * F.when(F.col("book") % 3 == 0, 1.1).otherwise(0.9)).alias("weight"))
    estimates = spark.range(1, 6).where("id <> 5").select(F.col("id").alias("security_id"), (0.5 + F.col("id") / 4).alias("beta"), (F.col("id") / 10).alias("residual_variance"))
    return _rounded(bk.constraint_audit(weights, estimates, 0.04, 0.35, 1.0, 0.4), 6)


def signal_sheet(spark, d):
    factors = _core(spark, d)
    ends = sh.month_ends(_days(spark, d))
    scores = xs.factor_score(xs.ranks(factors.join(F.broadcast(ends), "date"))).select("date", "security_id", "score")
    return _rounded(bk.signal_sheet(scores, _NAMES), 6)


def cohort_book(spark, d):
    return _rounded(bk.cohort_book(_core(spark, d).select("date", "security_id", "status")), 8)


_CHECKS = {"yearly_excess": ("min", 0.02), "information_ratio": ("min", 0.5), "monthly_win": ("min", 0.5), "yearly_turnover": ("max", 7.0), "months": ("min", 12.0)}
QUERIES = {f.__name__: f for f in (interval_returns, monthly_book, book_summary, quarterly_book_summary, benchmarked_book, book_metrics, metric_checks, constraint_audit, signal_sheet, cohort_book, book_turnover, trading_capacity, order_ledger)}

_BOOK = f"""{_RANKS}, ends AS (SELECT date FROM (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM days) WHERE date_trunc('month', date) < date_trunc('month', nxt)),
sel AS (SELECT date, security_id FROM scored JOIN ends USING (date) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, security_id) <= {_NAMES}),
nx AS (SELECT date AS signal, lead(date) OVER (ORDER BY pos) AS entry FROM days), iv AS (SELECT * FROM (SELECT signal, entry, lead(entry) OVER (ORDER BY signal) AS exit FROM nx JOIN ends ON signal = ends.date) WHERE exit IS NOT NULL),
px AS (SELECT security_id, date, pos, close, last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY pos) AS known FROM f)"""


def _returns(price):
    return f"""ret AS (SELECT signal, sel.security_id, entry, exit, CASE WHEN a.{price} > 0 THEN b.{price} / a.{price} - 1 END AS gross_return FROM sel JOIN iv ON signal = sel.date
  LEFT JOIN px a ON a.security_id = sel.security_id AND a.date = entry LEFT JOIN px b ON b.security_id = sel.security_id AND b.date = exit),
mb AS (SELECT signal, entry, exit, CASE WHEN count(gross_return) = count(*) THEN avg(gross_return) END AS gross_return, CASE WHEN count(gross_return) = count(*) THEN avg(((1 + gross_return) * 0.9975::DOUBLE / 1.0025::DOUBLE > 1)::INT) END AS hit_rate, count(*) AS selected, count(*) FILTER (gross_return IS NULL) AS missing FROM ret GROUP BY 1, 2, 3)"""


_BENCH = """pr AS (SELECT k.date AS signal, k.security_id, entry, exit, sel.security_id IS NOT NULL AS own, CASE WHEN a.close > 0 THEN b.close / a.close - 1 END AS r FROM k JOIN iv ON signal = k.date LEFT JOIN sel ON sel.date = k.date AND sel.security_id = k.security_id
  LEFT JOIN px a ON a.security_id = k.security_id AND a.date = entry LEFT JOIN px b ON b.security_id = k.security_id AND b.date = exit), md AS (SELECT *, median(r) OVER (PARTITION BY signal) AS m FROM pr),
bb AS (SELECT signal, entry, exit, count(*) FILTER (own) AS selected, count(*) AS pool, count(*) FILTER (own AND r IS NULL) AS missing, count(*) FILTER (r IS NULL) AS pool_missing, avg(r) FILTER (own) AS g, avg(r) AS b, avg(((1 + r) * 0.9975::DOUBLE / 1.0025::DOUBLE > 1)::INT) FILTER (own) AS h,
  avg(((1 + r) * 0.995::DOUBLE / 1.005::DOUBLE > 1)::INT) FILTER (own) AS s, avg((r > m)::INT) FILTER (own) AS mh FROM md GROUP BY 1, 2, 3),
bm AS (SELECT signal, entry, exit, selected, pool, missing, pool_missing, round(CASE WHEN missing = 0 AND selected > 0 THEN g END, 6) AS gross_return, round(CASE WHEN pool_missing = 0 THEN b END, 6) AS benchmark_return, round(CASE WHEN missing = 0 AND selected > 0 THEN h END, 6) AS hit_rate,
  round(CASE WHEN missing = 0 AND selected > 0 THEN s END, 6) AS stress_hit_rate, round(CASE WHEN missing = 0 AND selected > 0 AND pool_missing = 0 THEN mh END, 6) AS median_hit_rate FROM bb)"""
_SLOTS = "sl AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY security_id)::INT AS slot, (year(signal) * 4 + quarter(signal))::INT AS quarter FROM ret)"
_METRICS = f"""{_SLOTS}, mx AS (SELECT *, avg(gross_return) OVER (PARTITION BY signal) AS m FROM sl), mo AS (SELECT slot, quarter, signal, gross_return / (1 + abs(gross_return)) / 4 AS book, m / (1 + abs(m)) / 4 AS benchmark, security_id % 7 / 10.0::DOUBLE - 0.25 AS ic, security_id % 5 / 5.0::DOUBLE AS turnover FROM mx),
wl AS (SELECT *, book - benchmark AS excess, sum(ln(1 + book)) OVER w AS wb, sum(ln(1 + benchmark)) OVER w AS wc FROM mo WINDOW w AS (PARTITION BY slot, quarter ORDER BY signal)), wp AS (SELECT *, wb - max(wb) OVER w AS fb, wc - max(wc) OVER w AS fc FROM wl WINDOW w AS (PARTITION BY slot, quarter ORDER BY signal)),
me AS (SELECT slot, quarter, count(*) AS months, count(*) - count(book) AS missing_months, count(book) = count(*) AS good, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg((ic > 0)::INT) AS ic_positive, avg(excess) * 12 AS yearly_excess, avg(excess) / nullif(stddev_samp(excess), 0) * sqrt(12::DOUBLE) AS information_ratio,
  avg((excess > 0)::INT) AS monthly_win, avg(turnover) * 12 AS yearly_turnover, avg(book) * 12 AS yearly_return, avg(benchmark) * 12 AS yearly_benchmark, exp(min(fb)) - 1 AS drawdown, exp(min(fc)) - 1 AS benchmark_drawdown FROM wp GROUP BY slot, quarter)"""
_FIGURES = ("ic_mean", "icir", "ic_positive", "yearly_excess", "information_ratio", "monthly_win", "yearly_turnover", "yearly_return", "yearly_benchmark", "drawdown", "benchmark_drawdown")


def _checked():
    parts = [f"SELECT slot, quarter, '{m}' AS metric, round({m if m == 'months' else f'CASE WHEN good THEN {m} END'}, 6)::DOUBLE AS actual, {b}::DOUBLE AS b, {'true' if k == 'min' else 'false'} AS least FROM me" for m, (k, b) in _CHECKS.items()]
    return " UNION ALL ".join(parts)


ORACLES = {
    "benchmarked_book": f"WITH {_BOOK}, {_BENCH} SELECT * FROM bm",
    "book_metrics": f"WITH {_BOOK}, {_returns('close')}, {_METRICS} SELECT slot, quarter, CASE WHEN good THEN 'complete' ELSE 'missing_execution_prices' END AS status, months, missing_months, {', '.join(f'round(CASE WHEN good THEN {m} END, 6) AS {m}' for m in _FIGURES)} FROM me",
    "metric_checks": f"WITH {_BOOK}, {_returns('close')}, {_METRICS}, c AS ({_checked()}) SELECT slot, quarter, metric, actual, coalesce(CASE WHEN least THEN actual >= b ELSE actual <= b END, false) AS passed FROM c",
    "constraint_audit": """WITH l AS (SELECT o_custkey AS book, substr(o_orderpriority, 1, 1)::BIGINT AS security_id, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY 1, 2), w AS (SELECT book, security_id, v::DOUBLE / (sum(v) OVER (PARTITION BY book))::DOUBLE * CASE WHEN book % 3 = 0 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END AS x FROM l),
      s AS (SELECT book, sum(x) AS total, CASE WHEN count(*) FILTER (security_id = 5) = 0 THEN sqrt(sum(security_id / 10.0 * x * x) + 0.04::DOUBLE * pow(sum((0.5 + security_id / 4.0) * x), 2)) END AS vol FROM w GROUP BY 1)
      SELECT book, 'single_position' AS constraint, security_id, round(x, 6) AS actual, 0.35::DOUBLE AS bound FROM w WHERE x > 0.3500001::DOUBLE UNION ALL SELECT book, 'total_equity', NULL, round(total, 6), 1.0 FROM s WHERE total > 1.0000001::DOUBLE
      UNION ALL SELECT book, 'annual_volatility', NULL, round(vol, 6), 0.4 FROM s WHERE vol IS NULL OR vol > 0.4000001::DOUBLE""",
    "signal_sheet": f"""WITH {_BOOK}, z AS (SELECT date, security_id, CASE WHEN stddev_samp(score) OVER d > 0 THEN (score - avg(score) OVER d) / stddev_samp(score) OVER d ELSE 0 END AS score FROM scored JOIN ends USING (date) WHERE score IS NOT NULL WINDOW d AS (PARTITION BY date)),
      p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, security_id)::INT AS place FROM z) SELECT date, security_id, round(score, 6) AS score, place, place <= {_NAMES} AS selected, round(CASE WHEN place <= {_NAMES} THEN 1.0::DOUBLE / {_NAMES} ELSE 0 END, 6) AS weight FROM p""",
    "cohort_book": f"WITH {_FACTORS} SELECT date, security_id, round(1::DOUBLE / count(*) OVER (PARTITION BY date), 8) AS weight FROM f WHERE status = 'ok'",
    "interval_returns": f"WITH {_BOOK}, {_returns('close')} SELECT signal, security_id, entry, exit, round(gross_return, 6) AS gross_return FROM ret",
    "monthly_book": f"WITH {_BOOK}, {_returns('close')} SELECT signal, entry, exit, round(gross_return, 6) AS gross_return, round(hit_rate, 6) AS hit_rate, selected, missing FROM mb",
    "book_summary": f"""WITH {_BOOK}, {_returns("known")}, w AS (SELECT *, sum(ln(0.05 + 0.95 * (1 + gross_return) * 0.9975 / 1.0025::DOUBLE)) OVER (ORDER BY signal) AS l FROM mb WHERE missing = 0),
      pk AS (SELECT *, greatest(0, max(l) OVER (ORDER BY signal)) AS peak FROM w)
      SELECT 'complete' AS status, count(*) AS months, 0::BIGINT AS missing, round(arg_max(l, signal), 6) AS log_growth, round(arg_max(l, signal) / ((max(exit) - min(entry)) / 365.25::DOUBLE), 6) AS yearly_log_growth, round(min(exp(l - peak) - 1), 6) AS max_drawdown, round(avg(hit_rate), 6) AS hit_rate FROM pk""",
    "quarterly_book_summary": f"""WITH {_BOOK}, {_returns("close")}, {_SLOTS}, w AS (SELECT *, sum(ln(0.05 + 0.95 * (1 + gross_return) * 0.9975 / 1.0025::DOUBLE)) OVER (PARTITION BY slot, quarter ORDER BY signal) AS l FROM sl),
      pk AS (SELECT *, greatest(0, max(l) OVER (PARTITION BY slot, quarter ORDER BY signal)) AS peak FROM w), g AS (SELECT slot, quarter, count(*) AS months, count(*) FILTER (gross_return IS NULL) AS missing, arg_max(l, signal) AS total, (max(exit) - min(entry)) / 365.25::DOUBLE AS years, min(exp(l - peak) - 1) AS fall, avg(((1 + gross_return) * 0.9975::DOUBLE / 1.0025::DOUBLE > 1)::INT) AS hit FROM pk GROUP BY 1, 2)
      SELECT slot, quarter, CASE WHEN missing > 0 THEN 'incomplete_selected_returns' ELSE 'complete' END AS status, months, missing, round(CASE WHEN missing = 0 THEN total END, 6) AS log_growth, round(CASE WHEN missing = 0 THEN total / years END, 6) AS yearly_log_growth,
        round(CASE WHEN missing = 0 THEN fall END, 6) AS max_drawdown, round(CASE WHEN missing = 0 THEN hit END, 6) AS hit_rate FROM g""",
    "book_turnover": f"""WITH {_BOOK}, dd AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM sel))
      SELECT s.date, round(CASE WHEN max(before) IS NOT NULL THEN 1 - count(w.security_id) / count(*)::DOUBLE END, 8) AS turnover FROM sel s JOIN dd USING (date) LEFT JOIN sel w ON w.date = before AND w.security_id = s.security_id GROUP BY 1""",
    "trading_capacity": f"""WITH {_BOOK}, a AS (SELECT f.security_id, f.date, adv20_amount, lead(f.date) OVER w AS trade_date, lead(f.amount) OVER w AS day_amount FROM f WINDOW w AS (PARTITION BY f.security_id ORDER BY f.pos))
      SELECT date, security_id, trade_date, round(CASE WHEN adv20_amount IS NOT NULL AND day_amount IS NOT NULL THEN 0.05::DOUBLE * least(adv20_amount, day_amount) END, 4) AS capacity FROM sel JOIN a USING (security_id, date)""",
    "order_ledger": """WITH t AS (SELECT l_suppkey AS account, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS tie, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS quantity, max(floor(l_extendedprice / l_quantity))::BIGINT AS price FROM lineitem GROUP BY 1, 2, 3)
      SELECT *, round(-sum(quantity * price) OVER w, 2) AS cash, round(sum(quantity) OVER w, 2) AS held FROM t WINDOW w AS (PARTITION BY account ORDER BY ts, tie)""",
}
