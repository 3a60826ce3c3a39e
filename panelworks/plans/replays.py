"""Queries of replays and closed positions, on the monthly selection and on order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import books as bk
from panelworks.operators import cross_section as xs
from panelworks.operators import replays as rp
from panelworks.operators import shaping as sh
from panelworks.plans.books import _BOOK, _NAMES
from panelworks.plans.panel import _core, _days, _rounded
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_LAST = "2001-12-03"  # exit of the last signal
_CASH = 1e6


def _replay(spark, d):
    """The first names of each month's sheet; security 1 stands in for the index; every seventh signal declares its own exit."""
    factors, days = _core(spark, d), _days(spark, d)
    ends = sh.month_ends(days)
    scores = xs.factor_score(xs.ranks(factors.join(F.broadcast(ends), "date"))).select("date", "security_id", "score")  # one row a month
    selected = bk.signal_sheet(scores, _NAMES).where("selected").select("date", "security_id", "place")
    at = days.select("date", "pos").join(ends, "date").join(days.select((F.col("pos") - 2).alias("pos"), F.col("date").alias("later")), "pos", "left")
    signals = at.select("date", F.when(F.col("pos") % 7 == 0, F.col("later")).alias("exit"))
    raw = materialised(spark, d, "panel", lambda: src.panel(spark, d))
    index = raw.where("security_id = 1").select("date", "close")
    return rp.replayed_periods(selected, rp.period_groups(signals, days, _LAST), factors.select("security_id", "date", "close"), raw.where("(security_id + pos) % 11 <> 0"), index)


def replay_months(spark, d):
    return _rounded(_replay(spark, d)[0], 6)


def replay_names(spark, d):
    return _rounded(_replay(spark, d)[1], 6)


def replay_gaps(spark, d):
    return _replay(spark, d)[2]


def _fills(spark, d):
    """Order lines as purchases; positions of four in five parts are sold whole in one or two fills after the last of them."""
    line = src.table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("position"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("value"))
    bought = line.withColumns({"side": F.lit("buy"), "fee": F.lit(5.0)})
    whole = line.groupBy("account", "position").agg(F.max("date").alias("date"), F.sum("units").alias("units"), F.round(F.sum("value"), 2).alias("value")).where("position % 5 <> 0")
    parts = F.when(F.col("position") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.lit(1.0)))
    sold = whole.select("account", "position", "units", "value", "date", F.posexplode(parts).alias("i", "part"))
    sold = sold.select("account", "position", F.date_add("date", F.col("i") * 7 + 10).alias("date"), (F.col("units") * F.col("part")).alias("units"), (F.col("value") * F.col("part") * (0.9 + F.col("position") % 4 / 10)).alias("value"), F.lit("sell").alias("side"), F.lit(7.5).alias("fee"))
    return bought.unionByName(sold)


def closed_positions(spark, d):
    return _rounded(rp.closed_positions(_fills(spark, d)).select("account", "position", "entry", "exit", "cost", "proceeds", "fees", "fills", "net_return", "won", "first_cohort"), 4)


def cohort_figures(spark, d):
    return _rounded(rp.cohort_figures(rp.closed_positions(_fills(spark, d)), _CASH), 4)


QUERIES = {f.__name__: f for f in (replay_months, replay_names, replay_gaps, closed_positions, cohort_figures)}

_REPLAY = f"""{_BOOK}, zs AS (SELECT date, security_id, CASE WHEN stddev_samp(score) OVER d > 0 THEN (score - avg(score) OVER d) / stddev_samp(score) OVER d ELSE 0 END AS z FROM scored JOIN ends USING (date) WHERE score IS NOT NULL WINDOW d AS (PARTITION BY date)),
se AS (SELECT date, security_id, row_number() OVER (PARTITION BY date ORDER BY round(z, 9) DESC, security_id)::INT AS place FROM zs QUALIFY place <= {_NAMES}),
sg AS (SELECT e.date AS signal, (SELECT min(x.date) FROM days x WHERE x.date > e.date) AS entry, CASE WHEN d.pos % 7 = 0 THEN (SELECT x.date FROM days x WHERE x.pos = d.pos + 2) END AS declared FROM ends e JOIN days d USING (date)),
pe AS (SELECT signal, entry, coalesce(declared, lead(entry) OVER (ORDER BY signal), DATE '{_LAST}') AS exit FROM sg WHERE entry IS NOT NULL), ix AS (SELECT date, close FROM panel WHERE security_id = 1 AND close > 0),
nm AS (SELECT signal, entry, exit, se.security_id, place, CASE WHEN a.close > 0 THEN a.close END AS entry_price, CASE WHEN b.close > 0 THEN b.close END AS exit_price, p.security_id IS NOT NULL AS observable FROM se JOIN pe ON signal = se.date LEFT JOIN px a ON a.security_id = se.security_id AND a.date = entry
  LEFT JOIN px b ON b.security_id = se.security_id AND b.date = exit LEFT JOIN panel p ON p.security_id = se.security_id AND p.date = signal AND p.close > 0 AND p.volume > 0 AND (p.security_id + p.pos) % 11 <> 0),
nr AS (SELECT *, exit_price / entry_price - 1 AS gross_return FROM nm), bm AS (SELECT signal, a.close AS a, b.close AS b, entry, exit FROM pe LEFT JOIN ix a ON a.date = entry LEFT JOIN ix b ON b.date = exit),
bf AS (SELECT signal, lag(signal) OVER (ORDER BY signal) AS before FROM pe), tn AS (SELECT se.date AS signal, avg((w.security_id IS NULL)::INT) AS turnover FROM se JOIN bf ON signal = se.date LEFT JOIN se w ON w.date = before AND w.security_id = se.security_id GROUP BY 1),
mr AS (SELECT signal, entry, exit, count(*) AS stocks, avg(gross_return) AS g, avg(CASE WHEN observable THEN gross_return ELSE 0 END) AS o FROM nr GROUP BY 1, 2, 3 HAVING count(gross_return) = count(*))"""
_FILLS = """li AS (SELECT l_suppkey AS account, l_partkey AS position, l_shipdate::DATE AS date, l_quantity AS units, l_extendedprice AS value FROM lineitem WHERE l_quantity > 0),
po AS (SELECT account, position, min(date) AS entry, max(date) + CASE WHEN position % 2 = 0 THEN 17 ELSE 10 END AS exit, sum(value) + 5 * count(*) AS cost, round(sum(value), 2) * (0.9::DOUBLE + position % 4 / 10.0::DOUBLE) - 7.5::DOUBLE * (2 - position % 2) AS proceeds, 5 * count(*) + 7.5::DOUBLE * (2 - position % 2) AS fees, count(*) + 2 - position % 2 AS fills, min(min(date)) OVER (PARTITION BY account) AS f FROM li GROUP BY 1, 2),
cp AS (SELECT *, proceeds / cost - 1 AS r, entry = f AS first_cohort FROM po WHERE position % 5 <> 0)"""
ORACLES = {
    "replay_months": f"WITH {_REPLAY} SELECT signal, entry, exit, stocks, round(g, 6) AS gross_return, round(o, 6) AS observable_return, round(turnover, 6) AS turnover, round(b / a - 1, 6) AS benchmark_return, round(g - 0.003::DOUBLE * turnover, 6) AS net_return, round(o - 0.003::DOUBLE * turnover, 6) AS observable_net FROM mr JOIN tn USING (signal) JOIN bm USING (signal, entry, exit)",
    "replay_names": f"WITH {_REPLAY} SELECT signal, entry, exit, security_id, place, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(gross_return, 6) AS gross_return, observable FROM nr WHERE gross_return IS NOT NULL",
    "replay_gaps": f"WITH {_REPLAY} SELECT 'missing_endpoint' AS kind, security_id, entry AS date FROM nr WHERE entry_price IS NULL UNION ALL SELECT 'missing_endpoint', security_id, exit FROM nr WHERE exit_price IS NULL UNION ALL SELECT 'missing_benchmark_close', NULL, entry FROM bm WHERE a IS NULL UNION ALL SELECT 'missing_benchmark_close', NULL, exit FROM bm WHERE b IS NULL",
    "closed_positions": f"WITH {_FILLS} SELECT account, position, entry, exit, round(cost, 4) AS cost, round(proceeds, 4) AS proceeds, round(fees, 4) AS fees, fills::BIGINT AS fills, round(r, 4) AS net_return, r > 0 AS won, first_cohort FROM cp",
    "cohort_figures": f"""WITH {_FILLS}, s AS (SELECT account, min(entry) AS entry, max(exit) AS final_exit, count(*) AS positions, count(*) FILTER (r > 0) AS winners, sum(cost) AS c, sum(proceeds) AS p, sum(fees) AS f FROM cp WHERE first_cohort GROUP BY 1)
      SELECT account, entry, final_exit, positions, winners, round(c, 4) AS cost, round(p, 4) AS proceeds, round(f, 4) AS fees, round(p - c, 4) AS gain, round((p - c) / c, 4) AS return_on_cost, round((p - c) / {_CASH}, 4) AS share_of_cash, round({_CASH} + p - c, 4) AS cash_after FROM s""",
}
