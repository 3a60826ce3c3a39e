"""Queries of corporate actions, fees and order rules, on inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions.windows import sessions
from panelworks.operators import actions as ac
from panelworks.plans.panel import _PANEL, _rounded
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_FEE_PERIODS = [("1992-01-01", "1996-08-28", 0.001, 0.00002), ("1996-08-28", "1999-04-29", 0.0005, 0.00002), ("1999-04-29", None, 0.0005, 0.00001)]


def _panel(spark, d):
    return materialised(spark, d, "panel", lambda: src.panel(spark, d))


def forward_adjusted(spark, d):
    panel = _panel(spark, d)
    actions = panel.where("pos % 37 = 0").select("security_id", "date", F.when(F.col("pos") % 74 == 0, 2.0).otherwise(1.0).alias("split"), F.lit(10.0).alias("cash"))
    found = ac.forward_adjusted(panel, actions).drop("close")
    return _rounded(found.withColumns({c: F.log(c) for c in ("adjustment", "split_factor", "adj_close", "split_adjusted_close")}), 6)


def back_adjusted(spark, d):
    panel = _panel(spark, d).where("quoted")
    factor = F.when((F.col("security_id") % 9 != 0) | (F.col("pos") % 74 != 0), (F.col("close") - 10) / F.col("close"))
    events = panel.where("pos % 37 = 0").select("security_id", F.col("date").alias("ex_date"), factor.alias("factor"))
    return _rounded(ac.back_adjusted(panel, events), 6)


def segment_momentum(spark, d):
    reported = F.lag("close").over(sessions()) * F.when(F.col("pos") % 61 == 0, 1.1).otherwise(1.0)
    rows = _panel(spark, d).withColumns({"pre_close": reported, "adj_factor": F.lit(1.0)})
    return _rounded(ac.segment_momentum(ac.segments(rows), 5), 6)


def validated_actions(spark, d):
    orders = src.table(spark, d, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(
        F.col("o_custkey").alias("security_id"), F.when(key % 23 != 0, F.trunc("o_orderdate", "month")).alias("ex_date"), F.date_add(F.to_date("o_orderdate"), (key % 40 - 40).cast("int")).alias("published_at"),
        F.when(key % 5 == 0, -1.0).when(key % 7 == 0, 0.0).when(key % 3 == 0, 0.25).alias("cash"), F.when(key % 11 == 0, 2.0).alias("split"),
    )
    return ac.validated(rows)


def factor_changes(spark, d):
    rows = _panel(spark, d).withColumn("adj_factor", F.when(F.col("quoted"), 1 + F.floor(F.col("pos") / 50) / 10))
    return _rounded(ac.factor_changes(rows), 8)


def order_fees(spark, d):
    schedule = spark.createDataFrame(_FEE_PERIODS, "valid_from string, valid_to string, stamp_rate double, transfer_rate double").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    orders = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), side.alias("side"), F.col("l_extendedprice").alias("notional"))
    found = ac.fees(orders, schedule)
    return found.groupBy("side", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("orders"), *(F.round(F.sum(c), 2).alias(c) for c in ("commission", "stamp_duty", "transfer_fee")))


def tradability(spark, d):
    before = F.lag("close").over(sessions())
    rows = _panel(spark, d).withColumns({"up_limit": F.round(before * 1.3, 4), "down_limit": F.round(before * 0.7, 4)})
    found = ac.tradability(rows, "buy")
    return found.select("security_id", "date", "reason", F.when(F.col("reason") == "ok", ac.lot_quantity(F.lit(1e6), F.col("open"))).otherwise(0).alias("quantity"))


QUERIES = {f.__name__: f for f in (forward_adjusted, back_adjusted, segment_momentum, validated_actions, factor_changes, order_fees, tradability)}

_W = "WINDOW w AS (PARTITION BY security_id ORDER BY pos)"
_SCHEDULE = "sch(valid_from, valid_to, stamp_rate, transfer_rate) AS (VALUES " + ", ".join(f"(DATE '{a}', {f'DATE {b!r}' if b else 'NULL::DATE'}, {s}::DOUBLE, {t:.6f}::DOUBLE)" for a, b, s, t in _FEE_PERIODS) + ")"
ORACLES = {
    "forward_adjusted": f"""WITH {_PANEL}, a AS (SELECT *, CASE WHEN pos % 74 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS s, lag(close) OVER w AS p FROM panel {_W}),
      st AS (SELECT *, CASE WHEN pos % 37 <> 0 THEN 0 WHEN p > 10 THEN ln(s * p / (p - 10)) END AS step FROM a),
      c AS (SELECT *, bool_or(step IS NULL) OVER w AS unresolved, sum(step) OVER w AS total, sum(ln(s)) OVER w - sum(ln(s)) OVER (PARTITION BY security_id) AS level FROM st {_W})
      SELECT security_id, date, pos::INT AS pos, unresolved, round(CASE WHEN NOT unresolved THEN total END, 6) AS adjustment, round(level, 6) AS split_factor,
      round(CASE WHEN NOT unresolved THEN ln(close) + total END, 6) AS adj_close, round(ln(close) + level, 6) AS split_adjusted_close FROM c""",
    "back_adjusted": f"""WITH {_PANEL}, q AS (SELECT security_id, date, close, pos, CASE WHEN pos % 37 <> 0 THEN 0 WHEN security_id % 9 = 0 AND pos % 74 = 0 THEN NULL ELSE ln((close - 10) / close) END AS step FROM panel WHERE quoted),
      l AS (SELECT *, coalesce(sum(step) OVER w, 0) AS later, coalesce(bool_or(step IS NULL) OVER w, false) AS poisoned FROM q WINDOW w AS (PARTITION BY security_id ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT security_id, date, round(close, 6) AS close, round(CASE WHEN NOT poisoned THEN close * exp(later) END, 6) AS back_close, poisoned FROM l""",
    "segment_momentum": f"""WITH {_PANEL}, b AS (SELECT *, pos % 61 = 0 AND lag(close) OVER w IS NOT NULL AS broken FROM panel {_W}), s AS (SELECT *, sum(broken::INT) OVER w AS segment FROM b {_W})
      SELECT security_id, date, segment::BIGINT AS segment, broken, round(close / lag(close, 5) OVER v - 1, 6) AS momentum, round(lead(close, 5) OVER v / close - 1, 6) AS forward,
      bool_or(broken) OVER (PARTITION BY security_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent_break FROM s WINDOW v AS (PARTITION BY security_id, segment ORDER BY pos)""",
    "validated_actions": """WITH r AS (SELECT o_custkey AS security_id, CASE WHEN o_orderkey % 23 <> 0 THEN date_trunc('month', o_orderdate)::DATE END AS ex_date, o_orderdate::DATE + (o_orderkey % 40 - 40)::INT AS published_at,
        CASE WHEN o_orderkey % 5 = 0 THEN -1.0 WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 3 = 0 THEN 0.25 END::DOUBLE AS cash, CASE WHEN o_orderkey % 11 = 0 THEN 2.0 END::DOUBLE AS split FROM orders),
      g AS (SELECT security_id, ex_date, min(published_at) AS published_at, count(*) AS versions, count(DISTINCT coalesce(cash, -99) * 1000 + coalesce(split, -9)) > 1 AS conflict,
        arg_min({'c': cash, 's': split}, coalesce(cash, -99) * 1000 + coalesce(split, -9)) AS low FROM r GROUP BY 1, 2), o AS (SELECT *, low.c AS cash, low.s AS split FROM g)
      SELECT security_id, ex_date, published_at, versions, cash, split, concat_ws(',', CASE WHEN ex_date IS NULL THEN 'missing_ex_date' END, CASE WHEN published_at >= ex_date THEN 'announced_after_ex_date' END, CASE WHEN cash < 0 THEN 'negative_cash' END,
        CASE WHEN cash IS NULL AND split IS NULL THEN 'missing_terms' END, CASE WHEN coalesce(cash, 0) = 0 AND coalesce(split, 1) = 1 THEN 'no_effect' END, CASE WHEN conflict THEN 'conflicting_versions' END) AS reasons, published_at + 1 AS visible_from FROM o""",
    "factor_changes": f"""WITH {_PANEL}, q AS (SELECT security_id, date, pos, 1 + (pos // 50) / 10.0::DOUBLE AS adj_factor FROM panel WHERE quoted), l AS (SELECT *, adj_factor / lag(adj_factor) OVER w AS ratio FROM q {_W})
      SELECT security_id, date, round(adj_factor, 8) AS adj_factor, round(ratio, 8) AS ratio FROM l WHERE abs(ratio - 1) > 1e-8""",
    "order_fees": f"""WITH {_SCHEDULE}, o AS (SELECT l_shipdate::DATE AS date, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice AS n FROM lineitem)
      SELECT side, year(date)::INT AS year, count(*) AS orders, round(sum(CASE WHEN n = 0 THEN 0 ELSE greatest(5, n * 0.0003::DOUBLE) END), 2) AS commission, round(sum(CASE WHEN side = 'sell' THEN n * stamp_rate ELSE 0 END), 2) AS stamp_duty, round(sum(n * transfer_rate), 2) AS transfer_fee
      FROM o LEFT JOIN sch ON date >= valid_from AND (valid_to IS NULL OR date < valid_to) GROUP BY 1, 2""",
    "tradability": f"""WITH {_PANEL}, b AS (SELECT *, round(lag(close) OVER w * 1.3::DOUBLE, 4) AS up, round(lag(close) OVER w * 0.7::DOUBLE, 4) AS down FROM panel {_W}),
      r AS (SELECT *, CASE WHEN NOT quoted THEN 'missing_quote' WHEN up IS NULL THEN 'missing_price_limit' WHEN open > up + 1e-8 OR open < down - 1e-8 THEN 'price_outside_limit_range' WHEN open >= up - 1e-8 THEN 'at_upper_limit' ELSE 'ok' END AS reason FROM b)
      SELECT security_id, date, reason, CASE WHEN reason = 'ok' THEN floor(1e6 / open + 1e-10)::BIGINT // 100 * 100 ELSE 0 END AS quantity FROM r""",
}
