"""Queries of order rules by venue and of days made from minutes; the stand-in rows are one text for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import actions as ac
from panelworks.operators import pointintime as pit
from panelworks.plans.panel import _rounded
from panelworks.sources import tables as src

# stamp and transfer rates by period, the last column for Beijing
_PERIODS = [("1995-08-01", "1998-04-29", 0.001, 0.00002, 0.000025), ("1998-04-29", "1999-08-28", 0.001, 0.00001, 0.00001), ("1999-08-28", None, 0.0005, 0.00001, 0.00001)]
_NAMES = ("valid_from", "valid_to", "stamp_rate", "transfer_rate", "beijing_rate")
_CODE = "CASE WHEN l_suppkey % 3 = 0 THEN '688' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') || '.SH' WHEN l_suppkey % 3 = 1 THEN '83' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || '.BJ' ELSE '60' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || '.SH' END"
_ORDER = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "code": _CODE, "date": "CAST(l_shipdate AS DATE)", "side": "CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END", "notional": "CASE WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE l_extendedprice END", "price": "l_extendedprice / (l_quantity * 100)", "holding": "CAST(l_partkey % 700 AS BIGINT)", "wanted": "l_quantity * 13"}
_MINUTE = {
    "code": "user_id", "ts": "CASE WHEN event_id % 23 = 0 THEN date_trunc('hour', ts) ELSE ts END", "tie": "event_id", "open": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END", "high": "value + 1", "low": "CASE WHEN event_id % 37 = 0 THEN 0 - value ELSE value - 0.5 END", "close": "value + 0.25",
    "volume": "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 0.5 WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 47 = 0 THEN -1.0 ELSE event_id % 90 * 1.0 END", "amount": "CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE event_id % 90 * (floor(value * 4) / 4) END",
}


def _made(rows, spec):
    return rows.selectExpr(*(f"{e.replace('VARCHAR', 'STRING')} AS {n}" for n, e in spec.items()))


def venue_orders(spark, d):
    """Fees and sizes of all order lines."""
    orders = _made(src.table(spark, d, "lineitem").where("l_quantity > 0"), _ORDER)
    schedule = spark.createDataFrame(_PERIODS, "valid_from string, valid_to string, stamp_rate double, transfer_rate double, beijing_rate double").withColumns({c: F.col(c).cast("date") for c in _NAMES[:2]})
    found = ac.venue_fees(orders, schedule).withColumns({"bought": ac.buy_quantity(F.col("notional"), F.col("price"), F.col("code")), "sold": ac.sell_quantity(F.col("wanted"), F.col("holding"), F.col("code")), "total": F.col("total").cast("double")})
    return _rounded(found.select("l_orderkey", "l_linenumber", "code", "side", "commission", "stamp_duty", "transfer_fee", "total", "bought", "sold"), 8)  # all figures have eight decimals or fewer


def daily_from_minutes(spark, d):
    minutes = _made(src.table(spark, d, "events"), _MINUTE).withColumns({c: F.col(c).cast("double") for c in ("volume", "amount", "low", "high", "close")})
    sessions = src.table(spark, d, "events").select(F.to_date("ts").alias("date")).where("dayofweek(date) NOT IN (1, 7)")
    return _rounded(pit.daily_from_minutes(minutes, sessions), 4)


QUERIES = {f.__name__: f for f in (venue_orders, daily_from_minutes)}


def _sql(spec):
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


_SCHEDULE = f"sch({', '.join(_NAMES)}) AS (VALUES " + ", ".join(f"(DATE '{a}', {f'DATE {b!r}' if b else 'NULL::DATE'}, {s}::DOUBLE, {t:.6f}::DOUBLE, {v:.6f}::DOUBLE)" for a, b, s, t, v in _PERIODS) + ")"
_LEAST, _STEP = "CASE WHEN code LIKE '688%' THEN 200 ELSE 100 END", "CASE WHEN code LIKE '688%' OR code LIKE '%.BJ' THEN 1 ELSE 100 END"
ORACLES = {
    "venue_orders": f"""WITH {_SCHEDULE}, o AS (SELECT {_sql(_ORDER)} FROM lineitem WHERE l_quantity > 0), m AS (SELECT o.*, CASE WHEN valid_from IS NULL THEN NULL WHEN notional = 0 THEN 0 ELSE greatest(5, notional * 0.0003::DOUBLE) END::DOUBLE AS c,
        CASE WHEN valid_from IS NULL THEN NULL WHEN side = 'sell' THEN notional * stamp_rate ELSE 0 END::DOUBLE AS s, notional * CASE WHEN code LIKE '%.BJ' THEN beijing_rate ELSE transfer_rate END AS t, floor(notional / price + 1e-10)::BIGINT AS b, least(floor(wanted)::BIGINT, holding) AS q
        FROM o LEFT JOIN sch ON date >= valid_from AND (valid_to IS NULL OR date < valid_to))
      SELECT l_orderkey, l_linenumber, code, side, round(c, 8) AS commission, round(s, 8) AS stamp_duty, round(t, 8) AS transfer_fee, round(c::DECIMAL(24,8) + s::DECIMAL(24,8) + t::DECIMAL(24,8), 2)::DOUBLE AS total,
        CASE WHEN notional > 0 AND b >= {_LEAST} THEN b - b % {_STEP} ELSE 0 END AS bought, CASE WHEN wanted <= 0 OR holding <= 0 THEN 0 WHEN q = holding THEN q WHEN q >= {_LEAST} THEN q - q % {_STEP} ELSE 0 END AS sold FROM m""",
    "daily_from_minutes": f"""WITH m AS (SELECT {_sql(_MINUTE)} FROM events), n AS (SELECT *, ts::DATE AS date, coalesce(volume > 0 AND amount > 0, false) AS traded, NOT coalesce((volume > 0 AND amount > 0) OR (volume = 0 AND amount = 0), false) AS unknown FROM m),
      g AS (SELECT code, date, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(DISTINCT ts) AS repeated_times, min(row(ts, tie)) FILTER (traded) AS ft, min(row(ts, tie)) FILTER (unknown) AS fu,
        (array_agg(open ORDER BY ts, tie) FILTER (traded))[1] AS open, arg_max(close, row(ts, tie)) AS close, max(high) FILTER (traded) AS h, min(low) FILTER (traded) AS l, count(*) FILTER (traded AND high <= 0) AS bh, count(*) FILTER (traded AND low <= 0) AS bl, count(*) FILTER (traded) AS traded_rows, count(*) FILTER (unknown) AS unknown_rows,
        count(*) FILTER (volume < 0 OR amount < 0) AS negative_rows, count(*) FILTER (volume % 1 <> 0) AS fractional_rows, CASE WHEN count(volume) = count(*) THEN sum(volume::DECIMAL(24,4)) END::DOUBLE AS v, CASE WHEN count(amount) = count(*) THEN sum(amount::DECIMAL(24,4)) END::DOUBLE AS amount,
        max(high) AS rh, min(low) AS rl, count(*) FILTER (open IS NULL OR volume IS NULL) AS incomplete_rows FROM n GROUP BY 1, 2)
      SELECT date, code, rows, first_ts, last_ts, repeated_times, round(open, 4) AS open, round(close, 4) AS close, round(CASE WHEN traded_rows > 0 AND unknown_rows = 0 AND bh = 0 THEN h END, 4) AS high, round(CASE WHEN traded_rows > 0 AND unknown_rows = 0 AND bl = 0 THEN l END, 4) AS low, traded_rows, unknown_rows, negative_rows, fractional_rows,
        CASE WHEN fractional_rows = 0 THEN v END AS volume, round(amount, 4) AS amount, incomplete_rows, coalesce(open > 0, false) AND NOT coalesce(fu < ft, false) AND negative_rows = 0 AND fractional_rows = 0 AND repeated_times = 0 AS open_valid,
        coalesce(v > 0 AND amount / v BETWEEN rl - 1e-8 AND rh + 1e-8, false) AS ratio_in_range, dayofweek(date) NOT IN (0, 6) AS on_session FROM g""",
}
