"""Queries of point-in-time history: features at each row's own cutoff, cash actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import history as hi
from panelworks.plans.panel import _PANEL, _days, _rounded
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_CUTOFF = "2000-06-30"
_KEY = "o_orderkey"


def _versions(spark, d):
    """Announcements: an event a supplier and quarter, a version an order; some without ex-date, off the calendar, unfinished or in another currency."""
    key = F.col(_KEY)
    line = src.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias(_KEY), F.col("l_suppkey").alias("security_id"))
    orders = src.table(spark, d, "orders").join(line, _KEY)
    ex = F.date_add(F.to_date(F.date_trunc("week", F.date_add(F.trunc("o_orderdate", "quarter"), 40))), (7 * (key % 3) + F.when(key % 47 == 0, 1).otherwise(0)).cast("int"))
    return orders.select(
        "security_id", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("event_id"), key.alias("version"),
        (F.col("o_orderdate") + F.make_interval(days=(key % 60).cast("int"), hours=(key % 24).cast("int"))).alias("published_at"), F.when(key % 211 != 0, ex).alias("ex_date"),
        F.when(key % 53 == 0, None).when(key % 59 == 0, -1).otherwise(key % 60).cast("decimal(12,4)").alias("cash"), F.when(key % 31 == 0, "B").otherwise("A").alias("currency"), (key % 37 != 0).alias("final"),
        (key % 41 != 0).alias("verified"), (key % 43 == 0).alias("source_conflict"), (key % 29 != 0).alias("payable"), F.when(key % 23 != 0, "specified").otherwise("about").alias("payment_kind"),
        F.date_add(ex, (key % 40 - 2).cast("int")).alias("payment_date"), (key % 7 == 0).alias("scrip"), F.when(key % 14 == 0, "Cash").otherwise("Units").alias("scrip_default"),
    )


def _panel(spark, d):
    return materialised(spark, d, "panel", lambda: src.panel(spark, d))


def history_asof(spark, d):
    return _rounded(hi.history_asof(_panel(spark, d), _versions(spark, d), _days(spark, d), _CUTOFF, "A"), 6)


def information_spans(spark, d):
    found = hi.information_spans(_versions(spark, d), _days(spark, d), "A")
    return found.select("security_id", "event_id", "ex_date", F.col("cash").cast("double").alias("cash"), "reason", "start", "stop")


def cash_actions(spark, d):
    found = hi.cash_actions(_versions(spark, d), f"{_CUTOFF} 19:00:00")
    return found.withColumn("cash", F.col("cash").cast("double"))


QUERIES = {f.__name__: f for f in (history_asof, information_spans, cash_actions)}

_VERSIONS = """ev AS (SELECT l_suppkey AS security_id, year(o_orderdate) * 4 + quarter(o_orderdate) AS event_id, o_orderkey AS version, o_orderdate + to_days((o_orderkey % 60)::INT) + to_hours(o_orderkey % 24) AS published_at,
    CASE WHEN o_orderkey % 211 <> 0 THEN e END AS ex_date, CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN -1 ELSE o_orderkey % 60 END::DOUBLE AS cash, CASE WHEN o_orderkey % 31 = 0 THEN 'B' ELSE 'A' END AS currency,
    o_orderkey % 37 <> 0 AS final, o_orderkey % 41 <> 0 AS verified, o_orderkey % 43 = 0 AS source_conflict, o_orderkey % 29 <> 0 AS payable, o_orderkey % 23 <> 0 AS exact, e + (o_orderkey % 40 - 2)::INT AS payment_date,
    o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0 AS units
  FROM (SELECT *, date_trunc('week', date_trunc('quarter', o_orderdate)::DATE + 40)::DATE + (7 * (o_orderkey % 3) + CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END)::INT AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1))"""
_SEEN = f"""{_VERSIONS}, av AS (SELECT *, published_at::DATE + CASE WHEN published_at::TIME > TIME '19:00:00' THEN 1 ELSE 0 END AS available FROM ev),
vis AS (SELECT *, (SELECT min(pos) FROM days WHERE date >= available)::INT AS visible, (SELECT min(pos) FROM days WHERE date >= ex_date)::INT AS x, EXISTS (SELECT 1 FROM days WHERE date = ex_date) AS on_session FROM av)"""
_REASON = """CASE WHEN ex_date IS NULL THEN 'unknown_ex_date' WHEN NOT final THEN 'cash_amount_not_final' WHEN currency <> 'A' THEN 'cash_currency_mismatch' WHEN cash IS NULL OR cash < 0 THEN 'invalid_cash_amount'
  WHEN NOT on_session OR x = 0 THEN 'missing_prior_calendar_session' END"""
_WINDOWS = sorted({*hi.MOMENTA, *hi.VOLATILITIES, *hi.HORIZONS})
_W = "WINDOW w AS (PARTITION BY security_id ORDER BY pos)"
# a rebuild at each row's own cutoff: the versions visible then, summed by ex-session
ORACLES = {
    "information_spans": f"""WITH {_PANEL}, {_SEEN}, s AS (SELECT *, lead(visible) OVER (PARTITION BY security_id, event_id ORDER BY published_at, version) AS stop FROM vis WHERE visible IS NOT NULL)
      SELECT security_id, event_id::INT AS event_id, ex_date, cash, {_REASON} AS reason, greatest(visible, coalesce(x, visible))::INT AS start, stop FROM s
      WHERE (ex_date IS NULL OR x IS NOT NULL) AND (stop IS NULL OR greatest(visible, coalesce(x, visible)) < stop)""",
    "cash_actions": f"""WITH {_VERSIONS}, l AS (SELECT * FROM ev WHERE published_at <= TIMESTAMP '{_CUTOFF} 19:00:00' QUALIFY row_number() OVER (PARTITION BY security_id, event_id ORDER BY published_at DESC, version DESC) = 1),
      b AS (SELECT l.security_id, l.event_id, arg_max(struct_pack(d := ev.ex_date), row(ev.published_at, ev.version)).d AS early FROM ev JOIN l USING (security_id, event_id) WHERE ev.published_at < l.ex_date GROUP BY 1, 2),
      r AS (SELECT l.*, CASE WHEN ex_date IS NULL OR payment_date < ex_date THEN 'invalid_entitlement_or_payment_date' WHEN NOT verified OR source_conflict THEN 'unresolved_source_evidence' WHEN NOT final OR NOT payable THEN 'cash_schedule_not_final'
        WHEN NOT exact THEN 'payment_date_not_exact' WHEN units THEN 'cash_election_not_established' WHEN early IS DISTINCT FROM ex_date THEN 'ex_date_not_known_before_entitlement' WHEN cash IS NULL OR cash < 0 THEN 'invalid_cash_amount' END AS reason FROM l LEFT JOIN b USING (security_id, event_id))
      SELECT security_id, event_id::INT AS event_id, reason, ex_date, payment_date, published_at, CASE WHEN reason IS NULL THEN cash END AS cash, currency FROM r""",
    "history_asof": f"""WITH {_PANEL}, {_SEEN}, cut AS MATERIALIZED (SELECT security_id, date, pos::INT AS pos, close, CASE WHEN lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r FROM panel WHERE date <= DATE '{_CUTOFF}' {_W}),
      now AS MATERIALIZED (SELECT c.security_id, c.pos, arg_max(struct_pack(x := v.x, cash := v.cash, reason := {_REASON.replace("ex_date", "v.ex_date").replace("final", "v.final", 1)}, ex := v.ex_date), row(v.published_at, v.version)) AS e
        FROM cut c JOIN vis v ON v.security_id = c.security_id AND v.visible <= c.pos GROUP BY c.security_id, c.pos, v.event_id),
      acts AS MATERIALIZED (SELECT n.security_id, n.pos, coalesce(n.e.x, -1) AS x, sum(CASE WHEN n.e.reason IS NULL THEN n.e.cash ELSE 0 END) AS cash, count(n.e.reason) AS bad FROM now n WHERE n.e.ex IS NULL OR n.e.x <= n.pos GROUP BY 1, 2, 3),
      g AS MATERIALIZED (SELECT a.security_id, a.pos, a.x, CASE WHEN bad = 0 AND p.close > a.cash THEN ln((p.close - a.cash) / p.close) END AS g, c.r FROM acts a LEFT JOIN cut p ON p.security_id = a.security_id AND p.pos = a.x - 1 LEFT JOIN cut c ON c.security_id = a.security_id AND c.pos = a.x),
      fix AS MATERIALIZED (SELECT security_id, pos, {", ".join(f"coalesce(sum(g) FILTER (x > pos - {n}), 0) AS g_{n}, count(*) FILTER (g IS NULL AND (x < 0 OR x > pos - {n})) AS open_{n}" for n in _WINDOWS)},
        {", ".join(f"coalesce(sum(g) FILTER (x > pos - {n} AND r IS NOT NULL), 0) AS s_{n}, coalesce(sum((r - g) * (r - g) - r * r) FILTER (x > pos - {n}), 0) AS q_{n}" for n in hi.VOLATILITIES)} FROM g GROUP BY 1, 2),
      base AS (SELECT c.security_id, c.date, c.pos, close, count(close) OVER w AS quotes, {", ".join(f"coalesce(g_{n}, 0) AS g_{n}, coalesce(open_{n}, 0) AS open_{n}, lag(close, {n}) OVER w AS old_{n}" for n in _WINDOWS)},
        {", ".join(f"count(r) OVER v{n} AS k_{n}, coalesce(sum(r) OVER v{n}, 0) - coalesce(s_{n}, 0) AS t_{n}, coalesce(sum(r * r) OVER v{n}, 0) + coalesce(q_{n}, 0) AS u_{n}" for n in hi.VOLATILITIES)}
        FROM cut c LEFT JOIN fix f ON f.security_id = c.security_id AND f.pos = c.pos WINDOW w AS (PARTITION BY c.security_id ORDER BY c.pos), {", ".join(f"v{n} AS (PARTITION BY c.security_id ORDER BY c.pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in hi.VOLATILITIES)}),
      m AS (SELECT *, {", ".join(f"CASE WHEN open_{n} = 0 AND old_{n} > 0 THEN close / (old_{n} * exp(g_{n})) - 1 END AS momentum_{n}" for n in sorted({*hi.MOMENTA, *hi.HORIZONS}))} FROM base),
      o AS (SELECT *, {", ".join(f"lead(momentum_{h}, {h}) OVER w AS fwd_return_{h}" for h in hi.HORIZONS)} FROM m {_W})
      SELECT security_id, o.date, CASE WHEN open_252 > 0 THEN 'adjustment_unresolved' WHEN close IS NULL THEN 'data_issue' WHEN quotes < 60 THEN 'insufficient_history' ELSE 'ok' END AS status,
      {", ".join(f"round(momentum_{n}, 6) AS momentum_{n}" for n in hi.MOMENTA)},
      {", ".join(f"round(CASE WHEN open_{n} = 0 AND k_{n} >= {max(12, n // 2)} THEN sqrt(greatest(u_{n} - t_{n} * t_{n} / k_{n}, 0) / (k_{n} - 1)) * sqrt(252.0::DOUBLE) END, 6) AS volatility_{n}" for n in hi.VOLATILITIES)},
      {", ".join(f'''d{h}.date AS label_end_{h}, round(fwd_return_{h}, 6) AS fwd_return_{h}, CASE WHEN d{h}.date IS NULL THEN 'no_completed_horizon' WHEN d{h}.date > DATE '{_CUTOFF}' THEN 'not_mature'
        WHEN fwd_return_{h} IS NOT NULL THEN 'available_at_horizon_end' ELSE 'unresolved_price_adjustment_or_fx' END AS label_state_{h}''' for h in hi.HORIZONS)}
      FROM o {" ".join(f"LEFT JOIN days d{h} ON d{h}.pos = o.pos + {h}" for h in hi.HORIZONS)}""",
}
