"""Queries of label repairs. The stand-in tables are one text for both engines; what is done with them is not."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import repairs as rp
from panelworks.plans.panel import _PANEL, _days, _rounded
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_AS_OF, _FIRST, _LAST = "2001-06-30", "1995-06-01", "2001-01-31"
_PRICE = "coalesce(close, 1000 + security_id)"
_FX = "CASE WHEN security_id % 4 = 0 THEN 1.25 ELSE 1.0 END"
_BARS = {
    "security_id": "security_id", "date": "date", "pos": "CAST(pos AS INT)", "data_valid": "(security_id * 3 + pos) % 31 <> 0", "identity_valid": "(security_id + pos) % 29 <> 0",
    "issue": "CASE WHEN (security_id * 7 + pos) % 37 <> 0 THEN security_id * 10 END", "quoted": "close IS NOT NULL", "volume": "CAST(coalesce(volume, 0) AS DOUBLE)", "raw_close": f"CAST({_PRICE} AS DOUBLE)",
    "factor": "CAST(1 + security_id % 3 AS DOUBLE)", "adj_close": f"CAST({_PRICE} * (1 + security_id % 3) AS DOUBLE)", "fx": f"CAST(CASE WHEN (security_id + pos) % 61 = 0 THEN NULL ELSE {_FX} END AS DOUBLE)",
    "close": f"CAST({_PRICE} * (1 + security_id % 3) * ({_FX}) AS DOUBLE)", "currency": "CASE WHEN (security_id + pos) % 59 = 0 THEN NULL WHEN security_id % 4 = 0 THEN 'CNY' ELSE 'HKD' END",
}
_PROOF = {
    "security_id": "security_id", "date": "date", "issue": "security_id * 10", "identity_issue": "CASE WHEN (security_id + pos) % 23 = 0 THEN 0 ELSE security_id * 10 END", "code": "security_id", "listing": "security_id + 1",
    "currency": "CASE WHEN security_id % 4 = 0 THEN 'CNY' ELSE 'HKD' END", "identity_valid": "(security_id * 2 + pos) % 41 <> 0", "price_matches": "true", "data_valid": "true",
    "closing": f"CAST({_PRICE} + CASE WHEN (security_id + pos) % 43 = 0 THEN 1 ELSE 0 END AS DOUBLE)", "suspended": "0", "no_close": "0", "volume": "0", "amount": "0", "raw_close": f"CAST({_PRICE} AS DOUBLE)",
    "adj_close": f"CAST({_PRICE} * (1 + security_id % 3) AS DOUBLE)", "anchor_pos": "CAST(pos + CASE WHEN (security_id + pos) % 17 = 0 THEN 1 ELSE -1 END AS INT)", "source": "CASE WHEN (security_id + pos) % 53 = 0 THEN ' ' ELSE 'page' END",
}
_HAS_PROOF, _HAS_FEATURE = "(security_id * 5 + pos) % 11 <> 0", "(security_id + 3 * pos + horizon) % 67 <> 0"
_FEATURE = {
    "fwd_return": "CASE WHEN (security_id + 2 * pos + horizon) % 5 <> 0 THEN 0.5 END", "status": "CASE WHEN (security_id + pos) % 19 = 0 THEN 'data_issue' ELSE 'ok' END", "moved": "(security_id + pos + horizon) % 71 = 0",
    "noisy": "(security_id + pos) % 73 = 0",
}
_REQUESTED, _OFF = "(security_id + pos + horizon) % 3 <> 0", "(security_id + pos) % 79 = 0"


def _panel(spark, d):
    return materialised(spark, d, "panel", lambda: src.panel(spark, d))


def _cols(spec):
    return [f"{e} AS {n}" for n, e in spec.items()]


def _tables(spark, d):
    """(bars, evidence, features, requests): the facts of a repair, by the rules above."""
    panel, days = _panel(spark, d), _days(spark, d)
    bars = panel.selectExpr(*_cols(_BARS))
    dates = F.broadcast(days.select(F.col("pos").alias("anchor_pos"), F.col("date").alias("anchor")))  # a row a session, as ends
    proof = panel.where(_HAS_PROOF).selectExpr(*_cols(_PROOF)).join(dates, "anchor_pos", "left").drop("anchor_pos")
    each = panel.select("*", F.explode(F.array(*map(F.lit, rp.HORIZONS))).alias("horizon"))
    ends = F.broadcast(days.select(F.col("pos").alias("end_pos"), F.col("date").alias("label_end")))
    each = each.selectExpr("security_id", "date", "pos", "horizon", *_cols(_FEATURE), f"{_BARS['close']} AS close", f"{_BARS['raw_close']} AS raw_close", f"CAST({_FX} AS DOUBLE) AS fx", f"{_REQUESTED} AS asked", f"{_OFF} AS off", f"{_HAS_FEATURE} AS there")
    each = each.withColumn("end_pos", F.col("pos") + F.col("horizon")).join(ends, "end_pos", "left")
    features = each.where("there").selectExpr("date", "security_id", "horizon", "fwd_return", "CASE WHEN moved THEN date_add(label_end, 7) ELSE label_end END AS label_end", "status", "CASE WHEN noisy THEN close + 1 ELSE close END AS close", "raw_close", "fx")
    requests = each.where("asked").selectExpr("date", "security_id", "horizon", "CASE WHEN off THEN date_add(label_end, 7) ELSE label_end END AS label_end")
    return bars, proof, features, requests


def endpoint_patches(spark, d):
    bars, proof, features, requests = _tables(spark, d)
    master = src.table(spark, d, "supplier").selectExpr("s_suppkey AS security_id", "s_suppkey * 10 AS issue", "CASE WHEN s_suppkey % 4 = 0 THEN 'CNY' ELSE 'HKD' END AS currency", "s_suppkey AS code").where("security_id % 13 <> 0")
    rates = _days(spark, d).where("pos % 6 <> 0").select("date", F.lit("CNY").alias("currency"), F.lit(1.25).alias("rate"), F.col("date").alias("observed"), F.lit("page").alias("source"))
    seen = bars.where("(security_id + 7 * pos) % 83 <> 0")  # some bars are missing
    found = rp.endpoint_patches(requests, features, seen, proof, master, _days(spark, d), rates, _AS_OF, _LAST)
    return _rounded(found, 6)


def _transfers(spark, d):
    """An event for every second supplier: it goes over to the next one."""
    key = F.col("s_suppkey")
    day = lambda n: F.date_add(F.lit("1997-01-06").cast("date"), n)
    start = (key * 35 % 700).cast("int")
    one = src.table(spark, d, "supplier").where("s_suppkey % 2 = 1").select(
        (key * 100).alias("event_id"), key.alias("old_id"), (key + 1).alias("new_id"), day(F.lit(-500)).alias("old_start"), day(start).alias("old_end"), day(start).alias("new_start"), F.when(key % 3 == 0, day(start + 420)).alias("new_end"),
        day(start - 7).alias("anchor"), (day(start).cast("timestamp") + F.make_interval(days=F.when(key % 5 == 0, 40).otherwise(-30), hours=F.lit(8))).alias("published_at"), F.lit(1.0).alias("shares"),
    )
    return one.unionByName(one.where("old_id % 14 = 1").withColumn("event_id", F.col("event_id") + 1))


def transfer_patches(spark, d):
    bars, _, features, requests = _tables(spark, d)
    equal = bars.withColumns({"raw_close": F.when(F.col("security_id") % 22 != 1, F.lit(500.0) + F.col("pos")).otherwise(F.col("raw_close")), "fx": F.lit(1.0), "quoted": F.lit(True)})
    long = features.join(equal.select("security_id", "date", (F.col("raw_close") * F.col("factor")).alias("own")), ["security_id", "date"]).withColumn("close", F.when(F.col("status") == "ok", F.col("own")).otherwise(F.col("close"))).drop("own")
    found = rp.transfer_patches(requests, _transfers(spark, d), long, equal, _FIRST, _LAST)
    return _rounded(found, 6)


def _ends(spark, d):
    key = F.col("s_suppkey")
    last = F.date_add(F.lit("1998-01-05").cast("date"), (key * 7 % 700).cast("int"))
    one = src.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(
        (key * 10).alias("event_id"), key.alias("security_id"), F.date_add(last, -600).alias("start"), last.alias("last_trade"), F.date_add(last, 14).alias("effective"), F.when(key % 21 == 0, -5000.0).otherwise((key % 90) * 10.0).alias("cash")
    )
    return one.unionByName(one.where("security_id % 33 = 0").withColumn("event_id", F.col("event_id") + 1))


def terminal_patches(spark, d):
    bars, _, features, requests = _tables(spark, d)
    home = bars.where("(security_id + 7 * pos) % 83 <> 0").withColumn("fx", F.lit(1.0))
    long = features.withColumn("close", F.when(F.col("security_id") % 4 == 0, F.col("close") / 1.25).otherwise(F.col("close")))
    return _rounded(rp.terminal_patches(requests, _ends(spark, d), long, home, _LAST), 6)


def adjusted_terms(spark, d):
    bars = _tables(spark, d)[0]
    factors = bars.where("(security_id + pos) % 7 <> 0").select("security_id", "date", (F.col("factor") * (1 + F.col("pos") % 5)).alias("factor"))
    factors = factors.unionByName(factors.where("(security_id + pos) % 9 = 0"))
    moves = _transfers(spark, d).select("event_id", F.lit("transfer").alias("kind"), F.col("old_id").alias("security_id"), F.col("new_id").alias("successor_id"), F.col("new_start").alias("effective"), F.col("anchor").alias("old_factor_date"), F.when(F.col("old_id") % 10 == 3, F.col("anchor")).otherwise(F.col("new_start")).alias("new_factor_date"), F.lit(2.0).alias("shares"))
    ends = _ends(spark, d).select("event_id", F.lit("terminal").alias("kind"), "security_id", "effective", F.col("last_trade").alias("old_factor_date"), "cash")
    return _rounded(rp.adjusted_terms(moves.unionByName(ends, allowMissingColumns=True), factors), 6)


QUERIES = {f.__name__: f for f in (endpoint_patches, transfer_patches, terminal_patches, adjusted_terms)}


def _sql(spec):
    return ", ".join(_cols(spec))


_T = f"""{_PANEL}, bar AS MATERIALIZED (SELECT {_sql(_BARS)} FROM panel),
pf AS MATERIALIZED (SELECT p.*, d.date AS anchor FROM (SELECT {_sql(_PROOF)} FROM panel WHERE {_HAS_PROOF}) p LEFT JOIN days d ON d.pos = anchor_pos),
ea AS (SELECT p.*, d.date AS label_end FROM (SELECT security_id, date, pos, horizon, {_sql(_FEATURE)}, {_BARS['close']} AS close, {_BARS['raw_close']} AS raw_close, CAST({_FX} AS DOUBLE) AS fx, {_REQUESTED} AS asked, {_OFF} AS off, {_HAS_FEATURE} AS there
  FROM panel, (VALUES (1), (5), (20), (60)) h(horizon)) p LEFT JOIN days d ON d.pos = p.pos + horizon),
ft AS MATERIALIZED (SELECT date, security_id, horizon, fwd_return, CASE WHEN moved THEN label_end + 7 ELSE label_end END AS label_end, status, CASE WHEN noisy THEN close + 1 ELSE close END AS close, raw_close, fx FROM ea WHERE there),
rq AS MATERIALIZED (SELECT date, security_id, horizon, CASE WHEN off THEN label_end + 7 ELSE label_end END AS label_end FROM ea WHERE asked),
tr AS (SELECT s_suppkey * 100 + n AS event_id, s_suppkey AS old_id, s_suppkey + 1 AS new_id, DATE '1997-01-06' - 500 AS old_start, b AS old_end, b AS new_start, CASE WHEN s_suppkey % 3 = 0 THEN b + 420 END AS new_end, b - 7 AS anchor,
  b::TIMESTAMP + CASE WHEN s_suppkey % 5 = 0 THEN INTERVAL 40 DAY ELSE -INTERVAL 30 DAY END + INTERVAL 8 HOUR AS published_at FROM (SELECT s_suppkey, DATE '1997-01-06' + (s_suppkey * 35 % 700)::INT AS b FROM supplier WHERE s_suppkey % 2 = 1), (VALUES (0), (1)) t(n) WHERE n = 0 OR s_suppkey % 14 = 1),
te AS (SELECT s_suppkey * 10 + n AS event_id, s_suppkey AS security_id, l - 600 AS start, l AS last_trade, l + 14 AS effective, CASE WHEN s_suppkey % 21 = 0 THEN -5000.0 ELSE (s_suppkey % 90) * 10.0 END::DOUBLE AS cash
  FROM (SELECT s_suppkey, DATE '1998-01-05' + (s_suppkey * 7 % 700)::INT AS l FROM supplier WHERE s_suppkey % 3 = 0), (VALUES (0), (1)) t(n) WHERE n = 0 OR s_suppkey % 33 = 0)"""


def _trade(p):
    return f"coalesce({p}.data_valid AND {p}.identity_valid AND {p}.issue = m.issue AND {p}.quoted AND {p}.volume > 0 AND {p}.raw_close > 0 AND {p}.currency = m.currency AND {p}.fx > 0 AND (m.currency <> 'HKD' OR {p}.fx = 1), false)"


ORACLES = {
    "endpoint_patches": f"""WITH {_T}, m AS (SELECT s_suppkey AS security_id, s_suppkey * 10 AS issue, CASE WHEN s_suppkey % 4 = 0 THEN 'CNY' ELSE 'HKD' END AS currency FROM supplier WHERE s_suppkey % 13 <> 0), seen AS MATERIALIZED (SELECT * FROM bar WHERE (security_id + 7 * pos) % 83 <> 0),
      k AS (SELECT q.*, CASE WHEN q.date > DATE '{_LAST}' OR q.label_end > DATE '{_LAST}' THEN 'outside_development_period' WHEN q.label_end IS NULL OR q.label_end > DATE '{_AS_OF}' THEN 'label_not_mature'
        WHEN dn.pos IS DISTINCT FROM dd.pos + q.horizon THEN 'calendar_horizon_mismatch' WHEN f.security_id IS NULL THEN 'feature_row_missing' WHEN f.fwd_return IS NOT NULL THEN 'existing_label_kept'
        WHEN f.label_end IS DISTINCT FROM q.label_end THEN 'feature_label_end_mismatch' WHEN e.security_id IS NULL THEN 'endpoint_bar_missing'
        WHEN p.security_id IS NULL OR m.security_id IS NULL OR p.identity_issue <> m.issue OR NOT p.identity_valid OR trim(p.source) = '' THEN 'endpoint_evidence_unverified' WHEN m.currency = 'CNY' AND dn.pos % 6 = 0 THEN 'endpoint_fx_unavailable'
        WHEN NOT e.data_valid OR e.raw_close::FLOAT <> p.closing::FLOAT OR e.issue <> m.issue OR e.currency <> m.currency OR e.fx <> CASE WHEN m.currency = 'HKD' THEN 1 ELSE 1.25 END THEN 'endpoint_price_or_data_unverified'
        WHEN s.security_id IS NULL OR f.status <> 'ok' OR f.close <> s.close OR f.fx IS DISTINCT FROM s.fx OR NOT {_trade("s")} THEN 'signal_price_or_identity_unverified'
        WHEN p.anchor IS NULL OR p.anchor >= q.label_end OR a.security_id IS NULL OR NOT {_trade("a")} THEN 'past_identity_anchor_unavailable' ELSE 'patch_created' END AS code, e.adj_close * CASE WHEN m.currency = 'HKD' THEN 1 ELSE 1.25 END / f.close - 1 AS v
        FROM rq q LEFT JOIN days dd ON dd.date = q.date LEFT JOIN days dn ON dn.date = q.label_end LEFT JOIN ft f ON f.security_id = q.security_id AND f.date = q.date AND f.horizon = q.horizon LEFT JOIN seen e ON e.security_id = q.security_id AND e.date = q.label_end
        LEFT JOIN pf p ON p.security_id = q.security_id AND p.date = q.label_end LEFT JOIN m ON m.security_id = q.security_id LEFT JOIN seen s ON s.security_id = q.security_id AND s.date = q.date LEFT JOIN seen a ON a.security_id = q.security_id AND a.date = p.anchor)
      SELECT date, security_id, horizon::INT AS horizon, label_end, code, round(CASE WHEN code = 'patch_created' THEN v END, 6) AS new_fwd_return FROM k""",
    "transfer_patches": f"""WITH {_T}, eq AS MATERIALIZED (SELECT security_id, date, data_valid, factor, CASE WHEN security_id % 22 <> 1 THEN 500.0 + pos ELSE raw_close END::DOUBLE AS raw_close FROM bar),
      k AS (SELECT q.*, t.event_id, t.new_id, oa.factor / na.factor AS bridge, e.raw_close * e.factor * oa.factor / na.factor / CASE WHEN f.status = 'ok' THEN s.raw_close * s.factor ELSE f.close END - 1 AS v,
        CASE WHEN t.old_id % 14 = 1 THEN 'event_not_unique' WHEN NOT coalesce(oa.data_valid AND na.data_valid AND oa.raw_close = na.raw_close AND t.anchor >= t.old_start, false) THEN 'anchor_not_equal'
        WHEN q.label_end IS NULL OR q.label_end > DATE '{_LAST}' OR q.date < DATE '{_FIRST}' THEN 'endpoint_outside_development' WHEN q.date < t.old_start OR q.date >= t.old_end THEN 'signal_outside_old_listing'
        WHEN q.label_end < t.new_start OR q.label_end >= t.new_end THEN 'endpoint_outside_new_listing' WHEN t.published_at > q.label_end::TIMESTAMP + INTERVAL 19 HOUR THEN 'event_not_public_by_label_cutoff'
        WHEN f.security_id IS NULL THEN 'source_feature_absent' WHEN f.fwd_return IS NOT NULL THEN 'existing_label_present' WHEN f.label_end IS DISTINCT FROM q.label_end THEN 'source_label_end_mismatch'
        WHEN NOT coalesce(s.data_valid AND e.data_valid, false) THEN 'invalid_signal_or_successor_observation' WHEN f.status <> 'ok' AND NOT abs(f.close - s.raw_close * s.factor) <= 1e-10 + 1e-7 * abs(s.raw_close * s.factor) THEN 'source_signal_adjustment_mismatch' ELSE 'patch_created' END AS code
        FROM rq q JOIN tr t ON t.old_id = q.security_id LEFT JOIN eq oa ON oa.security_id = t.old_id AND oa.date = t.anchor LEFT JOIN eq na ON na.security_id = t.new_id AND na.date = t.anchor LEFT JOIN ft f ON f.security_id = q.security_id AND f.date = q.date AND f.horizon = q.horizon
        LEFT JOIN eq s ON s.security_id = q.security_id AND s.date = q.date LEFT JOIN eq e ON e.security_id = t.new_id AND e.date = q.label_end)
      SELECT date, security_id, horizon::INT AS horizon, label_end, event_id, new_id, code, round(CASE WHEN code = 'patch_created' THEN bridge END, 6) AS bridge, round(CASE WHEN code = 'patch_created' THEN v END, 6) AS new_fwd_return FROM k""",
    "terminal_patches": f"""WITH {_T}, home AS MATERIALIZED (SELECT * FROM bar WHERE (security_id + 7 * pos) % 83 <> 0), g AS (SELECT *, CASE WHEN security_id % 4 = 0 THEN close / 1.25 ELSE close END AS c FROM ft),
      k AS (SELECT q.*, t.event_id, t.cash * l.factor / f.c - 1 AS v, CASE WHEN t.security_id % 33 = 0 THEN 'event_not_unique' WHEN l.factor IS NULL THEN 'terminal_factor_missing' WHEN q.label_end IS NULL OR q.label_end > DATE '{_LAST}' THEN 'outside_development_or_horizon'
        WHEN q.date < t.start OR q.date > t.last_trade OR q.label_end < t.effective THEN 'terminal_event_not_the_label_endpoint' WHEN f.security_id IS NULL THEN 'source_feature_absent' WHEN f.fwd_return IS NOT NULL THEN 'existing_label_present'
        WHEN f.label_end IS DISTINCT FROM q.label_end THEN 'source_label_end_mismatch' WHEN s.security_id IS NULL THEN 'source_signal_absent' WHEN NOT s.data_valid OR abs(f.c - s.raw_close * s.factor) > 1e-10 + 1e-7 * abs(s.raw_close * s.factor) THEN 'source_signal_adjustment_unverified'
        WHEN t.cash * l.factor / f.c - 1 < -1 THEN 'terminal_return_invalid' ELSE 'patch_created' END AS code FROM rq q JOIN te t ON t.security_id = q.security_id LEFT JOIN home l ON l.security_id = t.security_id AND l.date = t.last_trade
        LEFT JOIN g f ON f.security_id = q.security_id AND f.date = q.date AND f.horizon = q.horizon LEFT JOIN home s ON s.security_id = q.security_id AND s.date = q.date)
      SELECT date, security_id, horizon::INT AS horizon, label_end, event_id, code, round(CASE WHEN code = 'patch_created' THEN v END, 6) AS new_fwd_return FROM k""",
    "adjusted_terms": f"""WITH {_T}, one AS (SELECT security_id, date, factor * (1 + pos % 5) AS factor, (security_id + pos) % 9 = 0 AS twice FROM bar WHERE (security_id + pos) % 7 <> 0),
      v AS (SELECT event_id, 'transfer' AS kind, old_id AS security_id, new_id AS successor_id, new_start AS effective, anchor AS a, CASE WHEN old_id % 10 = 3 THEN anchor ELSE new_start END AS b, NULL::DOUBLE AS cash FROM tr
        UNION ALL SELECT event_id, 'terminal', security_id, NULL, effective, last_trade, NULL, cash FROM te),
      k AS (SELECT v.*, o.factor AS old, n.factor AS new, CASE WHEN kind = 'transfer' AND b <> effective THEN 'invalid_ratio_or_dates' WHEN kind = 'terminal' AND cash < 0 THEN 'invalid_cash_or_date' WHEN o.twice OR (kind = 'transfer' AND n.twice) THEN 'ambiguous_factor'
        WHEN o.factor IS NULL OR (kind = 'transfer' AND n.factor IS NULL) THEN 'missing_factor' END AS problem FROM v LEFT JOIN one o ON o.security_id = v.security_id AND o.date = v.a LEFT JOIN one n ON n.security_id = v.successor_id AND n.date = v.b)
      SELECT event_id, kind, security_id, successor_id, effective, problem, round(CASE WHEN problem IS NULL AND kind = 'transfer' THEN old * 2 / new END, 6) AS unit_multiplier, round(CASE WHEN problem IS NULL AND kind = 'terminal' THEN cash * old END, 6) AS adjusted_cash FROM k""",
}
