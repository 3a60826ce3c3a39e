"""Queries of dated facts: information sets, lots, valuations, offers, listing periods, masked returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.operators import dated as dt
from panelworks.plans.panel import _PANEL, _rounded, _versions
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_KNOWN_FROM = "1994-01-01"


def _panel(spark, d):
    return materialised(spark, d, "panel", lambda: src.panel(spark, d))


def daily_versions(spark, d):
    versions = _versions(spark, d).select("security_id", F.year("period_end").alias("event_id"), F.to_date("published_at").alias("published_at"), "version", "value")
    days = src.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("date")).distinct()
    return dt.daily_versions(versions, days)


def lot_history(spark, d):
    along = Window.partitionBy("o_custkey").orderBy("effective")
    orders = src.table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("effective")).agg(F.min("o_orderkey").alias("key"))
    k = F.row_number().over(along)
    changes = orders.select(
        F.col("o_custkey").alias("security_id"), "effective", F.when(F.col("key") % 13 == 0, 50).otherwise(100 * (1 + (k - 1) % 4)).alias("old_lot"), (100 * (1 + k % 4)).alias("new_lot")
    )
    last = changes.groupBy("security_id").agg(F.max_by("new_lot", "effective").alias("lot"))
    return dt.lot_history(last.withColumn("lot", F.when(F.col("security_id") % 7 == 0, 1).otherwise(F.col("lot"))), changes)


def carried_valuation(spark, d):
    panel = _panel(spark, d)
    facts = panel.where("quoted AND (pos + security_id) % 13 = 0").select("security_id", "date", F.round("volume", 4).alias("valuation"))
    return _rounded(dt.carried_forward(panel.select("security_id", "date", "pos"), facts, "valuation"))


def offer_flags(spark, d):
    key = F.col("o_orderkey")
    offers = src.table(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.to_date("o_orderdate").alias("start"), F.when(key % 17 != 0, F.date_add(F.to_date("o_orderdate"), (key % 90).cast("int"))).alias("end"))
    return dt.offer_flags(_panel(spark, d).select("security_id", "date"), offers, _KNOWN_FROM)


def inside_listing(spark, d):
    periods = src.table(spark, d, "supplier").where("s_suppkey % 11 <> 0").select(
        F.col("s_suppkey").alias("security_id"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")).alias("list_date"),
        F.when(F.col("s_suppkey") % 3 == 0, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 500).cast("int"))).alias("delist_date"),
    )
    found = dt.inside_listing(src.weekly_bars(spark, d).select("security_id", "date"), periods)
    return found.groupBy("security_id", "place").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def masked_returns(spark, d):
    return _rounded(dt.masked_returns(_panel(spark, d).withColumn("allowed", F.col("quoted") & ((F.col("pos") + F.col("security_id")) % 19 != 0))), 6)


QUERIES = {f.__name__: f for f in (daily_versions, lot_history, carried_valuation, offer_flags, inside_listing, masked_returns)}

_W = "WINDOW w AS (PARTITION BY security_id ORDER BY pos)"
ORACLES = {
    "daily_versions": """WITH v AS (SELECT o_custkey AS security_id, year(o_orderdate)::INT AS event_id, (o_orderdate + to_days((o_orderkey % 90)::INT))::DATE AS published_at, o_orderkey AS version, o_totalprice AS value FROM orders),
      days AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS date FROM orders)
      SELECT date, security_id, event_id, published_at, version, value FROM days JOIN v ON published_at <= date
      QUALIFY row_number() OVER (PARTITION BY date, security_id, event_id ORDER BY published_at DESC, version DESC) = 1""",
    "lot_history": """WITH o AS (SELECT o_custkey AS security_id, o_orderdate::DATE AS effective, min(o_orderkey) AS key FROM orders GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY effective) AS k FROM o),
      c AS (SELECT security_id, effective, k, CASE WHEN key % 13 = 0 THEN 50 ELSE 100 * (1 + (k - 1) % 4) END AS old_lot, 100 * (1 + k % 4) AS new_lot FROM n),
      a AS (SELECT security_id, CASE WHEN security_id % 7 = 0 THEN 1 ELSE arg_max(new_lot, effective) END AS lot FROM c GROUP BY security_id),
      f AS (SELECT c.*, coalesce(lead(old_lot) OVER w, lot) AS following, lead(effective) OVER w AS valid_to FROM c JOIN a USING (security_id) WINDOW w AS (PARTITION BY security_id ORDER BY effective)),
      g AS (SELECT *, bool_and(new_lot = following) OVER (PARTITION BY security_id ORDER BY effective DESC) AS closed FROM f),
      s AS (SELECT security_id, effective AS valid_from, valid_to, new_lot AS lot, closed FROM g UNION ALL SELECT security_id, NULL, effective, old_lot, closed FROM g WHERE k = 1)
      SELECT security_id, valid_from, valid_to, CASE WHEN closed THEN lot END::INT AS lot, CASE WHEN closed THEN 'closed' ELSE 'open' END AS status FROM s""",
    "carried_valuation": f"""WITH {_PANEL}, p AS (SELECT security_id, date, pos, CASE WHEN quoted AND (pos + security_id) % 13 = 0 THEN round(volume, 4) END AS v FROM panel)
      SELECT security_id, date, pos::INT AS pos, last_value(v IGNORE NULLS) OVER w AS valuation, (pos - last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER w)::INT AS age FROM p {_W}""",
    "offer_flags": f"""WITH {_PANEL}, o AS (SELECT o_custkey AS security_id, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE + (o_orderkey % 90)::INT END AS b FROM orders),
      f AS (SELECT p.security_id, p.date, coalesce(bool_or(p.date > a AND (b IS NULL OR p.date <= b)), false) AS active, coalesce(bool_or(p.date > a AND p.date <= a + 60), false) AS recent FROM panel p LEFT JOIN o USING (security_id) GROUP BY 1, 2)
      SELECT security_id, date, CASE WHEN date >= DATE '{_KNOWN_FROM}' THEN active END AS offer_active, CASE WHEN date >= DATE '{_KNOWN_FROM}' THEN recent END AS offer_recent FROM f""",
    "inside_listing": f"""WITH {_PANEL}, s AS (SELECT s_suppkey AS security_id, DATE '1992-01-01' + (s_suppkey % 700)::INT AS a, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1997-01-01' + (s_suppkey % 500)::INT END AS b FROM supplier WHERE s_suppkey % 11 <> 0)
      SELECT security_id, CASE WHEN a IS NULL THEN 'unknown_security' WHEN date < a THEN 'before_listing' WHEN date >= b THEN 'after_delisting' ELSE 'inside' END AS place, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
      FROM bars LEFT JOIN s USING (security_id) GROUP BY 1, 2""",
    "masked_returns": f"""WITH {_PANEL}, a AS (SELECT *, quoted AND (pos + security_id) % 19 <> 0 AS allowed FROM panel)
      SELECT security_id, date, allowed, round(CASE WHEN allowed AND lag(allowed) OVER w THEN close / lag(close) OVER w - 1 END, 6) AS risk_return FROM a {_W}""",
}
