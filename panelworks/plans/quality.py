"""Queries of data quality, identity and patches, on inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import pointintime as pit
from panelworks.operators import quality as ql
from panelworks.operators import shaping as sh
from panelworks.plans.panel import _BARS, _EXAMPLES, _FACTORS, _PANEL, _core, _days, _rounded
from panelworks.sources import tables as src

_T = "((date - DATE '1992-01-06') // 7)"


def _bars(spark, d):
    """Bars with the number of their week."""
    return src.weekly_bars(spark, d).withColumn("t", (F.datediff("date", F.lit("1992-01-06").cast("date")) / 7).cast("int"))


def _aliases(spark, d):
    key = F.col("s_suppkey")
    ids = src.table(spark, d, "supplier")
    first = ids.where("s_suppkey % 10 = 0").select((key + 100000).alias("old"), key.alias("new"))
    return first.unionByName(ids.where("s_suppkey % 20 = 0").select((key + 200000).alias("old"), (key + 100000).alias("new")))


def alias_closure(spark, d):
    return ql.alias_closure(_aliases(spark, d))


def canonical_codes(spark, d):
    bars = _bars(spark, d).select("security_id", "date", "t", "volume", (1 + F.col("t") * 7 % 10 / 10000).alias("adj_factor"))
    old = bars.where("security_id % 10 = 0").withColumns({"security_id": F.col("security_id") + 100000, "adj_factor": F.floor(F.col("adj_factor") * 1000 + 1e-6) / 1000, "volume": F.col("volume") + (F.col("t") % 13 == 0).cast("int")})
    return _rounded(ql.canonical(bars.unionByName(old).drop("t"), ql.alias_closure(_aliases(spark, d)), ["volume"], "adj_factor"))


def reconciled_sources(spark, d):
    bars = _bars(spark, d).select("security_id", "date", "t", "close", "volume", "amount")
    shift = F.when(F.col("t") % 7 == 0, 3.0).when(F.col("t") % 5 == 0, 0.5).otherwise(0.0)
    other = bars.where("t % 11 <> 0").withColumn("amount", F.col("amount") + shift)
    other = other.unionByName(other.where("security_id % 17 = 0"))
    return _rounded(ql.reconciled(bars.where("t % 19 <> 0").drop("t"), other.drop("t")), 2)


def fallback_source(spark, d):
    bars = _bars(spark, d).select("security_id", "date", "t", "close")
    return _rounded(ql.with_fallback(bars.where("t % 3 <> 0").drop("t"), bars.where("t % 5 <> 0 OR t % 3 = 0").drop("t"), ["security_id", "date"]))


def gap_fills(spark, d):
    bars = _bars(spark, d).select("security_id", "date", "t", "close")
    return _rounded(ql.with_gap_fills(bars.where("t % 4 <> 0").drop("t"), bars.where("t % 4 = 0").drop("t"), ["security_id", "date"]))


def _master(spark, d):
    listed = F.date_add(F.lit("1992-01-06").cast("date"), (F.col("s_suppkey") % 300 * 7).cast("int"))
    return src.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("security_id"), listed.alias("list_date"), F.when(F.col("s_suppkey") % 5 == 0, F.date_add(listed, 1500)).alias("delist_date")
    )


def universe_asof(spark, d):
    return ql.universe_asof(_master(spark, d), sh.month_ends(_days(spark, d)))


def listing_periods(spark, d):
    master = _master(spark, d)
    second = master.where("security_id % 3 = 0").select("security_id", F.date_add("list_date", 700).alias("list_date"), F.lit(None).cast("date").alias("delist_date"))
    periods = master.withColumn("period_id", F.lit(1)).unionByName(second.withColumn("period_id", F.lit(2))).withColumnsRenamed({"list_date": "valid_from", "delist_date": "valid_to"})
    return pit.unique_period(_bars(spark, d).select("security_id", "date"), periods)


def observed_periods(spark, d):
    return ql.observed_periods(src.weekly_bars(spark, d))


def reporting_currency(spark, d):
    orders = src.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("JPY")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("currency"), F.col("o_totalprice").alias("value"))
    rates = orders.select("date").distinct().where("day(date) <> 13").select("date", F.lit("EUR").alias("currency"), (1 + F.dayofmonth("date") / 100).alias("rate"))
    return _rounded(ql.reporting_currency(orders, rates, "USD", ["value"]), 4)


def identity_classes(spark, d):
    return ql.identity_classes(src.table(spark, d, "orders").select(F.col("o_custkey").alias("isin"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("issue")))


def rule_violations(spark, d):
    rules = {"positive_price": "l_extendedprice > 0", "small_order": "l_quantity <= 40", "discounted": "l_discount > 0", "shipped_late": "l_shipdate >= DATE '1995-01-01'"}
    return ql.violations(src.table(spark, d, "lineitem"), rules)


def latest_versions(spark, d):
    events = src.table(spark, d, "orders").select(
        F.col("o_custkey").alias("security_id"), (F.col("o_orderkey") % 4).alias("event_id"), F.col("o_orderdate").alias("published_at"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("value")
    )
    return ql.latest_visible(events, "1998-06-30")


def appended_versions(spark, d):
    facts = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ql.append_versions(facts.where("o_orderkey % 3 <> 0"), facts.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"), ["o_orderkey"])


def label_patches(spark, d):
    factors = _core(spark, d)
    patches = xs.examples(factors.where("security_id % 6 = 0")).select("date", "security_id", "horizon", F.when(F.col("security_id") % 12 == 0, F.col("label_end")).alias("label_end"), (F.col("horizon") / 100).alias("new_fwd_return"))
    return _rounded(ql.patched_examples(factors, patches).drop("status"), 6)


QUERIES = {f.__name__: f for f in (alias_closure, canonical_codes, reconciled_sources, fallback_source, gap_fills, universe_asof, listing_periods, observed_periods, reporting_currency, identity_classes, rule_violations, latest_versions, appended_versions, label_patches)}

_MASTER = """master AS (SELECT s_suppkey AS security_id, DATE '1992-01-06' + (s_suppkey % 300 * 7)::INT AS list_date, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1992-01-06' + (s_suppkey % 300 * 7)::INT + 1500 END AS delist_date FROM supplier)"""
_B = f"{_BARS}, b AS (SELECT *, {_T} AS t FROM bars)"
_RULES = ("positive_price", "l_extendedprice > 0"), ("small_order", "l_quantity <= 40"), ("discounted", "l_discount > 0"), ("shipped_late", "l_shipdate >= DATE '1995-01-01'")
ORACLES = {
    "alias_closure": "SELECT s_suppkey + 100000 AS old, s_suppkey AS code FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey + 200000, s_suppkey FROM supplier WHERE s_suppkey % 20 = 0",
    "canonical_codes": f"""WITH {_B}, n AS (SELECT security_id, date, volume, t, 1 + (t * 7 % 10) / 10000.0::DOUBLE AS f, floor((1 + (t * 7 % 10) / 10000.0::DOUBLE) * 1000 + 1e-6) / 1000 AS g FROM b),
      c AS (SELECT *, CASE WHEN security_id % 10 <> 0 THEN 'single' WHEN t % 13 = 0 THEN 'conflict' WHEN f = g THEN 'equal' WHEN f - g <= 0.0005000001 THEN 'finer_factor' ELSE 'conflict' END AS decision FROM n)
      SELECT security_id, date, CASE WHEN security_id % 10 = 0 THEN 2 ELSE 1 END AS sources, decision, round(CASE WHEN decision <> 'conflict' THEN f END, 8) AS adj_factor, round(CASE WHEN decision <> 'conflict' THEN volume END, 8) AS volume FROM c""",
    "reconciled_sources": f"""WITH {_B}, s AS (SELECT *, t % 19 <> 0 AS p, t % 11 <> 0 AS r, CASE WHEN t % 7 = 0 THEN 3.0 WHEN t % 5 = 0 THEN 0.5 ELSE 0.0 END AS gap FROM b)
      SELECT security_id, date, CASE WHEN NOT p THEN 'reference_only' WHEN NOT r THEN 'primary_only' WHEN security_id % 17 = 0 THEN 'ambiguous' WHEN gap = 0 THEN 'exact' WHEN gap < 1 THEN 'below_one_unit' ELSE 'mismatch' END AS status,
      CASE WHEN p AND r THEN gap END::DOUBLE AS amount_gap FROM s WHERE p OR r""",
    "fallback_source": f"WITH {_B} SELECT security_id, date, round(close, 8) AS close, CASE WHEN t % 3 <> 0 THEN 'primary' ELSE 'fallback' END AS origin FROM b",
    "gap_fills": f"WITH {_B} SELECT security_id, date, round(close, 8) AS close FROM b",
    "universe_asof": f"WITH {_PANEL}, {_MASTER}, e AS (SELECT date FROM days QUALIFY date_trunc('month', date) < date_trunc('month', lead(date) OVER (ORDER BY date))) SELECT date, security_id FROM master JOIN e ON list_date <= date AND (delist_date IS NULL OR delist_date > date)",
    "listing_periods": f"""WITH {_BARS}, {_MASTER}, pr AS (SELECT *, 1 AS period_id FROM master UNION ALL SELECT security_id, list_date + 700, NULL, 2 FROM master WHERE security_id % 3 = 0)
      SELECT b.security_id, b.date, count(period_id) AS candidates, CASE WHEN count(period_id) = 1 THEN max(period_id) END AS period_id
      FROM bars b LEFT JOIN pr ON pr.security_id = b.security_id AND b.date >= list_date AND (delist_date IS NULL OR b.date < delist_date) GROUP BY 1, 2""",
    "observed_periods": f"WITH {_BARS} SELECT security_id, min(date) AS first_quote, max(date) AS last_quote, count(*) AS quotes FROM bars WHERE volume > 0 GROUP BY 1",
    "reporting_currency": """SELECT o_orderkey, o_orderdate::DATE AS date, ['USD', 'EUR', 'JPY'][o_custkey % 3 + 1] AS currency, round(o_totalprice * CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 3 = 1 AND day(o_orderdate) <> 13 THEN 1 + day(o_orderdate) / 100.0::DOUBLE END, 4) AS value FROM orders""",
    "identity_classes": """WITH g AS (SELECT o_custkey AS isin, count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'P') AS issues, min(o_orderstatus) FILTER (o_orderstatus <> 'P') AS i FROM orders GROUP BY 1)
      SELECT isin, issues, CASE WHEN issues = 1 THEN i END AS issue, CASE issues WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'conflict' END AS status FROM g""",
    "rule_violations": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({e}, false)) AS broken, count(*) AS rows FROM lineitem" for n, e in _RULES),
    "latest_versions": """SELECT o_custkey AS security_id, o_orderkey % 4 AS event_id, o_orderdate AS published_at, o_orderkey AS version, o_totalprice AS value FROM orders WHERE o_orderdate <= DATE '1998-06-30'
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "appended_versions": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "label_patches": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}), k AS (SELECT *, fwd_return IS NULL AND (security_id % 12 = 0 OR security_id % 6 = 0 AND label_end IS NULL) AS patched FROM e)
      SELECT date, security_id, horizon, label_end, patched, round(CASE WHEN patched THEN horizon / 100.0::DOUBLE ELSE fwd_return END, 6) AS fwd_return FROM k""",
}
