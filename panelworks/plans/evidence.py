"""Queries of evidence, and of vendor formats read from texts that the given tables make."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.operators import evidence as evd
from panelworks.plans.panel import _BARS, _PANEL, _days, _rounded
from panelworks.sources import ingest as ing
from panelworks.sources import tables as src
from panelworks.sources.store import materialised, shared_folder


def _panel(spark, d):
    return materialised(spark, d, "panel", lambda: src.panel(spark, d))


def dated_evidence(spark, d):
    bars = _panel(spark, d).where("quoted").select("security_id", "date", "pos", F.col("close").alias("raw_close"), "volume", "amount", (F.col("close") * 2).alias("adj_close"))
    proofs = bars.where("(security_id + pos) % 3 <> 0").select("security_id", "date", "raw_close", (F.col("volume") + F.when((F.col("security_id") + F.col("pos")) % 10 == 0, 1).otherwise(0)).alias("volume"), "amount", (F.col("security_id") * 10).alias("issue"), F.when(F.col("security_id") % 4 == 0, "CNY").otherwise("HKD").alias("currency"))
    rates = _days(spark, d).where("pos % 5 <> 0").select("date", F.lit("CNY").alias("currency"), F.lit(1.25).alias("rate"))
    return _rounded(evd.dated_evidence(bars.drop("pos"), proofs, rates), 6)


def reconciled_terms(spark, d):
    panel = _panel(spark, d)
    steps = F.floor(F.col("pos") / 20)
    bars = panel.where("quoted").select("security_id", "date", (F.floor("close") * 1.0).alias("close"), F.when((F.col("security_id") + F.col("pos")) % 37 != 0, F.pow(F.lit(2.0), steps)).alias("adj_factor"))
    acts = panel.where("pos % 20 = 0 AND pos > 0").select("security_id", "date", F.when(F.col("security_id") % 3 == 0, 0.02).otherwise(0.0).alias("gross"), F.when(F.col("security_id") % 5 == 0, 1.5).otherwise(2.0).alias("multiplier"))
    return _rounded(evd.reconciled_terms(acts, bars), 6)


def contemporaneous_lots(spark, d):
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    rows = src.table(spark, d, "orders").select(day.alias("date"), key.alias("code"), F.when(key % 11 != 0, key % 5 * 100 + 100).alias("lot"), F.when(key % 13 != 0, F.date_add(day, (key % 3 - 1).cast("int"))).alias("observed"))
    return evd.contemporaneous_lots(rows)


def filtered_prices(spark, d):
    rows = src.table(spark, d, "lineitem").select(F.concat("l_suppkey", F.lit(".hk")).alias("code"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber")
    sessions = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where("dayofweek(date) NOT IN (1, 7)")
    listings = src.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lpad("s_suppkey", 5, "0"), F.lit(".HK")).alias("code"), F.date_add(F.lit("1995-06-01").cast("date"), (F.col("s_suppkey") * 13 % 900).cast("int")).alias("listed"))
    return evd.filtered_prices(rows, sessions, listings)


def cleaned_quotes(spark, d):
    key = F.col("s_suppkey")
    quotes = _panel(spark, d).select(F.col("security_id").alias("issue"), "date", F.col("close").alias("closing"), F.when(F.col("pos") % 9 == 0, 1).otherwise(0).alias("no_close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.when(F.col("pos") % 4 != 0, F.col("amount")).otherwise(0.0).alias("amount"))
    at = lambda n: F.date_add(F.lit("1995-03-01").cast("date"), n)
    lists = src.table(spark, d, "supplier")
    one = lists.select(key.alias("issue"), key.alias("listing"), F.when(key % 6 != 0, key.cast("string")).otherwise("A1").alias("code"), at((key % 400).cast("int")).alias("start"), at((key % 400 + 1000).cast("int")).alias("end"))
    two = lists.where("s_suppkey % 2 = 0").select(key.alias("issue"), (key + 100000).alias("listing"), F.lpad((key + 7).cast("string"), 5, "0").alias("code"), at((key % 400 + 900).cast("int")).alias("start"), F.lit(None).cast("date").alias("end"))
    return _rounded(evd.cleaned_quotes(quotes, one.unionByName(two)), 8)


def importance_shares(spark, d):
    gains = src.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 40).alias("feature")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("gain"))
    return _rounded(evd.importance_shares(gains, "year"), 8)


def contradictions(spark, d):
    key = F.col("s_suppkey")
    rows = src.table(spark, d, "supplier").select(
        key.alias("candidate"), (key % 10 / 100).alias("rank_ic"), (key % 10 / 100 - 0.01).alias("ic_lower"), (key % 10 / 100 + F.when(key % 7 == 0, -0.005).otherwise(0.01)).alias("ic_upper"), F.lit(0.2).alias("brier"), F.lit(0.25).alias("baseline_brier"),
        F.when(key % 11 == 0, float("nan")).when(key % 9 == 0, 0.3).otherwise(1 - F.lit(0.2) / F.lit(0.25)).alias("brier_skill"), (key % 50).alias("covered"), F.lit(50).cast("long").alias("available"), (key % 50 / 50 + F.when(key % 13 == 0, 0.01).otherwise(0.0)).alias("coverage"), F.lit(10).alias("dates"), F.lit(100).alias("rows"),
    )
    return evd.contradictions(rows, "candidate")


def cohort_audit(spark, d):
    cohort = src.table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("security_id"))
    bars = _panel(spark, d).where("quoted").select("security_id", "date", "close", (F.col("pos") % 7 != 0).alias("quote_present"), F.when(F.col("pos") % 5 != 0, True).alias("data_valid"))
    return evd.cohort_panel(cohort, bars, _days(spark, d))[1]


def chart_payloads(spark, d):
    """Chart payloads of the bars of every supplier, some in another currency or with an array too short."""
    bars = src.weekly_bars(spark, d)
    w = F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), *(F.col(c) for c in ("open", "high", "low", "close", "volume")))))
    rows = bars.groupBy("security_id").agg(w.alias("b"))
    key = F.col("security_id")
    short = F.when(key % 17 == 0, F.slice("b.volume", 1, 3)).otherwise(F.col("b.volume"))
    quote = F.struct(*(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close")), short.alias("volume"))
    meta = F.struct(F.when(key % 19 == 0, "other").otherwise(key.cast("string")).alias("symbol"), F.when(key % 13 == 0, "HKD").otherwise("USD").alias("currency"), F.lit("UTC").alias("exchangeTimezoneName"))
    result = F.struct(meta.alias("meta"), F.col("b.t").alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("b.close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.filter(F.array(result), lambda _: key % 23 != 0).alias("result")).alias("chart")))
    found = ing.chart_bars(rows.select(key.cast("string").alias("symbol"), body.alias("json")))
    return found.groupBy("security_id", "problem").agg(F.count("date").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if("quote_present").alias("quoted"), F.count_if("data_valid").alias("valid"))


def csv_orders(spark, d):
    """Orders as CSV with malformed and illegal lines; what is kept and why the rest is not."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    rows = src.table(spark, d, "orders").select(
        key.cast("string").alias("k"), F.when(key % 19 == 0, "x1").otherwise(F.col("o_custkey").cast("string")).alias("customer"), F.when(key % 17 == 0, -1.5).otherwise(F.floor("o_totalprice")).cast("string").alias("price"), F.when(key % 23 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")
    )
    rows.write.option("header", "true").csv(folder)
    kept, gaps = ing.csv_records(spark, folder, "k bigint, customer bigint, price double, day date", {"positive_price": "price > 0", "dated": "day IS NOT NULL"})
    return kept.select("k", F.lit("kept").alias("reasons")).unionByName(gaps.select("k", F.array_join("reasons", ",").alias("reasons")))


def quotation_pages(spark, d):
    """Two-line quotations, forty suppliers' bars a page; some suspended, some with a line cut off."""
    bars = _panel(spark, d).where("quoted").select("security_id", "pos", "date", F.floor("close").alias("c"), F.round("volume").cast("long").alias("v"), F.round("amount").cast("long").alias("m"))
    name = F.concat(F.lit("NAME "), F.lit("CO"))
    head = F.when((F.col("security_id") + F.col("pos")) % 29 == 0, F.concat(F.lit(" "), F.col("security_id") % 9999, F.lit(" "), name, F.lit("  TRADING SUSPENDED"))).otherwise(F.concat(F.lit("*"), F.col("security_id") % 9999, F.lit(" "), name, F.lit(" 1.00 N/A "), F.col("c").cast("decimal(12,2)"), F.lit(" "), F.format_number("v", 0)))
    second = F.when((F.col("security_id") + F.col("pos")) % 31 == 0, F.lit("- -")).otherwise(F.concat(F.lit("  "), F.col("c").cast("decimal(12,2)"), F.lit(" - "), F.col("c").cast("decimal(12,2)"), F.lit(" "), F.format_number("m", 0)))
    place = F.row_number().over(Window.partitionBy("pos").orderBy("security_id"))
    lines = bars.withColumn("n", place).select("pos", "security_id", F.explode(F.array(F.struct((F.col("n") * 2).alias("line_no"), head.alias("value")), F.struct((F.col("n") * 2 + 1).alias("line_no"), second.alias("value")))).alias("x"))
    found = ing.quotations(lines.select(F.col("pos").alias("document"), "x.line_no", "x.value"))
    return _rounded(found.select("document", "code", "status", "previous_close", "ask", "high", "volume", "close", "bid", "low", "amount", "vwap"), 4)


QUERIES = {f.__name__: f for f in (dated_evidence, reconciled_terms, contemporaneous_lots, filtered_prices, cleaned_quotes, importance_shares, contradictions, cohort_audit, chart_payloads, csv_orders, quotation_pages)}

ORACLES = {
    "dated_evidence": f"""WITH {_PANEL}, b AS (SELECT *, (security_id + pos) % 3 <> 0 AS has, (security_id + pos) % 10 <> 0 AS same, CASE WHEN security_id % 4 = 0 THEN 'CNY' ELSE 'HKD' END AS cur FROM panel WHERE quoted),
      k AS (SELECT *, has AND same AS ok, CASE WHEN has AND same THEN CASE WHEN cur = 'HKD' THEN 1.0 WHEN pos % 5 <> 0 THEN 1.25 END END::DOUBLE AS fx FROM b)
      SELECT security_id, date, CASE WHEN NOT has THEN 'no_proof' WHEN NOT same THEN 'differs_from_bar' WHEN fx IS NULL THEN 'rate_missing' ELSE 'verified' END AS verdict, CASE WHEN ok THEN security_id * 10 END AS issue, CASE WHEN ok THEN cur END AS currency, fx,
        round(close * 2 * fx, 6) AS adj_close_reporting, round(amount * fx, 6) AS amount_reporting FROM k""",
    "reconciled_terms": f"""WITH {_PANEL}, b AS (SELECT security_id, date, pos, floor(close) AS c, CASE WHEN (security_id + pos) % 37 <> 0 THEN pow(2::DOUBLE, pos // 20) END AS f FROM panel WHERE quoted), l AS (SELECT *, lag(c) OVER w AS lc, lag(f) OVER w AS lf FROM b WINDOW w AS (PARTITION BY security_id ORDER BY date)),
      a AS (SELECT security_id, date, CASE WHEN security_id % 3 = 0 THEN 0.02 ELSE 0.0 END::DOUBLE AS gross, CASE WHEN security_id % 5 = 0 THEN 1.5 ELSE 2.0 END::DOUBLE AS multiplier FROM panel WHERE pos % 20 = 0 AND pos > 0), k AS (SELECT a.*, (lc - gross) / multiplier AS e, lc * lf / f AS i FROM a LEFT JOIN l USING (security_id, date))
      SELECT security_id, date, round(gross, 6) AS gross, multiplier, round(e, 6) AS expected, round(i, 6) AS implied, coalesce(e > 0 AND abs(e - i) <= 0.011::DOUBLE, false) AS consistent FROM k""",
    "contemporaneous_lots": """WITH r AS (SELECT o_orderdate::DATE AS date, o_orderkey AS code, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 * 100 + 100 END AS lot, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE + (o_orderkey % 3 - 1)::INT END AS observed FROM orders)
      SELECT date, code, CASE WHEN observed = date THEN lot END AS lot, observed, CASE WHEN observed IS NULL THEN 'missing_observation_date' WHEN observed > date THEN 'future_observation' WHEN observed < date THEN 'stale_observation' WHEN lot IS NULL THEN 'missing_lot' ELSE 'observed' END AS status FROM r""",
    "filtered_prices": """SELECT lpad(l_suppkey::VARCHAR, 5, '0') || '.HK' AS code, l_shipdate::DATE AS date, l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate::DATE IN (SELECT o_orderdate::DATE FROM orders WHERE dayofweek(o_orderdate) NOT IN (0, 6))
      AND (l_suppkey % 4 = 0 OR l_shipdate::DATE >= DATE '1995-06-01' + (l_suppkey * 13 % 900)::INT)""",
    "cleaned_quotes": f"""WITH {_PANEL}, s AS (SELECT s_suppkey AS issue, s_suppkey AS listing, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey::VARCHAR ELSE 'A1' END AS code, DATE '1995-03-01' + (s_suppkey % 400)::INT AS a, DATE '1995-03-01' + (s_suppkey % 400 + 1000)::INT AS b FROM supplier
        UNION ALL SELECT s_suppkey, s_suppkey + 100000, (s_suppkey + 7)::VARCHAR, DATE '1995-03-01' + (s_suppkey % 400 + 900)::INT, NULL FROM supplier WHERE s_suppkey % 2 = 0),
      k AS (SELECT p.security_id, p.date, count(s.listing) AS n, min(s.listing) AS listing, arg_min(s.code, s.listing) AS code FROM panel p LEFT JOIN s ON s.issue = p.security_id AND s.a <= p.date AND (s.b IS NULL OR p.date < s.b) GROUP BY 1, 2),
      m AS (SELECT *, CASE WHEN n = 0 THEN 'outside_listing' WHEN n > 1 THEN 'ambiguous_listing' WHEN code = 'A1' THEN 'missing_code' ELSE 'matched' END AS place FROM k)
      SELECT security_id AS issue, date, round(CASE WHEN pos % 9 <> 0 THEN close END, 8) AS raw_close, round(CASE WHEN volume > 0 AND pos % 4 <> 0 THEN amount / volume END, 8) AS vwap, place, n AS candidates, CASE WHEN place = 'matched' THEN lpad(code, 5, '0') || '.HK' END AS exchange_code, CASE WHEN place = 'matched' THEN listing END AS listing
      FROM panel JOIN m USING (security_id, date)""",
    "importance_shares": """WITH g AS (SELECT year(l_shipdate)::INT AS year, l_partkey % 40 AS feature, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS gain FROM lineitem GROUP BY 1, 2)
      SELECT year, feature, round(gain, 8) AS gain, round(gain / sum(gain) OVER (PARTITION BY year), 8) AS share, row_number() OVER (PARTITION BY year ORDER BY gain DESC, feature)::INT AS place FROM g QUALIFY place <= 10""",
    "contradictions": """WITH k AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS candidate, 'not_finite' AS problem FROM k WHERE k % 11 = 0 UNION ALL SELECT k, 'outside_interval' FROM k WHERE k % 7 = 0 UNION ALL SELECT k, 'skill_differs' FROM k WHERE k % 11 = 0 OR k % 9 = 0 UNION ALL SELECT k, 'coverage_differs' FROM k WHERE k % 13 = 0""",
    "cohort_audit": f"""WITH {_PANEL}, c AS (SELECT s_suppkey * 2 AS security_id FROM supplier), q AS (SELECT security_id, date, pos % 7 <> 0 AND pos % 5 <> 0 AS good FROM panel WHERE quoted)
      SELECT c.security_id, count(*) FILTER (good) AS valid_quotes, min(date) FILTER (good) AS first_quote, max(date) FILTER (good) AS last_quote, count(date) AS rows, CASE WHEN count(date) > 0 THEN 'observed' ELSE 'unavailable' END AS source FROM c LEFT JOIN q USING (security_id) GROUP BY 1""",
    "chart_payloads": f"""WITH {_BARS}, p AS (SELECT *, CASE WHEN security_id % 23 = 0 THEN 'no_history' WHEN security_id % 19 = 0 THEN 'symbol_mismatch' WHEN security_id % 13 = 0 THEN 'currency' WHEN security_id % 17 = 0 AND count(*) OVER (PARTITION BY security_id) > 3 THEN 'array_lengths' END AS problem FROM bars)
      SELECT security_id::VARCHAR AS security_id, problem, count(*) FILTER (problem IS NULL) AS bars, min(date) FILTER (problem IS NULL) AS first_date, max(date) FILTER (problem IS NULL) AS last_date, count(*) FILTER (problem IS NULL AND volume > 0) AS quoted,
        count(*) FILTER (problem IS NULL AND open > 0 AND close > 0 AND high > 0 AND low > 0) AS valid FROM p GROUP BY 1, 2""",
    "csv_orders": """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 19 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0 THEN 'kept' ELSE concat_ws(',', CASE WHEN o_orderkey % 19 = 0 THEN 'malformed' END, CASE WHEN o_orderkey % 17 = 0 THEN 'positive_price' END, CASE WHEN o_orderkey % 23 = 0 THEN 'dated' END) END AS reasons FROM orders""",
    "quotation_pages": f"""WITH {_PANEL}, b AS (SELECT security_id, pos, floor(close) AS c, round(volume) AS v, round(amount) AS m, (security_id + pos) % 29 = 0 AS halted, (security_id + pos) % 31 = 0 AS cut FROM panel WHERE quoted), k AS (SELECT *, NOT halted AND NOT cut AS ok FROM b)
      SELECT pos::INT AS document, lpad((security_id % 9999)::VARCHAR, 5, '0') AS code, CASE WHEN halted THEN 'exchange_reported_suspension' WHEN cut THEN 'malformed' ELSE 'reported_trade' END AS status, CASE WHEN ok THEN 1.0 END::DOUBLE AS previous_close, NULL::DOUBLE AS ask, CASE WHEN ok THEN c END AS high, CASE WHEN ok THEN v END AS volume,
        CASE WHEN ok THEN c END AS close, NULL::DOUBLE AS bid, CASE WHEN ok THEN c END AS low, CASE WHEN ok THEN m END AS amount, round(CASE WHEN ok THEN m / v END, 4) AS vwap FROM k""",
}
