"""Queries from vendor-like tables to panel inputs; the tables are derived from the bars, suppliers and orders given."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import books as bk
from panelworks.operators import cross_section as xs
from panelworks.operators import features as fe
from panelworks.operators import intake as it
from panelworks.operators import pointintime as pit
from panelworks.operators import shaping as sh
from panelworks.plans.books import _BOOK
from panelworks.plans.panel import _EXAMPLES, _FACTORS, _PANEL, _core, _days, _factors, _panel, _rank, _rounded, _squashed, _versions
from panelworks.plans.quality import _T, _bars
from panelworks.sources import tables as src


def _mod(a, b, n):
    """Which rows a stand-in source has: all but one in n."""
    return (F.col("security_id") * a + F.col("t") * b) % n != 0


def normalized_daily(spark, d):
    bars = _bars(spark, d)
    daily = bars.select("security_id", "date", "open", "close", "high", F.when(F.col("t") % 31 == 0, F.col("close") + 1).otherwise(F.col("low")).alias("low"), (F.col("volume") / 100).alias("vol"), (F.col("amount") / 1000).alias("amount"))
    share = (F.col("security_id") % 7 + 1) / 10000
    basic = bars.where(_mod(1, 1, 11)).select("security_id", "date", (share * F.col("close")).alias("total_mv"), share.alias("total_share"), (share / 2).alias("free_share"), (F.col("t") % 9 * 1.0).alias("turnover_rate"))
    factors = bars.where(_mod(1, 2, 13)).select("security_id", "date", (1 + F.col("t") % 5 / 10).alias("adj_factor"))
    limits = bars.where(_mod(2, 1, 17)).select("security_id", "date", (F.col("close") * 1.1).alias("up_limit"), (F.col("close") * 0.9).alias("down_limit"))
    return _rounded(it.normalized_daily(daily, basic, factors, limits), 6)


def joined_sources(spark, d):
    bars = _bars(spark, d)
    quotes = bars.where(_mod(1, 1, 10)).select("security_id", "date", F.col("close").alias("raw_close"), "volume", "amount", (F.col("amount") / F.col("volume") + (F.col("t") % 7 == 0).cast("int") / 100).alias("source_vwap"))
    factor = 1 + F.floor(F.col("t") / 50) / 10
    factors = bars.where(_mod(1, 3, 12)).select("security_id", "date", factor.alias("factor"), (F.col("close") * factor * F.when(F.col("t") % 9 == 0, 1.05).otherwise(1.0)).alias("reference_close"))
    return _rounded(it.joined_sources(quotes, factors), 6)


def normalized_securities(spark, d):
    key = F.col("s_suppkey")
    digits, kind = F.lpad(key.cast("string"), 6, "0"), key % 6
    code = F.when(kind == 0, F.concat(F.lit("60"), F.substring(digits, 3, 4), F.lit(".SH"))).when(kind == 1, F.concat(F.lit("688"), F.substring(digits, 4, 3), F.lit(".SH"))).when(kind == 2, F.concat(F.lit("00"), F.substring(digits, 3, 4), F.lit(".SZ"))).when(kind == 3, F.concat(F.lit("30"), F.substring(digits, 3, 4), F.lit(".SZ"))).when(kind == 4, F.concat(digits, F.lit(".BJ"))).otherwise(F.concat(digits, F.lit(".XX")))
    listed = F.when(key % 7 != 0, F.date_add(F.lit("2019-01-01").cast("date"), (key * 13 % 1500).cast("int")))
    return it.normalized_securities(src.table(spark, d, "supplier").select(key.alias("supplier"), code.alias("code"), listed.alias("list_date")))


def listed_shares(spark, d):
    key = F.col("s_suppkey")
    six = F.lpad((key * 7919 % 1000000).cast("string"), 6, "0")
    heads = [("60", "SH"), ("688", "SH"), ("681", "SH"), ("00", "SZ"), ("30", "SZ"), ("4", "BJ"), ("8", "BJ"), ("92", "BJ"), ("93", "BJ"), ("51", "SH"), ("60", "SZ")]
    code = F.concat(*(F.when(key % len(heads) == i, F.concat(F.lit(h), F.substring(six, len(h) + 1, 6 - len(h)), F.lit(f".{m}"))).otherwise("") for i, (h, m) in enumerate(heads)))
    rows = src.table(spark, d, "supplier").select(key.alias("supplier"), F.when(key % 97 != 0, code).alias("code"))
    return it.listed_shares(rows)


def flagged_bars(spark, d):
    keys = src.table(spark, d, "orders").select((F.col("o_custkey") % 1000 + 1).alias("security_id"), F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    return it.flagged(_bars(spark, d).select("security_id", "date"), keys, "special_treatment")


def isolated_bars(spark, d):
    key = F.col("s_suppkey")
    day = F.lit("1992-01-01").cast("date")
    master = src.table(spark, d, "supplier").select(
        key.alias("security_id"), F.when(key % 4 == 0, "unresolved").when(key % 4 == 1, "partially_verified").otherwise("verified").alias("status"),
        F.date_add(day, (key % 700).cast("int")).alias("valid_from"), F.when(key % 3 == 0, F.date_add(F.lit("1997-01-01").cast("date"), (key % 300).cast("int"))).alias("valid_to"),
        (key * 10).alias("issue_id"), F.when(key % 8 == 1, "dated").otherwise("none").alias("scope"),
    )
    bars = _bars(spark, d).select("security_id", "date", "close", "volume", (F.col("t") % 2 == 0).alias("date_verified"), (F.col("security_id") * 10 + (F.col("t") % 5 == 0).cast("int")).alias("issue_id"), F.lit(True).alias("quote_present"))
    found = it.isolated(it.identity_mask(bars, master, "dated"), ["close", "volume"], ["quote_present"])
    return _rounded(found.select("security_id", "date", "close", "volume", "quote_present", "identity_valid"))


def fundamentals_asof(spark, d):
    asks = src.table(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.last_day("o_orderdate").alias("date")).distinct()
    return pit.versions_asof(asks, _versions(spark, d).withColumn("published_at", F.col("published_at") + F.expr("interval 1 day")))


def capitalisation(spark, d):
    total = F.when(F.col("quoted"), (F.col("security_id") % 7 + 1) * (1000 + F.floor(F.col("pos") / 40) * 100) * 1.0)
    rows = _panel(spark, d).withColumn("total_share", total).withColumn("free_share", F.col("total_share") * (F.col("security_id") % 5) / 10)
    rows = rows.withColumns({"total_mv": F.col("total_share") * F.col("close"), "free_mv": F.col("free_share") * F.col("close"), "turnover_ratio": F.col("volume") / F.col("total_share") * 0.917354821137})  # no mean lies on half a unit of the last digit
    return _rounded(it.capitalisation(rows), 6)


def valuation_ratios(spark, d):
    bars = src.weekly_bars(spark, d).select("security_id", "date", "close")
    facts = pit.versions_asof(bars.select("security_id", "date"), _versions(spark, d))
    rows = bars.join(facts, ["security_id", "date"]).select("security_id", "date", "close", F.col("value").alias("earnings"), (F.col("value") * 10).alias("book"))
    return _rounded(it.valuation_ratios(rows).select("security_id", "date", "earnings_yield", "book_to_price"), 6)


def momentum_scores(spark, d):
    ranked = xs.ranks(_factors(spark, d), ("momentum_252_skip20",))
    return _rounded(it.momentum_score(ranked))


def input_legality(spark, d):
    factors = _core(spark, d)
    rows = factors.select("date", "security_id", "status", (F.col("volatility_20") / 252**0.5).alias("sigma"), *xs.INPUTS[:2], F.explode(F.array(*(F.lit(h) for h in (*fe.HORIZONS, 250)))).alias("horizon"))
    found = it.legality(rows, list(xs.INPUTS[:2]), fe.HORIZONS)
    return found.groupBy("date", "horizon", "legal", "reasons").agg(F.count(F.lit(1)).alias("rows"))


def session_labels(spark, d):
    factors, calendar = _core(spark, d), _days(spark, d)
    ends = sh.month_ends(calendar)
    names = factors.select("date", "security_id").join(ends, "date")
    found = bk.interval_returns(names, factors.select("security_id", "date", "close"), bk.signal_intervals(ends, calendar))
    return _rounded(found.select("signal", "security_id", "entry", "exit", _squashed("gross_return").alias("bounded_return")), 6)


def partition_windows(spark, d):
    spans = src.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    kinds = [it.windows_of(spans, k).select("o_custkey", F.lit(k).alias("kind"), "start", "end") for k in ("month", "quarter", "half_month")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def page_violations(spark, d):
    orders = src.table(spark, d, "orders")
    rows = orders.select(F.year("o_orderdate").alias("page"), F.col("o_custkey").alias("security_id"), F.trunc("o_orderdate", "month").alias("date"), F.when(F.col("o_orderkey") % 29 != 0, F.col("o_totalprice")).alias("value"))
    return it.page_violations(rows, ["security_id", "date", "value"], "1993-03-01", "1998-05-31", "page")


QUERIES = {f.__name__: f for f in (normalized_daily, joined_sources, normalized_securities, listed_shares, flagged_bars, isolated_bars, fundamentals_asof, capitalisation, valuation_ratios, momentum_scores, input_legality, session_labels, partition_windows, page_violations)}

_B = f"""{_PANEL}, b AS (SELECT *, {_T}::INT AS t FROM bars)"""
_VERSIONS = """v AS (SELECT o_custkey AS security_id, o_orderdate + to_days((o_orderkey % 90)::INT + {lag}) AS published_at, date_trunc('month', o_orderdate)::DATE AS period_end, o_orderkey AS version, o_totalprice AS value FROM orders),
      kept AS (SELECT * FROM v QUALIFY period_end = max(period_end) OVER (PARTITION BY security_id ORDER BY published_at, version ROWS UNBOUNDED PRECEDING))"""
ORACLES = {
    "normalized_daily": f"""WITH {_B}, q AS (SELECT *, CASE WHEN t % 31 = 0 THEN close + 1 ELSE low END AS lo, (security_id % 7 + 1) / 10000.0::DOUBLE AS share, (security_id + t) % 11 <> 0 AS has_b, (security_id + 2 * t) % 13 <> 0 AS has_f, (2 * security_id + t) % 17 <> 0 AS has_l FROM b),
      n AS (SELECT security_id, date, open AS raw_open, close AS raw_close, high, lo AS low, amount / 1000 * 1000 AS amount, CASE WHEN has_b THEN share * close * 10000 END AS total_mv, CASE WHEN has_b THEN share * 10000 END AS total_share, CASE WHEN has_b THEN share / 2 * 10000 END AS free_share,
        CASE WHEN has_f THEN 1 + (t % 5) / 10.0::DOUBLE END AS adj_factor, CASE WHEN has_l THEN close * 1.1::DOUBLE END AS up_limit, CASE WHEN has_l THEN close * 0.9::DOUBLE END AS down_limit, volume / 100 * 100 AS volume, CASE WHEN has_b THEN (t % 9) / 100.0::DOUBLE END AS turnover_ratio FROM q),
      m AS (SELECT *, free_share * raw_close AS free_mv, raw_close * adj_factor AS adj_close, volume > 0 AND amount > 0 AND raw_close > 0 AS quote_present,
        coalesce(raw_open > 0 AND raw_close > 0 AND high > 0 AND low > 0 AND adj_factor > 0 AND raw_open BETWEEN low AND high AND raw_close BETWEEN low AND high, false) AS data_valid FROM n)
      SELECT security_id, date, quote_present, data_valid, {", ".join(f"round({c}, 6) AS {c}" for c in "raw_open raw_close high low amount total_mv total_share free_share adj_factor up_limit down_limit volume free_mv turnover_ratio adj_close".split())} FROM m""",
    "joined_sources": f"""WITH {_B}, q AS (SELECT security_id, date, close AS raw_close, volume, amount, amount / volume + (t % 7 = 0)::INT / 100.0::DOUBLE AS source_vwap FROM b WHERE (security_id + t) % 10 <> 0),
      r AS (SELECT security_id, date, 1 + (t // 50) / 10.0::DOUBLE AS factor, close * (1 + (t // 50) / 10.0::DOUBLE) * CASE WHEN t % 9 = 0 THEN 1.05::DOUBLE ELSE 1 END AS reference_close FROM b WHERE (security_id + 3 * t) % 12 <> 0),
      j AS (SELECT *, raw_close * factor AS adj_close, CASE WHEN volume > 0 THEN amount / volume END AS vwap FROM q FULL JOIN r USING (security_id, date))
      SELECT security_id, date, round(raw_close, 6) AS raw_close, round(adj_close, 6) AS adj_close, round(vwap, 6) AS vwap, coalesce(volume > 0 AND amount > 0 AND vwap > 0, false) AS quote_present,
        coalesce(raw_close > 0 AND factor > 0, false) AND NOT coalesce(abs(reference_close - adj_close) > greatest(0.02::DOUBLE, abs(adj_close) * 0.001::DOUBLE), false) AND NOT coalesce(abs(source_vwap - vwap) > 0.005001::DOUBLE, false) AS data_valid FROM j""",
    "normalized_securities": f"""WITH c AS (SELECT s_suppkey AS supplier, lpad(s_suppkey::VARCHAR, 6, '0') AS x, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '2019-01-01' + (s_suppkey * 13 % 1500)::INT END AS listed FROM supplier),
      k AS (SELECT supplier, listed, CASE supplier % 6 WHEN 0 THEN '60' || substr(x, 3, 4) || '.SH' WHEN 1 THEN '688' || substr(x, 4, 3) || '.SH' WHEN 2 THEN '00' || substr(x, 3, 4) || '.SZ' WHEN 3 THEN '30' || substr(x, 3, 4) || '.SZ' WHEN 4 THEN x || '.BJ' ELSE x || '.XX' END AS code FROM c)
      SELECT supplier, code, CASE WHEN code LIKE '%.BJ' AND listed IS NOT NULL THEN greatest(listed, DATE '2021-11-15') ELSE listed END AS list_date, listed AS source_list_date, substr(code, 1, 6) AS exchange_code, CASE WHEN code LIKE '688%' THEN 200 ELSE 100 END::INT AS lot_size
      FROM k WHERE code NOT LIKE '%.XX'""",
    "listed_shares": """WITH h AS (SELECT * FROM (VALUES (0, '60', 'SH', true), (1, '688', 'SH', true), (2, '681', 'SH', false), (3, '00', 'SZ', true), (4, '30', 'SZ', true), (5, '4', 'BJ', true), (6, '8', 'BJ', true), (7, '92', 'BJ', true), (8, '93', 'BJ', false), (9, '51', 'SH', false), (10, '60', 'SZ', false)) t(i, head, market, listed))
      SELECT s_suppkey AS supplier, head || substr(lpad((s_suppkey * 7919 % 1000000)::VARCHAR, 6, '0'), length(head) + 1) || '.' || market AS code FROM supplier JOIN h ON i = s_suppkey % 11 WHERE listed AND s_suppkey % 97 <> 0""",
    "flagged_bars": f"""WITH {_B}, k AS (SELECT DISTINCT o_custkey % 1000 + 1 AS security_id, date_trunc('week', o_orderdate)::DATE AS date FROM orders)
      SELECT b.security_id, b.date, k.date IS NOT NULL AS special_treatment FROM b LEFT JOIN k USING (security_id, date)""",
    "isolated_bars": f"""WITH {_B}, i AS (SELECT *, CASE WHEN security_id % 4 = 0 THEN false WHEN security_id % 4 = 1 THEN t % 2 = 0 AND t % 5 <> 0 AND security_id % 8 = 1
        ELSE date >= DATE '1992-01-01' + (security_id % 700)::INT AND (security_id % 3 <> 0 OR date < DATE '1997-01-01' + (security_id % 300)::INT) END AS ok FROM b)
      SELECT security_id, date, round(CASE WHEN ok THEN close END, 8) AS close, round(CASE WHEN ok THEN volume END, 8) AS volume, ok AS quote_present, ok AS identity_valid FROM i""",
    "fundamentals_asof": f"""WITH {_VERSIONS.format(lag=1)}, a AS (SELECT DISTINCT o_custkey AS security_id, last_day(o_orderdate) AS date FROM orders)
      SELECT a.security_id, a.date, arg_max(kept.period_end, row(published_at, version)) AS period_end, arg_max(value, row(published_at, version)) AS value, arg_max(version, row(published_at, version)) AS version
      FROM a LEFT JOIN kept ON a.security_id = kept.security_id AND published_at <= a.date GROUP BY 1, 2""",
    "capitalisation": f"""WITH {_PANEL}, s AS (SELECT *, CASE WHEN quoted THEN (security_id % 7 + 1) * (1000 + (pos // 40) * 100) * 1.0::DOUBLE END AS ts FROM panel), u AS (SELECT *, ts * (security_id % 5) / 10 AS fs FROM s),
      w20 AS (SELECT *, count(volume / ts) OVER r AS n, avg(volume / ts * 0.917354821137::DOUBLE) OVER r AS tu FROM u WINDOW r AS (PARTITION BY security_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
      SELECT security_id, date, round(CASE WHEN ts * close > 0 THEN ln(ts * close) END, 6) AS log_market_cap, round(CASE WHEN fs * close > 0 THEN ln(fs * close) END, 6) AS log_free_market_cap, round(fs / nullif(ts, 0), 6) AS free_share_ratio, round(CASE WHEN n >= 12 THEN tu END, 6) AS turnover_20,
        {", ".join(f"round(ts / nullif(lag(ts, {n}) OVER o, 0) - 1, 6) AS share_change_{n}" for n in (60, 252))} FROM w20 WINDOW o AS (PARTITION BY security_id ORDER BY pos)""",
    "valuation_ratios": f"""WITH {_PANEL}, {_VERSIONS.format(lag=0)}, a AS (SELECT b.security_id, b.date, any_value(b.close) AS close, arg_max(value, row(published_at, version)) AS value FROM bars b LEFT JOIN kept ON b.security_id = kept.security_id AND published_at <= b.date GROUP BY 1, 2)
      SELECT security_id, date, round(value / nullif(close, 0), 6) AS earnings_yield, round(value * 10 / nullif(close, 0), 6) AS book_to_price FROM a""",
    "momentum_scores": f"""WITH {_FACTORS}, y AS (SELECT date, security_id, {_rank("momentum_252_skip20", "date")} AS q FROM f WHERE status = 'ok') SELECT date, security_id, round(q, 8) AS momentum_252_skip20, round(2 * q - 1, 8) AS score FROM y""",
    "input_legality": f"""WITH {_FACTORS}, l AS (SELECT date, horizon, concat_ws(',', CASE WHEN momentum_60 IS NULL OR momentum_5 IS NULL THEN 'missing_feature' END, CASE WHEN NOT coalesce(volatility_20 > 0, false) THEN 'sigma' END,
        CASE WHEN horizon = 250 THEN 'unsupported_horizon' END, CASE WHEN status <> 'ok' THEN 'status' END) AS reasons FROM f, (SELECT unnest([1, 5, 20, 60, 250])::INT AS horizon))
      SELECT date, horizon, reasons = '' AS legal, reasons, count(*) AS rows FROM l GROUP BY ALL""",
    "session_labels": f"""WITH {_BOOK}, g AS (SELECT signal, f.security_id, entry, exit, CASE WHEN a.close > 0 THEN b.close / a.close - 1 END AS r FROM iv JOIN f ON f.date = signal
        LEFT JOIN px a ON a.security_id = f.security_id AND a.date = entry LEFT JOIN px b ON b.security_id = f.security_id AND b.date = exit)
      SELECT signal, security_id, entry, exit, round(r / (1 + abs(r)), 6) AS bounded_return FROM g""",
    "partition_windows": """WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
      m AS (SELECT *, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM s), q AS (SELECT *, unnest(generate_series(date_trunc('quarter', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 3 MONTH))::DATE AS m FROM s),
      w AS (SELECT o_custkey, 'month' AS kind, greatest(a, m) AS start, least(b, last_day(m)) AS "end" FROM m UNION ALL SELECT o_custkey, 'quarter', greatest(a, m), least(b, (m + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE) FROM q
        UNION ALL SELECT o_custkey, 'half_month', greatest(a, m), least(b, m + 14) FROM m UNION ALL SELECT o_custkey, 'half_month', greatest(a, m + 15), least(b, last_day(m)) FROM m)
      SELECT o_custkey, kind, start, "end" FROM w WHERE start <= "end\"""",
    "page_violations": """WITH p AS (SELECT year(o_orderdate)::INT AS page, o_custkey AS security_id, date_trunc('month', o_orderdate)::DATE AS date, CASE WHEN o_orderkey % 29 <> 0 THEN o_totalprice END AS value FROM orders),
      r AS (SELECT *, row_number() OVER (PARTITION BY page, security_id, date) > 1 AS again FROM p)
      SELECT page, count(*) AS rows, count(*) FILTER (value IS NULL) AS missing_fields, count(*) FILTER (date NOT BETWEEN DATE '1993-03-01' AND DATE '1998-05-31') AS outside_range, count(*) FILTER (again) AS duplicates FROM r GROUP BY 1""",
}
