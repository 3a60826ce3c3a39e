"""Queries of archived sources and of market context, on inputs derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelworks.operators import archives as ar
from panelworks.operators import context as cx
from panelworks.plans.panel import _PANEL, _days, _rounded
from panelworks.sources import ingest as ing
from panelworks.sources import tables as src
from panelworks.sources.store import materialised, shared_folder

_FROM, _TO, _TURN = "2024-01-05", "2024-01-20", "2024-01-12"


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _requests(spark, d):
    """Forty events a response, those of odd users one list deeper, the volume taken from the event's own JSON."""
    key = F.floor(F.col("event_id") / 40)
    one = F.to_json(F.struct(F.concat(F.col("user_id") % 50, F.lit(".hk")).alias("thscode"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.col("value").alias("close"), F.get_json_object("props", "$.k").cast("double").alias("volume"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("amount")))
    item = F.when(F.col("event_id") % 7 == 0, F.lit('{"other": 1}')).when(F.col("user_id") % 2 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    rows = src.table(spark, d, "events").groupBy(key.alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"))
    data = F.when(F.col("request_id") % 17 == 0, F.lit('{"error": "none"}')).otherwise(F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")))
    body = F.concat(F.lit('{"status_code": '), F.when(F.col("request_id") % 13 == 0, 500).otherwise(200), F.lit(', "data": '), data, F.lit("}"))
    return rows.select("request_id", (1000000 - F.col("request_id")).alias("seq"), F.when(F.col("request_id") % 3 == 0, "adjusted").otherwise("raw").alias("kind"), F.when(F.col("request_id") % 11 != 0, body).alias("response"))


def response_tape(spark, d):
    return _rounded(ar.tape(ar.observations(_requests(spark, d))), 4)


def tape_conflicts(spark, d):
    return _rounded(ar.conflicts(ar.observations(_requests(spark, d))), 4)


def request_gaps(spark, d):
    return ar.request_gaps(_requests(spark, d))


def drifting_partitions(spark, d):
    """Orders of some years in a folder of their own, whose types and fields changed over the years.

    Rows whose customer does not fit a folder's type lie beside it in a folder with a wider one.
    """
    root = _place(spark, "drift")
    orders = src.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", F.floor("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), "o_orderstatus")
    years = {"early": "year <= 1996", "middle": "year IN (1997, 1998)", "late": "year >= 1999"}
    shapes = {"early": {"price": "float", "customer": "smallint"}, "middle": {"price": "double", "customer": "int"}, "late": {"price": "double", "customer": "bigint"}}
    folders = []
    for name, when in years.items():
        fits = F.col("customer").isNull() | F.col("customer").try_cast(shapes[name]["customer"]).isNotNull()
        wide = {"price": "double", "customer": "bigint"}
        for folder, shape, rows in ((name, shapes[name], orders.where(when).where(fits)), (f"{name}_wide", wide, orders.where(when).where(~fits))):
            rows = rows.select("year", "o_orderkey", *(F.col(c).cast(t).alias(c) for c, t in shape.items()), *(["o_orderstatus"] if name != "early" else []))
            rows.write.parquet(f"{root}/{folder}")
            folders.append(f"{root}/{folder}")
    return ar.read_drifting(spark, folders)


def segmented_scan(spark, d):
    events = src.table(spark, d, "events").select(F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), F.to_date("ts").alias("date"), "event_id")
    asked = {"requested_from": F.date_trunc("day", "ts").cast("timestamp_ntz"), "requested_to": (F.date_trunc("day", "ts") + F.when(F.col("event_id") % 19 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 23 HOURS 59 MINUTES 59 SECONDS"))).cast("timestamp_ntz")}
    root = _place(spark, "segments")
    for name, freq in (("fine", "1min"), ("coarse", "60min")):
        odd = F.when(F.col("event_id") % 23 == 0, "5min").otherwise(freq)
        events.withColumns(asked | {"freq": odd}).repartition("date").write.partitionBy("date").parquet(f"{root}/{name}")
    segments = [{"folder": f"{root}/fine", "frequency": "1min", "first": "2023-12-01", "last": "2024-01-11"}, {"folder": f"{root}/coarse", "frequency": "60min", "first": _TURN, "last": "2024-03-01"}]
    rows = ar.segmented_scan(spark, segments, _FROM, _TO)
    good = F.col("problem").isNull()
    found = rows.groupBy("date", "frequency").agg(F.count_if(good).alias("ticks"), F.sum(F.when(good, F.col("price").cast("decimal(18,4)"))).cast("double").alias("amount"), F.count_if(F.col("problem") == "frequency_mismatch").alias("other_frequency"), F.count_if(F.col("problem") == "outside_request").alias("outside"))
    return _rounded(found, 4)


def checksum_audit(spark, d):
    """Pages as artefacts; of their manifest some entries are stale, missing, superfluous or there twice."""
    pages = src.table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.col("page_id").alias("k"))
    told = F.sha2(F.when(F.col("k") % 9 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")), 256)
    manifest = pages.where("k % 7 <> 0").select(F.when(F.col("k") % 10 == 3, F.concat("name", F.lit(".gone"))).otherwise(F.col("name")).alias("name"), F.when(F.col("k") % 2 == 0, F.upper(told)).otherwise(told).alias("sha256"), "k")
    manifest = manifest.unionByName(manifest.where("k % 31 = 0")).drop("k")
    return ar.checksum_audit(pages.drop("k"), manifest)


def completed_partitions(spark, d):
    orders = src.table(spark, d, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"))
    n = F.month("month") + F.year("month")
    manifest = orders.select("month").distinct().withColumn("status", F.when(n % 5 == 0, "error").when(n % 7 == 0, "empty").otherwise("complete"))
    manifest = manifest.unionByName(manifest.where(F.month("month") == 11))
    return ar.completed_partitions(orders, manifest, "month")


def _indexes(spark, d):
    panel = materialised(spark, d, "panel", lambda: src.panel(spark, d))
    group = F.col("security_id") % 3
    quotes = panel.where("quoted AND (security_id + pos) % 5 <> 0").groupBy(group.alias("index"), "date").agg(F.round(F.avg("close"), 4).alias("close"))
    off = quotes.withColumn("date", F.date_add("date", 1))  # days that are no sessions
    return quotes.where("NOT (index = 1 AND day(date) = 13)").unionByName(off).unionByName(quotes.where("index = 2 AND day(date) = 3"))


def index_context(spark, d):
    gates = spark.createDataFrame([(0, "1980-01-01"), (1, "1997-03-01")], "index long, date string").withColumn("date", F.col("date").cast("date"))
    return _rounded(cx.index_context(_days(spark, d), _indexes(spark, d), gates), 6)


def rate_context(spark, d):
    weeks = src.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))
    rates = weeks.where("top % 7 <> 0").select("date", (F.col("n") % 50 / 10.0).alias("overnight"), (F.col("n") % 70 / 10.0).alias("three_months"), (F.col("n") % 90 / 10.0).alias("twelve_months"))
    return _rounded(cx.rate_context(_days(spark, d), rates), 8)


def reconciled_records(spark, d):
    orders = src.table(spark, d, "orders").select((F.col("o_custkey")).alias("issuer"), F.col("o_orderkey").alias("period"), F.col("o_totalprice").alias("cash"), F.to_date("o_orderdate").alias("ex_date"))
    other = orders.where("period % 5 <> 0").withColumns({"cash": F.when(F.col("period") % 7 == 0, F.col("cash") + 1).otherwise(F.col("cash")), "ex_date": F.when(F.col("period") % 9 != 0, F.col("ex_date"))})
    return _rounded(cx.reconciled_records(orders.where("period % 6 <> 0"), other, ["issuer", "period"], ["cash", "ex_date"]), 4)


def valuation_derived(spark, d):
    rows = src.weekly_bars(spark, d).select("security_id", "date", (F.col("close") / 100 - 11).alias("pe"), (F.col("volume") - 20).alias("pb"), F.when(F.col("security_id") % 7 != 0, F.col("amount") * 3).alias("market_value"), "amount")
    return _rounded(cx.valuation_derived(rows).select("security_id", "date", "ep", "bp", "size", "turnover_proxy"), 6)


def wide_dividends(spark, d):
    """Interim and final texts of orders, some without an amount or a date."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = src.table(spark, d, "orders").select(
        F.col("o_custkey").alias("security_id"), F.year("o_orderdate").alias("year"), F.when(key % 4 != 0, F.concat(F.lit("HK$"), F.format_string("%d.%02d", key % 9, key % 97), F.lit(" on "), day)).alias("interim"),
        F.when(key % 3 == 0, F.lit("no dividend")).when(key % 3 == 1, F.concat(F.lit("ex "), day)).alias("final"),
    )
    found = ing.long_dividends(rows)
    return found.groupBy("security_id", "year", "kind").agg(F.count(F.lit(1)).alias("rows"), F.min("ex_date").alias("ex_date"), F.sum("amount").cast("double").alias("amount"), F.count("amount").alias("amounts"))


def merged_announcements(spark, d):
    rows = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("published_at"), F.concat(F.lit("u"), F.col("o_custkey") % 20).alias("url"), F.array((F.col("o_custkey") % 37).cast("string"), (F.col("o_orderkey") % 5).cast("string")).alias("codes"))
    return ing.merged_announcements(rows).withColumn("codes", F.array_join("codes", ","))


def scanned_range(spark, d):
    """A date range of the panel stored by year, written twice; the scan gets only the range and its columns."""
    root = _place(spark, "years")
    bars = src.weekly_bars(spark, d)
    ing.write_years(bars, root)
    ing.write_years(bars.where("year(date) = 1997"), root)
    return _rounded(ing.base_units(src.scan_range(spark, root, "1996-07-01", "1998-02-01", ["security_id", "date", "close", "volume"]), {"volume": 100.0}), 6)


QUERIES = {f.__name__: f for f in (response_tape, tape_conflicts, request_gaps, drifting_partitions, segmented_scan, checksum_audit, completed_partitions, index_context, rate_context, reconciled_records, valuation_derived, wide_dividends, merged_announcements, scanned_range)}

_OBS = """ob AS (SELECT event_id // 40 AS request_id, 1000000 - event_id // 40 AS seq, event_id, CASE WHEN event_id // 40 % 3 = 0 THEN 'adjusted' ELSE 'raw' END AS kind, lpad((user_id % 50)::VARCHAR, 5, '0') || '.HK' AS code, strftime(ts, '%Y-%m-%d') AS date,
  value AS close, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS volume, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS amount FROM events WHERE event_id % 7 <> 0 AND event_id // 40 % 11 <> 0 AND event_id // 40 % 13 <> 0 AND event_id // 40 % 17 <> 0)"""
_FIELD = "SELECT kind, code, date, request_id, '{f}' AS field, lag({f}) OVER w AS previous, {f} AS new FROM ob WINDOW w AS (PARTITION BY kind, code, date ORDER BY seq, event_id)"
ORACLES = {
    "response_tape": f"""WITH {_OBS} SELECT kind, code, date, round(close, 4) AS close, round(volume, 4) AS volume, round(amount, 4) AS amount, request_id, count(*) OVER (PARTITION BY kind, code, date) AS observations FROM ob
      QUALIFY row_number() OVER (PARTITION BY kind, code, date ORDER BY seq DESC, event_id DESC) = 1""",
    "tape_conflicts": f"WITH {_OBS}, e AS ({' UNION ALL '.join(_FIELD.format(f=f) for f in ar.FIELDS)}) SELECT kind, code, date, request_id, field, round(previous, 4) AS previous, round(new, 4) AS new FROM e WHERE abs(previous - new) > greatest(1e-8 * greatest(abs(previous), abs(new)), 1e-7)",
    "request_gaps": """WITH r AS (SELECT DISTINCT event_id // 40 AS request_id FROM events) SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 'adjusted' ELSE 'raw' END AS kind, CASE WHEN request_id % 11 = 0 THEN 'missing_response' ELSE 'failed_request' END AS reason,
      CASE WHEN request_id % 11 = 0 THEN NULL WHEN request_id % 13 = 0 THEN 500 ELSE 200 END::INT AS status_code FROM r WHERE request_id % 11 = 0 OR request_id % 13 = 0 OR request_id % 17 = 0""",
    "drifting_partitions": "SELECT year(o_orderdate)::INT AS year, o_orderkey, floor(o_totalprice)::DOUBLE AS price, o_custkey AS customer, CASE WHEN year(o_orderdate) > 1996 THEN o_orderstatus END AS o_orderstatus FROM orders",
    "segmented_scan": f"""WITH e AS (SELECT ts::DATE AS date, CASE WHEN ts::DATE < DATE '{_TURN}' THEN '1min' ELSE '60min' END AS frequency, value, event_id % 23 = 0 AS other, event_id % 23 <> 0 AND (ts > date_trunc('day', ts) + CASE WHEN event_id % 19 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL '23:59:59' HOUR END) AS late FROM events WHERE ts::DATE BETWEEN DATE '{_FROM}' AND DATE '{_TO}')
      SELECT date, frequency, count(*) FILTER (NOT other AND NOT late) AS ticks, round(sum(value::DECIMAL(18,4)) FILTER (NOT other AND NOT late)::DOUBLE, 4) AS amount, count(*) FILTER (other) AS other_frequency, count(*) FILTER (late) AS outside FROM e GROUP BY 1, 2""".replace("INTERVAL '23:59:59' HOUR", "INTERVAL 86399 SECOND"),
    "checksum_audit": """WITH p AS (SELECT page_id AS k, 'page-' || page_id AS name, coalesce(html, '') AS html FROM pages), m AS (SELECT CASE WHEN k % 10 = 3 THEN name || '.gone' ELSE name END AS name, CASE WHEN k % 31 = 0 THEN 2 ELSE 1 END AS entries, k % 9 = 0 AS stale FROM p WHERE k % 7 <> 0)
      SELECT coalesce(p.name, m.name) AS name, CASE WHEN entries > 1 THEN 'ambiguous' WHEN p.name IS NULL THEN 'missing' WHEN m.name IS NULL THEN 'extra' WHEN stale THEN 'changed' ELSE 'verified' END AS status, strlen(html)::BIGINT AS bytes FROM p FULL JOIN m ON p.name = m.name""",
    "completed_partitions": """SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE month(o_orderdate) <> 11 AND (month(o_orderdate) + year(o_orderdate)) % 5 <> 0""",
    "index_context": f"""WITH {_PANEL}, q0 AS (SELECT security_id % 3 AS index, date, round(avg(close), 4) AS close FROM panel WHERE quoted AND (security_id + pos) % 5 <> 0 GROUP BY 1, 2), q AS (SELECT * FROM q0 WHERE NOT (index = 1 AND day(date) = 13) AND NOT (index = 2 AND day(date) = 3)),
      g AS (SELECT i.index, d.date, d.pos, CASE WHEN i.index = 0 OR i.index = 1 AND d.date >= DATE '1997-03-01' THEN q.close END AS close FROM (SELECT DISTINCT index FROM q0) i CROSS JOIN days d LEFT JOIN q ON q.index = i.index AND q.date = d.date),
      s AS (SELECT *, ln(close / lag(close) OVER w) AS step FROM g WINDOW w AS (PARTITION BY index ORDER BY pos))
      SELECT index, date, {", ".join(f"round(close / lag(close, {n}) OVER w - 1, 6) AS momentum_{n}" for n in (20, 60, 252))}, round(CASE WHEN count(step) OVER v >= 30 THEN stddev_samp(step) OVER v * sqrt(252::DOUBLE) END, 6) AS volatility_60 FROM s
      WINDOW w AS (PARTITION BY index ORDER BY pos), v AS (PARTITION BY index ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "rate_context": f"""WITH {_PANEL}, r AS (SELECT date_trunc('week', o_orderdate)::DATE AS date, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1), g AS (SELECT d.date, d.pos, n FROM days d LEFT JOIN r ON r.date = d.date AND top % 7 <> 0)
      SELECT date, round(n % 70 / 1000.0::DOUBLE, 8) AS rate, round((n % 70 - lag(n % 70, 20) OVER (ORDER BY pos)) / 1000.0::DOUBLE, 8) AS change_20, round((n % 90 - n % 50) / 1000.0::DOUBLE, 8) AS curve FROM g""",
    "reconciled_records": """SELECT o_custkey AS issuer, o_orderkey AS period, CASE WHEN o_orderkey % 6 = 0 THEN 'second_only' WHEN o_orderkey % 5 = 0 THEN 'first_only' WHEN o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 THEN 'conflict' ELSE 'matched' END AS status,
      CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0 THEN round(o_totalprice, 4) END AS cash, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS ex_date
      FROM orders WHERE o_orderkey % 6 <> 0 OR o_orderkey % 5 <> 0""",
    "valuation_derived": f"""WITH {_PANEL} SELECT security_id, date, round(CASE WHEN close / 100 - 11 > 0 THEN 1 / (close / 100 - 11) END, 6) AS ep, round(CASE WHEN volume > 20 THEN 1 / (volume - 20) END, 6) AS bp, round(CASE WHEN security_id % 7 <> 0 AND amount > 0 THEN ln(amount * 3) END, 6) AS size,
      round(CASE WHEN security_id % 7 <> 0 AND amount > 0 THEN amount / (amount * 3) END, 6) AS turnover_proxy FROM bars""",
    "wide_dividends": """WITH o AS (SELECT o_custkey AS security_id, year(o_orderdate)::INT AS year, o_orderkey AS k, o_orderdate::DATE AS day FROM orders), e AS (SELECT security_id, year, 'interim' AS kind, day AS ex_date, k % 9 + (k % 97) / 100.0 AS amount FROM o WHERE k % 4 <> 0
        UNION ALL SELECT security_id, year, 'final', CASE WHEN k % 3 = 1 THEN day END, NULL FROM o WHERE k % 3 <> 2)
      SELECT security_id, year, kind, count(*) AS rows, min(ex_date) AS ex_date, sum(amount::DECIMAL(18,6))::DOUBLE AS amount, count(amount) AS amounts FROM e GROUP BY 1, 2, 3""",
    "merged_announcements": """WITH e AS (SELECT o_orderdate::DATE AS published_at, 'u' || (o_custkey % 20) AS url, unnest([(o_custkey % 37)::VARCHAR, (o_orderkey % 5)::VARCHAR]) AS c FROM orders) SELECT published_at, url, string_agg(DISTINCT c, ',' ORDER BY c) AS codes FROM e GROUP BY 1, 2""",
    "scanned_range": f"WITH {_PANEL} SELECT security_id, date, round(close, 6) AS close, round(volume * 100, 6) AS volume FROM bars WHERE date >= DATE '1996-07-01' AND date < DATE '1998-02-01'",
}
