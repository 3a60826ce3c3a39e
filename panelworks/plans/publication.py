"""Queries of writers: daily refresh, versioned snapshots, training snapshot, streams, each read back from what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import quality as ql
from panelworks.plans import refresh as rf
from panelworks.plans.panel import _EXAMPLES, _FACTORS, _LEAST_ADV, _RANKS, _core, _days, _panel, _rounded, _versions
from panelworks.sources import publish as pb
from panelworks.sources import tables as src
from panelworks.sources.store import materialised, shared_folder
from panelworks.streaming.ticks import daily_stream
from panelworks.streaming.versions import latest_visible_stream, visible_state

_BACK = 40  # sessions before the last one that are refreshed
_SHOWN = ("momentum_60", "volatility_20", "adv20_amount", "near_high_252", "history_sessions", "sessions_since_quote", "status", "score")


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def daily_refresh(spark, d):
    """Two sessions refreshed one after the other, the first from a state made from scratch."""
    bars = materialised(spark, d, "bars_by_date", lambda: _panel(spark, d).where("quoted").drop("quoted", "pos"), "date")
    days, target = _days(spark, d), _place(spark, "refresh")
    last = days.agg(F.max("pos")).first()[0]
    dates = {r.pos - last + _BACK: str(r.date) for r in days.where(F.col("pos").between(last - _BACK - 1, last - _BACK + 1)).collect()}
    rf._replace(rf.state_of(bars.where(F.col("date") <= F.lit(dates[-1]).cast("date")), days).withColumn("date", F.lit(dates[-1]).cast("date")), f"{target}/state")
    path = bars.inputFiles()[0].split("/date=")[0]
    for i in (0, 1):
        rf.refresh(spark, path, days, target, dates[i], _LEAST_ADV)
    return _rounded(spark.read.parquet(f"{target}/features").select("date", "security_id", *_SHOWN), 6)


def published_snapshots(spark, d):
    """Two versions of a table, the second after a refused one; readers of the first still see it."""
    rows = src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    root = _place(spark, "snapshots")
    pb.publish(rows.where("o_orderkey % 2 = 0"), root, "v1", ["o_orderkey"], {"positive": "o_totalprice > 0"}, {"total": "round(sum(o_totalprice), 2)"})
    pinned = pb.read(spark, root)
    try:
        pb.publish(rows.unionByName(rows), root, "v2", ["o_orderkey"])
    except ValueError:
        pb.publish(rows, root, "v2", ["o_orderkey"])
    both = pinned.withColumn("version", F.lit("v1")).unionByName(pb.read(spark, root).withColumn("version", F.lit("v2")))
    return _rounded(both, 2)


def training_snapshot(spark, d):
    """Examples with their label patches as a version; the entry counts the patched, by horizon, beside what was written."""
    factors = _core(spark, d)
    patches = xs.examples(factors.where("security_id % 6 = 0")).select("date", "security_id", "horizon", F.when(F.col("security_id") % 12 == 0, F.col("label_end")).alias("label_end"), (F.col("horizon") / 100).alias("new_fwd_return"))
    root, horizons = _place(spark, "training"), (1, 5, 20, 60)
    facts = {f"patched_{h}": f"count_if(patched AND horizon = {h})" for h in horizons}
    entry = pb.publish(ql.patched_examples(factors, patches), root, "patched-1", ["date", "security_id", "horizon"], facts=facts, partitions=("horizon",))
    counted = F.create_map(*(x for h in horizons for x in (F.lit(h), F.lit(entry["facts"][f"patched_{h}"]))))
    out = pb.read(spark, root).groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), F.count_if("patched").alias("patched"), F.count("fwd_return").alias("labels"))
    return out.withColumn("entry_patched", counted[F.col("horizon")])


def visible_versions_stream(spark, d):
    """The versions as a stream of unordered files, with one file twice; the state is that of all of them."""
    versions = _versions(spark, d).select("security_id", F.year("period_end").cast("long").alias("event_id"), "published_at", "version", "value")
    folder = _place(spark, "versions")
    versions.repartition(3, "version").write.parquet(f"{folder}/in")
    versions.where("version % 5 = 0").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    latest_visible_stream(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return visible_state(spark, folder, versions)


def daily_bars_stream(spark, d):
    """Ticks as a stream; an extra late tick a code closes the days and has none itself."""
    ticks = src.table(spark, d, "events").select(F.col("user_id").alias("code"), "ts", F.col("value").alias("price"), F.col("event_id").alias("tie"))
    folder = _place(spark, "ticks")
    ticks.repartition(2).write.parquet(f"{folder}/in")
    last = ticks.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("code"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(1.0).alias("price"), F.lit(0).cast("long").alias("tie"))
    last.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{folder}/in")
    bars = daily_stream(stream, "1 day")
    bars.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.read.schema(bars.schema).parquet(f"{folder}/out"), 4)


QUERIES = {f.__name__: f for f in (daily_refresh, published_snapshots, training_snapshot, visible_versions_stream, daily_bars_stream)}

ORACLES = {
    "daily_refresh": f"""WITH {_RANKS}, dt AS (SELECT date FROM days WHERE pos IN (SELECT max(pos) - {_BACK} FROM days UNION ALL SELECT max(pos) - {_BACK} + 1 FROM days))
      SELECT f.date, f.security_id, {", ".join(f"round(f.{c}, 6) AS {c}" for c in _SHOWN[:4])}, f.history_sessions::BIGINT AS history_sessions, f.sessions_since_quote::BIGINT AS sessions_since_quote, f.status, round(s.score, 6) AS score
      FROM f JOIN dt USING (date) JOIN bars b ON b.date = f.date AND b.security_id = f.security_id LEFT JOIN scored s ON s.date = f.date AND s.security_id = f.security_id""",
    "published_snapshots": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, version FROM orders JOIN (VALUES ('v1'), ('v2')) t(version) ON version = 'v2' OR o_orderkey % 2 = 0",
    "training_snapshot": f"""WITH {_FACTORS}, e AS ({_EXAMPLES}), k AS (SELECT *, fwd_return IS NULL AND (security_id % 12 = 0 OR security_id % 6 = 0 AND label_end IS NULL) AS patched FROM e)
      SELECT horizon, count(*) AS rows, count(*) FILTER (patched) AS patched, count(*) FILTER (patched OR fwd_return IS NOT NULL) AS labels, count(*) FILTER (patched) AS entry_patched FROM k GROUP BY 1""",
    "visible_versions_stream": """SELECT o_custkey AS security_id, year(o_orderdate)::BIGINT AS event_id, o_orderdate + to_days((o_orderkey % 90)::INT) AS published_at, o_orderkey AS version, o_totalprice AS value FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate + to_days((o_orderkey % 90)::INT) DESC, o_orderkey DESC) = 1""",
    "daily_bars_stream": """SELECT user_id AS code, ts::DATE AS date, round(arg_min(value, row(ts, event_id)) FILTER (value > 0), 4) AS open, round(arg_max(value, row(ts, event_id)) FILTER (value > 0), 4) AS close,
      round(max(value) FILTER (value > 0), 4) AS high, round(min(value) FILTER (value > 0), 4) AS low, round(CASE WHEN count(value) = count(*) THEN sum(value::DECIMAL(18,4)) END::DOUBLE, 4) AS amount,
      count(*) AS ticks, count(*) FILTER (value < 0) AS negative, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""",
}
