"""Readers of vendor formats and refusing operators on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.functions.order import equal_bins, positions
from panelworks.operators import models, quality
from panelworks.sources import ingest
from panelworks.streaming.ticks import daily_stream


def chart(symbol, **changes):
    arrays = {"open": [1.0, 2.0], "high": [2.0, 2.5], "low": [0.5, 3.0], "close": [1.5, 2.2], "volume": [10.0, None]} | changes
    return json.dumps({"chart": {"result": [{"meta": {"symbol": symbol, "currency": "USD", "exchangeTimezoneName": "America/New_York"}, "timestamp": [1704205800, 1704292200], "indicators": {"quote": [arrays], "adjclose": [{"adjclose": [1.4, 2.1]}]}}]}})


def test_chart_bars(spark):
    rows = ingest.chart_bars(spark.createDataFrame([("A", chart("A")), ("B", chart("C")), ("D", "{}"), ("E", chart("E", close=[1.0]))], "symbol string, json string")).collect()
    got = {(r.security_id, str(r.date)): (r.quote_present, r.data_valid, r.problem) for r in rows}
    assert got == {("A", "2024-01-02"): (True, True, None), ("A", "2024-01-03"): (False, False, None), ("B", "None"): (False, False, "symbol_mismatch"), ("D", "None"): (False, False, "no_history"), ("E", "None"): (False, False, "array_lengths")}


def test_csv_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,value,unit\n1,2.5,share\n2,x,share\n3,1.0,\n")
    good, gaps = ingest.csv_records(spark, str(tmp_path / "f.csv"), "id int, value double, unit string", {"unit": "unit IS NOT NULL"})
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reasons for r in gaps.collect()} == {2: ["malformed"], 3: ["unit"]}


def test_quotations(spark):
    text = ["* 5 HSBC HLDG 60.10 60.20 61.00 1,000", "60.15 60.10 59.90 60,200.5", "", "  823 LINK TRADING SUSPENDED", "11# HANG SENG 100.0 N/A - -", "100.0 - - -", "7 LONE LINE 1 2 3 4"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "document string, line_no int, value string")
    got = {r.code: r for r in ingest.quotations(lines).collect()}
    assert {k: r.status for k, r in got.items()} == {"00005": "reported_trade", "00823": "exchange_reported_suspension", "00011": "no_reported_trade", "00007": "malformed"}
    assert got["00005"].volume == 1000 and got["00005"].vwap == pytest.approx(60.2005) and got["00011"].ask is None


def test_dividends_and_announcements(spark):
    wide = spark.createDataFrame([(1, 2020, "ex 2020-05-01 cash 0.25", None), (1, 2021, "none", "0.5 on 2021-13-45")], "security_id int, year int, interim string, final string")
    got = {(r.year, r.kind): (str(r.ex_date), r.amount and float(r.amount)) for r in ingest.long_dividends(wide).collect()}
    assert got == {(2020, "interim"): ("2020-05-01", 0.25), (2021, "interim"): ("None", None), (2021, "final"): ("None", 0.5)}
    notes = spark.createDataFrame([("t", "u", ["b", "a"]), ("t", "u", ["a", "c"])], "published_at string, url string, codes array<string>")
    assert [r.codes for r in ingest.merged_announcements(notes).collect()] == [["a", "b", "c"]]


def test_write_years_replaces_only_written_years(spark, tmp_path):
    rows = spark.sql("SELECT DATE '2020-01-01' AS date, 1 AS security_id UNION ALL SELECT DATE '2021-01-01', 1")
    ingest.write_years(rows, str(tmp_path / "p"))
    ingest.write_years(rows.where("date > '2020-06-01'").withColumn("security_id", F.lit(2)), str(tmp_path / "p"))
    assert sorted((r.year, r.security_id) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(2020, 1), (2021, 2)]


def test_refusals(spark):
    with pytest.raises(ValueError):
        quality.alias_closure(spark.createDataFrame([(1, 2), (2, 1)], "old int, new int"))
    rows = spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(ValueError):
        quality.with_gap_fills(rows, rows, ["k"])
    with pytest.raises(ValueError):
        quality.append_versions(rows, rows.withColumn("v", F.lit(6)), ["k"])


def test_positions_and_bins(spark):
    values = np.random.default_rng(1).normal(size=103).round(1)
    rows = spark.createDataFrame([(0, float(v), i) for i, v in enumerate(values)], "g int, v double, i int")
    placed = positions(rows, ("g",), "v", ("i",), 0.5).withColumn("bin", equal_bins(F.col("position"), F.col("n"), 10)).orderBy("position").collect()
    assert [r.i for r in placed] == sorted(range(103), key=lambda i: (values[i], i))
    assert [r.bin for r in placed] == [b + 1 for b, part in enumerate(np.array_split(np.arange(103), 10)) for _ in part]


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(200, 3)), rng.uniform(0.5, 2, 200)
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=200)
    rows = spark.createDataFrame([(*map(float, r), float(t), float(k)) for r, t, k in zip(x, y, w)], "a double, b double, c double, y double, weight double")
    fit = models.ridge(rows, ["a", "b", "c"], "y", 10.0)
    m = np.average(x, axis=0, weights=w)
    s = np.sqrt(np.average((x - m) ** 2, axis=0, weights=w))
    z, t = (x - m) / s, y - np.average(y, weights=w)
    assert np.allclose(fit["coef"], np.linalg.solve(z.T @ (z * w[:, None]) + 10 * np.eye(3), z.T @ (w * t)))


def test_daily_stream_closes_days(spark, tmp_path):
    ticks = spark.sql("SELECT 1 AS code, timestamp_seconds(1704067200 + id * 3600) AS ts, CAST(id AS DOUBLE) AS price FROM range(96)")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    run = daily_stream(stream, "1 hour").writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {str(r.date): (r.ticks, r.high) for r in spark.table("days").collect()} == {f"2024-01-0{i + 1}": (24, 24 * i + 23.0) for i in range(3)}
