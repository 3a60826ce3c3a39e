"""Writers and streams: restarts, failed writes, pinned readers, refresh, drifting files, checksums; and edge cases of figures."""

import datetime as dt
import hashlib
import math
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panelworks.functions.normal import inverse_normal
from panelworks.operators import actions as ac
from panelworks.operators import archives as ar
from panelworks.operators import books as bk
from panelworks.operators import evaluation as ev
from panelworks.operators import features as fe
from panelworks.operators import history as hi
from panelworks.operators import intake as it
from panelworks.operators import models as md
from panelworks.operators import reports as rp
from panelworks.plans import refresh as rf
from panelworks.sources import publish as pb
from panelworks.sources import store
from panelworks.streaming import versions as sv

DAY = dt.date(2020, 1, 6)


def panel_of(spark, closes, security_id=1):
    rows = [(security_id, DAY + dt.timedelta(i), i, c, c, c, c, 1.0, 1.0, True, True) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "security_id long, date date, pos int, open double, high double, low double, close double, amount double, volume double, quote_present boolean, data_valid boolean")


# ---- published versions


def test_failed_writes_are_never_visible(spark, tmp_path):
    root, rows = str(tmp_path / "t"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    first = pb.publish(rows, root, "v1", ["k"], {"positive": "v > 0"}, {"total": "sum(v)"})
    assert first["rows"] == 2 and first["facts"] == {"total": 5.0}
    held = pb.read(spark, root)
    for bad, name, rules in ((rows.unionByName(rows), "v2", {}), (rows.limit(0), "v2", {}), (rows, "v1", {}), (rows, "../x", {}), (rows, "v2", {"small": "v < 3"}), (rows.withColumn("k", F.lit(None).cast("long")), "v2", {})):
        with pytest.raises(ValueError):
            pb.publish(bad, root, name, ["k"], rules)
    broken = rows.withColumn("v", F.expr("CASE WHEN k = 2 THEN raise_error('stop') ELSE v END").cast("double"))
    with pytest.raises(Exception, match="stop"):
        pb.publish(broken, root, "v2", ["k"])
    assert [e["version"] for e in pb.entries(spark, root)] == ["v1"] and pb.read(spark, root).count() == 2
    assert pb.remove_unpublished(spark, root) >= 4
    pb.publish(rows.where("k = 1"), root, "v2", ["k"])
    assert held.count() == 2 and pb.read(spark, root).count() == 1 and pb.read(spark, root, "v1").count() == 2
    with pytest.raises(LookupError):
        pb.read(spark, root, "v3")


def test_a_taken_log_number_is_refused(spark, tmp_path):
    root, rows = str(tmp_path / "t"), spark.createDataFrame([(1,)], "k long")
    entry = pb.publish(rows, root, "v1", ["k"])
    with pytest.raises(Exception):
        pb._append(spark, root, 0, entry | {"version": "other"})
    assert [e["version"] for e in pb.entries(spark, root)] == ["v1"]


# ---- streams


def test_repeated_and_late_batches_give_the_batch_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sv, "WHOLE", 3)
    schema = "security_id long, event_id long, published_at timestamp, version long, value double"
    at = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    rows = [(i % 5, i % 7, at(i * 37 % 200), i, float(i)) for i in range(140)]
    path, batches = str(tmp_path / "s"), [rows[i : i + 14] for i in range(0, 140, 14)]
    for n, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, schema)
        sv.merge_batch(frame, n, path)
        if n in (2, 6):
            sv.merge_batch(frame, n, path)  # a batch that ran again after a failure
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, sv.newest(whole).collect()))
    assert sorted(map(tuple, sv.visible_state(spark, path, whole).collect())) == want
    assert len(sv._finished(spark, path)) <= 2 * sv.WHOLE + 1
    assert sv.visible_state(spark, str(tmp_path / "none"), whole).count() == 0


def test_a_restarted_stream_goes_on(spark, tmp_path):
    schema = "security_id long, event_id long, published_at timestamp, version long, value double"
    rows = spark.createDataFrame([(1, 1, dt.datetime(2020, 1, i), i, float(i)) for i in range(1, 9)], schema)
    for part in ("version <= 4", "version > 4"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = sv.latest_visible_stream(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
    assert [r.version for r in sv.visible_state(spark, str(tmp_path / "state"), rows).collect()] == [8]


# ---- daily refresh


def test_refresh_equals_a_rebuild_and_reads_its_window_only(spark, tmp_path):
    n = rf.REACH + 30
    bars = None
    for s in (1, 2, 3):
        closes = [100.0 + (i * 7 * s) % 23 + s for i in range(n)]
        rows = panel_of(spark, closes, s).where("security_id <> 2 OR pos % 3 <> 0").where(f"security_id <> 3 OR pos > {n - 5}")
        bars = rows if bars is None else bars.unionByName(rows)
    days = bars.select("date", "pos").distinct().cache()
    path, target = str(tmp_path / "bars"), str(tmp_path / "out")
    bars.drop("pos").repartition("date").write.partitionBy("date").parquet(path)
    dates = {r.pos: str(r.date) for r in days.collect()}
    stored = spark.read.parquet(path)
    with pytest.raises(ValueError, match="state"):
        rf.refresh(spark, path, days, target, dates[n - 2])
    rf._replace(rf.state_of(stored.where(F.col("date") <= F.lit(dates[n - 3]).cast("date")), days).withColumn("date", F.lit(dates[n - 3]).cast("date")), f"{target}/state")
    for p in (n - 2, n - 1, n - 1):
        rf.refresh(spark, path, days, target, dates[p])
    from panelworks.sources.tables import dense_panel

    whole = fe.price_factors(dense_panel(stored), days)
    for p in (n - 2, n - 1):
        shown = ["security_id", "history_sessions", "sessions_since_quote", "status", "momentum_252", "volatility_60", "near_high_252"]
        here = F.col("date") == F.lit(dates[p]).cast("date")
        quoted = whole.join(stored.select("security_id", "date"), ["security_id", "date"], "left_semi")
        want = sorted(map(tuple, quoted.where(here).select(*shown).collect()))
        got = sorted(map(tuple, spark.read.parquet(f"{target}/features").where(here).select(*shown).collect()))
        assert got == want and len(got) >= 2
    read, _ = rf.recent_bars(spark, path, days, dates[n - 1])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan.split("PartitionFilters")[1][:200]
    assert read.select("date").distinct().count() == rf.REACH


def test_stored_tables_follow_their_input(spark, tmp_path):
    source = str(tmp_path / "x.parquet")
    make = lambda: spark.read.parquet(source)
    spark.range(3).write.parquet(source)
    assert store.materialised(spark, str(tmp_path), "n", make).count() == 3
    import time

    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert store.materialised(spark, str(tmp_path), "n", make).count() == 5
    assert store.release(spark, str(tmp_path)) == 2 and store.release(spark, str(tmp_path)) == 0


# ---- archives


def test_nested_lists_are_flattened_in_order(spark):
    rows = spark.createDataFrame([('[{"a": "[1]"}, [[{"a": 2}], {"a": 3}], {"a": [4]}]',), ("[]",), ('{"a": 5}',), (None,)], "j string")
    assert [r[0] for r in rows.select(ar.flat_objects(F.col("j"))).collect()] == [['{"a":"[1]"}', '{"a":2}', '{"a":3}', '{"a":[4]}'], [], ['{"a": 5}'], [None]]


def test_drifting_types_widen_and_narrowing_is_refused(spark, tmp_path):
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    spark.range(2).selectExpr("CAST(id AS INT) AS a", "CAST(id AS FLOAT) AS b", "CAST(id AS DECIMAL(5, 2)) AS c").write.parquet(one)
    spark.range(2).selectExpr("id + 5000000000 AS a", "CAST(id AS DOUBLE) / 3 AS b", "CAST(id AS DECIMAL(8, 4)) AS c", "'x' AS d").write.parquet(two)
    rows = ar.read_drifting(spark, [one, two])
    assert [t for _, t in rows.dtypes] == ["bigint", "double", "decimal(8,4)", "string"]
    assert sorted(r.a for r in rows.collect()) == [0, 1, 5000000000, 5000000001] and rows.where("d IS NULL").count() == 2
    spark.range(2).selectExpr("CAST(id AS STRING) AS a").write.parquet(three)
    with pytest.raises(ValueError, match="a: "):
        ar.read_drifting(spark, [one, two, three])
    from pyspark.sql.types import DoubleType, LongType

    assert ar.wider(LongType(), DoubleType()) is None


def test_segments_prune_the_scan(spark, tmp_path):
    rows = spark.range(20).selectExpr("date_add(DATE '2020-01-01', CAST(id AS INT)) AS date", "id AS code", "CAST(date_add(DATE '2020-01-01', CAST(id AS INT)) AS TIMESTAMP) AS ts", "'a' AS freq")
    rows = rows.withColumns({"requested_from": F.col("ts"), "requested_to": F.col("ts")})
    for name in ("x", "y"):
        rows.write.partitionBy("date").parquet(str(tmp_path / name))
    segments = [{"folder": str(tmp_path / n), "frequency": f, "first": a, "last": b} for n, f, a, b in (("x", "a", "2020-01-01", "2020-01-10"), ("y", "b", "2020-01-11", "2020-02-01"))]
    found = ar.segmented_scan(spark, segments, "2020-01-09", "2020-01-12")
    assert [(r.frequency, r.problem) for r in found.orderBy("date").collect()] == [("a", None)] * 2 + [("b", "frequency_mismatch")] * 2
    assert ar.segmented_scan(spark, segments, "2020-01-02", "2020-01-03")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError, match="no segment"):
        ar.segmented_scan(spark, segments, "2021-01-01", "2021-01-02")
    with pytest.raises(ValueError, match="overlap"):
        ar.segmented_scan(spark, [segments[0], segments[0]], "2020-01-01", "2020-01-02")


def test_files_are_held_against_their_manifest(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "three")):
        (tmp_path / name).write_text(text)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", digest("one").upper()), ("b", digest("TWO")), ("d", digest("four"))], "name string, sha256 string")
    found = ar.checksum_audit(ar.files_of(spark, str(tmp_path)), manifest).collect()
    assert {(r.name, r.status, r.bytes) for r in found} == {("a", "verified", 3), ("b", "changed", 3), ("c", "extra", 5), ("d", "missing", None)}


# ---- history


def test_a_revision_changes_later_rows_only(spark):
    closes = [100.0] * 4 + [90.0] * 80
    panel = panel_of(spark, closes).select("security_id", "date", "pos", "close")
    days = panel.select("date", "pos")
    day = lambda i: DAY + dt.timedelta(i)
    at = lambda i, h: dt.datetime.combine(day(i), dt.time(h))
    schema = "security_id long, event_id long, published_at timestamp, version long, ex_date date, cash decimal(12,4), currency string, final boolean"
    versions = spark.createDataFrame([(1, 1, at(1, 12), 1, day(4), Decimal(5), "A", True), (1, 1, at(6, 20), 2, day(4), Decimal(10), "A", True)], schema)
    rows = {r.pos: r for r in hi.history_asof(panel, versions, days, str(day(83)), "A").join(days, "date").collect()}
    assert rows[5].momentum_5 == pytest.approx(90 / 95 - 1)  # as first announced
    assert rows[6].momentum_5 == pytest.approx(90 / 95 - 1)  # after 19 o'clock: not yet
    assert rows[7].momentum_5 == pytest.approx(0)
    assert rows[1].fwd_return_5 == pytest.approx(90 / 95 - 1) and rows[2].fwd_return_5 == pytest.approx(0)
    assert rows[83].label_state_1 == "no_completed_horizon" and rows[3].label_state_1 == "available_at_horizon_end"
    early = {r.pos: r for r in hi.history_asof(panel, versions, days, str(day(6)), "A").join(days, "date").collect()}
    assert sorted(early) == list(range(7)) and early[3].label_state_5 == "not_mature" and early[5].momentum_5 == rows[5].momentum_5
    odd = versions.withColumn("currency", F.when(F.col("version") == 2, "B").otherwise("A"))
    rows = {r.pos: r for r in hi.history_asof(panel, odd, days, str(day(83)), "A").join(days, "date").collect()}
    assert rows[6].status == "insufficient_history" and rows[7].status == "adjustment_unresolved" and rows[7].momentum_5 is None and rows[9].momentum_5 is not None
    assert hi.history_asof(panel, versions.limit(0), days, str(day(83)), "A").where("status = 'adjustment_unresolved'").count() == 0


# ---- figures at the edge


def test_constant_growth_has_no_skew(spark):
    for growth in (1.002, 1.03):
        rows = fe.price_factors(panel_of(spark, [100 * growth**i for i in range(120)]), panel_of(spark, [1.0] * 120).select("date", "pos"))
        assert rows.where("return_skew_60 IS NOT NULL").count() == 0


def test_zero_denominators_are_missing(spark):
    curves = spark.createDataFrame([("a", DAY, 0.0), ("a", DAY + dt.timedelta(1), 1.0), ("b", DAY, 1.0)], "k string, date date, curve double")
    found = {r.k: r for r in rp.curve_metrics(curves, "k").collect()}
    assert found["a"].growth is None and found["b"].growth == 0 and found["b"].session_cagr is None
    ic = spark.createDataFrame([("k", 1, DAY, 0.5), ("k", 1, DAY + dt.timedelta(1), 0.5)], "kind string, horizon int, date date, rank_ic double")
    assert ev.ic_table(ic).first().ratio is None
    flat = panel_of(spark, [0.0, 1.0, 2.0]).withColumn("segment", F.lit(0)).withColumn("broken", F.lit(False))
    assert [r.momentum for r in ac.segment_momentum(flat, 1).orderBy("date").collect()] == [None, None, 1.0]
    train = spark.createDataFrame([("h", 0.0, 1.0, 1.0)], "horizon string, weight double, score double, fwd_return double")
    assert md.affine(train, "horizon").first().intercept is None
    book = spark.createDataFrame([(DAY, DAY, DAY, 0.1, 1.0, 0)], "signal date, entry date, exit date, gross_return double, hit_rate double, missing long")
    assert bk.summary(book).first().cagr is None


def test_normal_values(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.075, 0.2, 0.5, 0.77, 0.9251, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select(inverse_normal(F.col("p"))).collect()]
    assert got[-3:] == [None] * 3
    for p, x in zip(ps, got):
        assert math.isclose(x, statistics.NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-12)


def test_share_codes(spark):
    codes = ["600000.SH", "688001.SH", "689009.SH", "680001.SH", "000001.SZ", "300001.SZ", "430001.BJ", "830001.BJ", "920001.BJ", "930001.BJ", "510050.SH", "60000.SH", "600000.SHX", None]
    found = it.listed_shares(spark.createDataFrame([(c,) for c in codes], "code string"))
    assert [r.code for r in found.collect()] == ["600000.SH", "688001.SH", "689009.SH", "000001.SZ", "300001.SZ", "430001.BJ", "830001.BJ", "920001.BJ"]
