"""Notices, forms, dividend versions and replays on small inputs: refusals, nulls, empty tables, repeated rows."""

import datetime as dt

import pytest

from panelworks.operators import dividends, notices, replays

D = dt.date
RAW = ["source_code", "state", *dividends.DATES, *dividends.NUMBERS, "special", "note"]
PLAIN = {"source_code": "000001.SZ", "state": dividends.FINAL, "end_date": "1999-12-31", "ann_date": "20000301", "imp_ann_date": "2000-05-01", "record_date": "2000-05-10", "ex_date": "2000-05-11", "pay_date": "2000-05-20", "gross": "0.5", "net": "0.4", "stock": "0", "special": "No"}


def raw(spark, *changes):
    rows = [tuple((PLAIN | c).get(k) for k in RAW) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW))


def aliases(spark, *pairs):
    return spark.createDataFrame(list(pairs), "old string, code string")


def judged(spark, *changes, pairs=()):
    good, bad = dividends.judged_dividends(raw(spark, *changes), aliases(spark, *pairs))
    return good.collect(), sorted(r.reasons for r in bad.collect())


def test_equal_versions_merge_and_the_canonical_code_is_kept(spark):
    good, bad = judged(spark, {"source_code": "000002.SZ"}, {}, {}, pairs=[("000002.SZ", "000001.SZ")])
    assert not bad and [(r.security_id, r.source_code, r.sources, r.merged, r.available_from) for r in good] == [("000001.SZ", "000001.SZ", "000001.SZ,000002.SZ", 3, D(2000, 5, 2))]


def test_the_last_version_before_entitlement_counts(spark):
    good, bad = judged(spark, {}, {"imp_ann_date": "2000-05-03", "gross": "0.6"})
    assert [r.gross for r in good] == [0.6] and bad == ["superseded_provider_version"]
    good, bad = judged(spark, {}, {"gross": "0.6"})
    assert not good and bad == ["conflicting_final_versions"] * 2
    good, bad = judged(spark, {}, {"imp_ann_date": None})
    assert not good and bad == ["conflicting_final_versions", "conflicting_final_versions;missing_implementation_publication"]
    good, bad = judged(spark, {}, {"imp_ann_date": "2000-05-03", "gross": "0", "net": None})
    assert not good and bad == ["invalid_final_version", "no_cash_distribution"]


@pytest.mark.parametrize("change, reason", [({"stock": "0.1"}, "missing_stock_distribution_fields"), ({"bonus": "x"}, "inconsistent_stock_distribution"), ({"note": "配股"}, "unsupported_rights_or_differential_event"), ({"gross": "inf"}, "invalid_gross_cash"), ({"pay_date": "2000-02-30"}, "invalid_pay_date"), ({"source_code": "510300.SH"}, "invalid_security_id"), ({"state": None}, "not_implemented")])
def test_reasons_of_single_rows(spark, change, reason):
    good, bad = judged(spark, change)
    assert not good and bad == [reason]


def test_two_ex_dates_of_a_period_are_ambiguous(spark):
    good, bad = judged(spark, {}, {"ex_date": "2000-05-12"})
    assert not good and bad == ["ambiguous_period_schedule"] * 2


def test_no_dividends_and_names_without_rows(spark):
    names = spark.createDataFrame([("000001.SZ",), ("000002.SZ",), ("FUND",)], "security_id string")
    good, coverage = dividends.selected_dividends(raw(spark, {}, {"source_code": "000009.SZ"}), aliases(spark), names, 10)
    assert [r.security_id for r in good.collect()] == ["000001.SZ"]
    assert {r.security_id: (r.status, r.empty, r.schedules) for r in coverage.collect()} == {"000001.SZ": ("complete", 0, 1), "000002.SZ": ("incomplete", 1, 0), "FUND": ("not_a_share", 1, 0)}
    good, bad = dividends.judged_dividends(raw(spark, {}).limit(0), aliases(spark))
    assert good.count() == bad.count() == 0


def test_lot_notices(spark):
    told = "The board lot will change from 1,000 H shares to 2,000 H shares with effect from 9:00 a.m. on Monday, 3 June 1996."
    texts = [told, told + " " + told, told + " The Company proposes that the board lot be from 2 shares to 4 shares.", told.replace("board lot", "name"), None, "", told.replace("3 June", "33 June"), ("x " * 50_000) + told]
    rows = spark.createDataFrame([(i, "t", t, "extra") for i, t in enumerate(texts)], "url int, published_at string, text string, reason string")
    got = {r.url: (r.status, r.effective_date, r.old_lot, r.new_lot, r.reasons) for r in notices.lot_notices(rows).collect()}
    clear = ("candidate_effective", D(1996, 6, 3), 1000, 2000, "")
    assert got[0] == got[1] == got[7] == clear
    assert got[2][4] == "proposed" and got[3][4] == got[4][4] == got[5][4] == "no_single_date,no_single_lot" and got[6][4] == "unreadable_date,no_single_date"
    assert notices.lot_notices(rows.limit(0)).count() == 0


def test_forms_need_the_code_on_both_days(spark):
    master = spark.createDataFrame([("s", "00001.HK", "equity", "verified", D(1990, 1, 1), D(2000, 1, 2)), ("t", "00001.HK", "equity", "verified", D(2000, 1, 2), None)], "security_id string, exchange_code string, asset_type string, identity_status string, valid_from date, valid_to date")
    forms = spark.createDataFrame([(1, "u", "00001", "final", "n", D(1999, 12, 31), D(2000, 1, 5)), (2, "v", "00001", "final", "n", D(1999, 12, 31), D(2000, 1, 5)), (3, "w", "00001", "final", "n", None, None)], "form_id int, url string, code string, kind string, nature string, period_end date, ex_date date")
    # 17:00 UTC is the next day in Hong Kong
    catalog = spark.createDataFrame([("u", dt.datetime(2000, 1, 1, 17), ["00001"]), ("v", dt.datetime(2000, 1, 1, 15), ["00001"])], "url string, published_at timestamp, codes array<string>")
    got = {r.form_id: (r.status, r.security_id, r.event_id) for r in notices.mapped_forms(forms, catalog, master).collect()}
    assert got == {1: ("mapped", "t", "t|final|n|1999-12-31"), 2: ("no_security", None, None), 3: ("no_catalog_line", None, None)}


def test_replayed_periods(spark):
    days = spark.createDataFrame([(D(2000, 1, i),) for i in range(1, 8)], "date date")
    periods = replays.period_groups(spark.createDataFrame([(D(2000, 1, 1), None), (D(2000, 1, 3), None), (D(2000, 1, 7), None)], "date date, exit date"), days)
    assert [(r.entry.day, r.exit and r.exit.day) for r in periods.orderBy("signal").collect()] == [(2, 4), (4, None)]
    chosen = spark.createDataFrame([(D(2000, 1, 1), 1, 1), (D(2000, 1, 1), 2, 2), (D(2000, 1, 3), 1, 1)], "date date, security_id int, place int")
    prices = spark.createDataFrame([(s, D(2000, 1, i), float(i), 1.0 if s == 1 else 0.0) for s in (1, 2) for i in range(1, 8)], "security_id int, date date, close double, volume double")
    months, names, gaps = replays.replayed_periods(chosen, periods, prices, prices, prices.where("security_id = 1 AND day(date) <> 4").select("date", "close"))
    one = months.collect()
    assert [(r.stocks, r.gross_return, r.observable_return, r.turnover, r.benchmark_return) for r in one] == [(2, 1.0, 0.5, 1.0, None)]
    assert names.count() == 2 and {(r.kind, r.date.day) for r in gaps.collect()} == {("missing_benchmark_close", 4)}


def test_open_positions_are_not_closed(spark):
    fills = spark.createDataFrame([("a", 1, D(2000, 1, 1), "buy", 2.0, 10.0, 1.0), ("a", 1, D(2000, 1, 2), "sell", 2.0, 14.0, 1.0), ("a", 2, D(2000, 1, 1), "buy", 2.0, 10.0, 1.0), ("b", 3, D(2000, 1, 1), "sell", 1.0, 1.0, 0.0)], "account string, position int, date date, side string, units double, value double, fee double")
    got = replays.closed_positions(fills)
    assert [(r.position, r.cost, r.proceeds, r.won, r.first_cohort) for r in got.collect()] == [(1, 11.0, 13.0, True, True)]
    assert replays.cohort_figures(got, 100.0).first().cash_after == 102.0
