"""Probability calibration against its optimality conditions, and edge cases of dated facts."""

import datetime as dt

import numpy as np

from panelworks.operators import dated, reports


def test_logistic_calibration_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    up = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x - 0.3)))).astype(int)
    rows = [(1 if i % 2 else 5, float(a), int(b)) for i, (a, b) in enumerate(zip(x, up))] + [(9, 1.0, 1), (9, 2.0, 1), (1, None, 1), (1, 0.5, None)]
    fits = {r.horizon: (r.slope, r.intercept) for r in reports.logistic_calibration(spark.createDataFrame(rows, "horizon int, margin double, up int")).collect()}
    assert set(fits) == {1, 5}
    for h, (a, b) in fits.items():
        m = np.array([r[1] for r in rows if r[0] == h and None not in r])
        y = np.array([r[2] for r in rows if r[0] == h and None not in r])
        e = y - 1 / (1 + np.exp(-(a * m + b)))
        assert abs((e * m).sum() - a) < 1e-6 and abs(e.sum()) < 1e-6


def test_empty_calibration(spark):
    assert reports.logistic_calibration(spark.createDataFrame([], "horizon int, margin double, up int")).count() == 0


def test_lot_history_stops_at_a_broken_link(spark):
    day = lambda n: dt.date(2020, 1, n)
    anchors = spark.createDataFrame([(1, 400), (2, 500)], "security_id long, lot int")
    changes = spark.createDataFrame([(1, day(2), 100, 200), (1, day(5), 250, 300), (1, day(9), 300, 400), (2, day(3), 100, 400)], "security_id long, effective date, old_lot int, new_lot int")
    got = {(r.security_id, r.valid_from and r.valid_from.day): (r.lot, r.status) for r in dated.lot_history(anchors, changes).collect()}
    assert got == {(1, None): (None, "open"), (1, 2): (None, "open"), (1, 5): (300, "closed"), (1, 9): (400, "closed"), (2, None): (None, "open"), (2, 3): (None, "open")}


def test_offers_count_strictly_after_their_start(spark):
    day = lambda n: dt.date(2020, 1, n)
    rows = spark.createDataFrame([(1, day(n)) for n in (1, 2, 3, 9)], "security_id long, date date")
    offers = spark.createDataFrame([(1, day(2), day(3))], "security_id long, start date, end date")
    got = {r.date.day: (r.offer_active, r.offer_recent) for r in dated.offer_flags(rows, offers, "2020-01-02").collect()}
    assert got == {1: (None, None), 2: (False, False), 3: (True, True), 9: (False, True)}
