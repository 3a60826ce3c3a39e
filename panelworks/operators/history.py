"""Point-in-time history: every row at its own cutoff, every label at the information of its horizon's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.dates import position_from
from panelworks.functions.rolling import rolling
from panelworks.functions.windows import sessions

MOMENTA = (5, 20, 60, 120, 252)
VOLATILITIES = (20, 60, 252)
HORIZONS = (1, 5, 20, 60)
CLOSING_HOUR = 19
LONGEST = 252


def information_spans(versions: DataFrame, days: DataFrame, currency: str) -> DataFrame:
    """(security_id, event_id, ex_date, cash, reason, x, is_session, start, stop): when each version of an event takes effect.

    ``versions`` (security_id, event_id, published_at, version, ex_date, cash, currency, final). A version is visible from
    the session of its publication (the next one after CLOSING_HOUR) to that of the event's next version, and acts from its
    ex-session ``x`` on; positions are half-open, a null ``stop`` is open. Versions that never act are left out. ``reason``
    says why a version cannot be applied. A version without ex_date acts at once, on the whole past.
    """
    late = F.col("published_at") > F.date_trunc("day", "published_at") + F.make_interval(hours=F.lit(CLOSING_HOUR))
    seen = versions.withColumn("available", F.date_add(F.to_date("published_at"), late.cast("int")))
    seen = position_from(seen, days, "available", "visible").where("visible IS NOT NULL")
    along = Window.partitionBy("security_id", "event_id").orderBy("published_at", "version")
    spans = seen.withColumn("stop", F.lead("visible").over(along)).where("stop IS NULL OR visible < stop")
    spans = position_from(spans, days, "ex_date", "x").where("ex_date IS NULL OR x IS NOT NULL")
    spans = spans.join(days.select(F.col("date").alias("ex_date"), F.col("pos").alias("_own")), "ex_date", "left")
    spans = spans.withColumns({"start": F.greatest("visible", "x"), "is_session": F.col("_own").isNotNull()}).where("stop IS NULL OR start < stop")
    reason = (
        F.when(F.col("ex_date").isNull(), "unknown_ex_date").when(~F.coalesce("final", F.lit(False)), "cash_amount_not_final")
        .when(~F.col("currency").eqNullSafe(F.lit(currency)), "cash_currency_mismatch").when(F.col("cash").isNull() | (F.col("cash") < 0), "invalid_cash_amount")
        .when(~F.col("is_session") | (F.col("x") == 0), "missing_prior_calendar_session")
    )
    return spans.withColumn("reason", reason).select("security_id", "event_id", "ex_date", "cash", "reason", "x", "is_session", "start", "stop")


def ex_session_states(spans: DataFrame, panel: DataFrame) -> DataFrame:
    """(security_id, x, start, stop, g, r, reason): what is known of each ex-session over stretches of unchanged information.

    All events of an ex-session act together: ``g`` is log((P - cash) / P) of their whole cash and the close P of the session
    before, ``r`` the raw log return of the ex-session. One bad event spoils its session; ``reason`` is the least of them, or
    the session's own.
    """
    change = [("start", 1), ("stop", -1)]
    marks = F.array(*(F.struct(F.col(c).alias("at"), F.lit(sign).alias("sign")) for c, sign in change))
    rows = spans.select("security_id", F.coalesce("x", F.lit(-1)).alias("x"), "cash", "reason", F.explode(marks).alias("m")).where("m.at IS NOT NULL")
    good = F.col("reason").isNull()
    steps = rows.groupBy("security_id", "x", F.col("m.at").alias("start")).agg(
        F.sum(F.when(good, F.col("cash") * F.col("m.sign")).otherwise(F.lit(0))).alias("cash"), F.sum("m.sign").alias("live"),
        F.sum(F.when(good, 0).otherwise(F.col("m.sign"))).alias("bad"), F.min("reason").alias("reason"),
    )
    along = Window.partitionBy("security_id", "x").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    states = steps.withColumns({c: F.sum(c).over(so_far) for c in ("cash", "live", "bad")} | {"stop": F.lead("start").over(along)})
    states = states.withColumn("why", F.last("reason", True).over(so_far)).where("live > 0")
    close = panel.select("security_id", "pos", "close")
    met = states.join(close.select("security_id", (F.col("pos") + 1).alias("x"), F.col("close").alias("p")), ["security_id", "x"], "left")
    met = met.join(close.select("security_id", F.col("pos").alias("x"), F.col("close").alias("c")), ["security_id", "x"], "left")
    cash = F.col("cash").cast("double")
    reason = F.when(F.col("bad") > 0, F.col("why")).when(~F.coalesce(F.col("p") > 0, F.lit(False)), "missing_prior_session_close").when(cash >= F.col("p"), "nonpositive_theoretical_factor")
    met = met.withColumn("reason", reason)
    g = F.when(F.col("reason").isNull(), F.log((F.col("p") - cash) / F.col("p")))
    return met.select("security_id", "x", "start", "stop", g.alias("g"), F.when((F.col("p") > 0) & (F.col("c") > 0), F.log(F.col("c") / F.col("p"))).alias("r"), "reason")


def _steps(states: DataFrame) -> DataFrame:
    """(security_id, pos, ...): by how much each feature's correction changes at a position.

    A state counts for a feature of n sessions at t in [start, min(stop, x + n)): sums over states become running sums over t.
    """
    windows = sorted({*MOMENTA, *VOLATILITIES, *HORIZONS})
    ends = F.explode(F.array(*map(F.lit, windows))).alias("n")
    rows = states.select("*", ends).withColumn("end", F.when(F.col("x") < 0, F.col("stop")).otherwise(F.least("stop", F.col("x") + F.col("n")))).where("end IS NULL OR start < end")
    mark = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("sign")))).alias("m")
    rows = rows.select("security_id", "n", "g", "r", mark).where("m.pos IS NOT NULL")
    sign, g, r = F.col("m.sign"), F.coalesce("g", F.lit(0.0)), F.col("r")
    parts = {"g": g * sign, "open": F.when(F.col("g").isNull(), sign).otherwise(0)}
    squares = {"s": F.when(r.isNull(), 0.0).otherwise(g * sign), "q": F.when(r.isNull(), 0.0).otherwise((g * g - 2 * r * g) * sign)}
    sums = [F.sum(F.when(F.col("n") == n, v)).alias(f"{c}_{n}") for n in windows for c, v in (parts | (squares if n in VOLATILITIES else {})).items()]
    return rows.groupBy("security_id", F.col("m.pos").alias("pos")).agg(*sums)


def history_asof(panel: DataFrame, versions: DataFrame, days: DataFrame, cutoff: str, currency: str) -> DataFrame:
    """Features and labels of every row, each with the versions visible at its own session's close.

    ``panel`` (security_id, date, pos, close) is dense, ``days`` (date, pos) the calendar. A feature of n sessions at t adjusts
    for the events between t - n and t as they were known at t; a label of h sessions at t is the momentum of h sessions at its end,
    so later revisions are never filled back. Nothing is rebuilt a day: stretches of unchanged information give steps, and
    running sums of steps give each row's corrections, in one order by security. Where an event cannot be applied, features
    and labels that span it are null, and the row is ``adjustment_unresolved`` while it is within LONGEST sessions (for good,
    if its ex-date is unknown). Extremes and means of adjusted prices are not given: they are no sums over events.
    """
    panel = panel.where(F.col("date") <= F.lit(cutoff).cast("date")).select("security_id", "date", "pos", "close")
    w = sessions()
    raw = panel.withColumn("r", F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w))))
    raw = raw.withColumns({"r2": F.col("r") * F.col("r"), "one": F.col("r").isNotNull().cast("double")})
    sums = {f"_{c}_{n}": (c, "sum", n) for n in VOLATILITIES for c in ("r", "r2", "one")}
    steps = _steps(ex_session_states(information_spans(versions, days, currency), panel))
    changes = [c for c in steps.columns if c not in ("security_id", "pos")]
    both = rolling(raw, sums).withColumn("row", F.lit(1)).unionByName(steps.withColumn("row", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("security_id").orderBy("pos", "row").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in changes}).where("row = 1")
    found = {}
    for n in sorted({*MOMENTA, *HORIZONS}):
        old = F.lag("close", n).over(w)
        found[f"momentum_{n}"] = F.when((F.col(f"open_{n}") == 0) & (old > 0), F.col("close") / (old * F.exp(f"g_{n}")) - 1)
    for n in VOLATILITIES:
        k, total, squares = F.col(f"_one_{n}"), F.col(f"_r_{n}") - F.col(f"s_{n}"), F.col(f"_r2_{n}") + F.col(f"q_{n}")
        spread = F.sqrt(F.greatest(squares - total * total / k, F.lit(0.0)) / (k - 1)) * F.sqrt(F.lit(252.0))
        found[f"volatility_{n}"] = F.when((F.col(f"open_{n}") == 0) & (k >= max(12, n // 2)), spread)
    quotes = F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    status = F.when(F.col(f"open_{LONGEST}") > 0, "adjustment_unresolved").when(F.col("close").isNull(), "data_issue").when(quotes < 60, "insufficient_history").otherwise("ok")
    out = both.withColumns(found | {"status": status})
    last = F.broadcast(days.agg(F.max("pos").alias("_last")))  # one row
    out = out.crossJoin(last)
    for h in HORIZONS:
        ends = days.select((F.col("pos") - h).alias("pos"), F.col("date").alias(f"label_end_{h}"))
        out = out.join(ends, "pos", "left").withColumn(f"fwd_return_{h}", F.lead(f"momentum_{h}", h).over(w))
        due = F.col(f"label_end_{h}") <= F.lit(cutoff).cast("date")
        state = F.when(F.col("pos") + h > F.col("_last"), "no_completed_horizon").when(~due, "not_mature").when(F.col(f"fwd_return_{h}").isNotNull(), "available_at_horizon_end")
        out = out.withColumn(f"label_state_{h}", state.otherwise("unresolved_price_adjustment_or_fx"))
    return out.select(
        "security_id", "date", "status", *(f"momentum_{n}" for n in MOMENTA), *(f"volatility_{n}" for n in VOLATILITIES),
        *(f"{c}_{h}" for h in HORIZONS for c in ("label_end", "fwd_return", "label_state")),
    )


def cash_actions(versions: DataFrame, cutoff) -> DataFrame:
    """The events known at the cutoff as cash actions; ``reason`` tells why one isn't, null accepts it.

    ``versions`` also has verified, source_conflict, payable, payment_kind, payment_date, scrip and scrip_default. Units are taken
    at an ex-date that was public before it: the version seen last before the ex-date must name the same one.
    """
    key = ["security_id", "event_id"]
    order = F.struct("published_at", "version")
    seen = versions.where(F.col("published_at") <= F.lit(cutoff).cast("timestamp"))
    facts = [c for c in versions.columns if c not in key]
    last = seen.groupBy(*key).agg(F.max_by(F.struct(*facts), order).alias("f")).select(*key, "f.*")
    asked = last.where("ex_date IS NOT NULL").select(*key, F.col("ex_date").alias("ex"))
    before = versions.join(asked, key).where("published_at < ex").groupBy(*key).agg(F.max_by(F.struct("ex_date"), order).alias("early"))
    met = last.join(before, key, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("ex_date").isNull() | F.col("payment_date").isNull() | (F.col("payment_date") < F.col("ex_date")), "invalid_entitlement_or_payment_date")
        .when(~yes(F.col("verified")) | ~yes(~F.col("source_conflict")), "unresolved_source_evidence").when(~yes(F.col("final")) | ~yes(F.col("payable")), "cash_schedule_not_final")
        .when(~F.col("payment_kind").eqNullSafe(F.lit("specified")), "payment_date_not_exact").when(yes(F.col("scrip")) & ~F.col("scrip_default").eqNullSafe(F.lit("Cash")), "cash_election_not_established")
        .when(~F.col("early.ex_date").eqNullSafe(F.col("ex_date")), "ex_date_not_known_before_entitlement").when(F.col("cash").isNull() | (F.col("cash") < 0), "invalid_cash_amount")
    )
    return met.select(*key, reason.alias("reason"), "ex_date", "payment_date", "published_at", F.when(reason.isNull(), F.col("cash")).alias("cash"), "currency")
