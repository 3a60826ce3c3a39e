"""Evidence against data: dated proofs, action terms, lots, cleaned quotes, and figures that contradict their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _yes(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def dated_evidence(bars: DataFrame, proofs: DataFrame, rates: DataFrame) -> DataFrame:
    """Bars whose identity a proof of that very day establishes, priced in the reporting currency.

    ``bars`` (security_id, date, raw_close, volume, amount, adj_close); ``proofs`` (security_id, date, raw_close, volume, amount, issue, currency), unique
    by key; ``rates`` (date, currency, rate), HKD is 1. A proof must repeat the bar's figures exactly: ``verdict`` is verified, differs_from_bar,
    rate_missing (verified, but not priced) or no_proof. Only verified bars get issue, currency and reporting prices.
    """
    facts = ("raw_close", "volume", "amount")
    told = proofs.select("security_id", "date", F.struct(*facts, "issue", "currency").alias("p"))
    rows = bars.join(told, ["security_id", "date"], "left")
    same = F.lit(True)
    for c in facts:
        same &= _yes(F.col(c) == F.col(f"p.{c}"))
    rows = rows.withColumns({"identity_verified": F.col("p").isNotNull() & same, "currency": F.when(same, F.col("p.currency"))})
    rows = rows.join(rates, ["date", "currency"], "left").withColumn("fx", F.when(F.col("currency") == "HKD", 1.0).otherwise(F.col("rate")))
    verdict = F.when(F.col("p").isNull(), "no_proof").when(~F.col("identity_verified"), "differs_from_bar").when(F.col("fx").isNull(), "rate_missing").otherwise("verified")
    return rows.select("security_id", "date", verdict.alias("verdict"), F.when(F.col("identity_verified"), F.col("p.issue")).alias("issue"), "currency", "fx", (F.col("adj_close") * F.col("fx")).alias("adj_close_reporting"), (F.col("amount") * F.col("fx")).alias("amount_reporting"))


def reconciled_terms(actions: DataFrame, bars: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Actions with ``consistent``: whether their terms explain the change of the adjustment factor on the ex-day.

    ``actions`` (security_id, date, gross, multiplier): (last close - gross) / multiplier must be within ``tolerance`` of last close * last factor /
    factor. ``bars`` (security_id, date, close, adj_factor); the last bar is the quoted one before. What is missing is inconsistent.
    """
    w = Window.partitionBy("security_id").orderBy("date")
    known = bars.select("security_id", "date", F.lag("close").over(w).alias("last_close"), F.lag("adj_factor").over(w).alias("last_factor"), "adj_factor")
    rows = actions.join(known, ["security_id", "date"], "left")
    expected = F.try_divide(F.col("last_close") - F.col("gross"), F.col("multiplier"))
    implied = F.try_divide(F.col("last_close") * F.col("last_factor"), F.col("adj_factor"))
    good = (F.col("last_close") > 0) & (F.col("last_factor") > 0) & (F.col("adj_factor") > 0) & (expected > 0) & (F.abs(expected - implied) <= tolerance)
    return rows.select("security_id", "date", "gross", "multiplier", expected.alias("expected"), implied.alias("implied"), _yes(good).alias("consistent"))


def contemporaneous_lots(rows: DataFrame) -> DataFrame:
    """Lots of snapshots (date, code, lot, observed), taken only where observed on the snapshot's own day; ``status`` tells why not."""
    seen = F.col("observed")
    status = F.when(seen.isNull(), "missing_observation_date").when(seen > F.col("date"), "future_observation").when(seen < F.col("date"), "stale_observation").when(F.col("lot").isNull(), "missing_lot").otherwise("observed")
    return rows.withColumns({"status": status, "lot": F.when(seen == F.col("date"), F.col("lot"))})


def filtered_prices(rows: DataFrame, sessions: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows (code, date, ...) on sessions (date) and not before a known listing date (code, listed); unknown codes stay. Codes get their five digits."""
    five = F.concat(F.lpad(F.split("code", r"\.")[0], 5, "0"), F.lit(".HK"))
    kept = rows.withColumn("code", five).join(sessions.select("date").distinct(), "date", "left_semi")
    return kept.join(listings.select("code", "listed"), "code", "left").where(F.col("listed").isNull() | (F.col("date") >= F.col("listed"))).drop("listed")


def cleaned_quotes(quotes: DataFrame, periods: DataFrame) -> DataFrame:
    """Raw quotes (issue, date, closing, no_close, volume, amount) with a close only where the source means one, and the listing that holds them.

    The average price comes from positive totals. ``periods`` (issue, listing, code, start, end), half-open; just one must hold the date.
    Listings of an issue are few, so they meet in a join by issue.
    """
    meant = _yes((F.col("no_close") == 0) & (F.col("closing") > 0) & (F.col("closing") < float("inf")))
    rows = quotes.withColumns({"raw_close": F.when(meant, F.col("closing")), "vwap": F.when((F.col("volume") > 0) & (F.col("amount") > 0), F.col("amount") / F.col("volume"))})
    inside = (F.col("q.issue") == F.col("p.issue")) & (F.col("p.start") <= F.col("q.date")) & (F.col("p.end").isNull() | (F.col("q.date") < F.col("p.end")))
    held = quotes.select("issue", "date").distinct().alias("q").join(periods.alias("p"), inside).groupBy("q.issue", "q.date").agg(F.count(F.lit(1)).alias("candidates"), F.min(F.struct("listing", "code")).alias("one"))
    met = rows.join(held, ["issue", "date"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("long"))
    place = F.when(F.col("candidates") == 0, "outside_listing").when(F.col("candidates") > 1, "ambiguous_listing").when(~_yes(F.col("one.code").rlike("^[0-9]{1,5}$")), "missing_code").otherwise("matched")
    met = met.withColumn("place", place)
    own = F.col("place") == "matched"
    return met.select("issue", "date", "raw_close", "vwap", "place", "candidates", F.when(own, F.concat(F.lpad("one.code", 5, "0"), F.lit(".HK"))).alias("exchange_code"), F.when(own, F.col("one.listing")).alias("listing"))


def importance_shares(gains: DataFrame, *by: str, top: int = 10) -> DataFrame:
    """(by..., feature, gain, share, place): each feature's share of the group's gain, the ``top`` largest; null where nothing was gained."""
    whole = Window.partitionBy(*by)
    rows = gains.withColumn("share", F.try_divide("gain", F.sum("gain").over(whole)))
    return rows.withColumn("place", F.row_number().over(whole.orderBy(F.desc("gain"), "feature"))).where(F.col("place") <= top)


def contradictions(metrics: DataFrame, *by: str, tolerance: float = 1e-12) -> DataFrame:
    """(by..., problem): stored figures that their own counts or bounds contradict; a group without problems has no row.

    ``metrics``: rank_ic, ic_lower, ic_upper, brier, baseline_brier, brier_skill, covered, available, coverage, dates, rows. Figures must be finite,
    the correlation inside its interval, skill and coverage as recomputed, and all groups judged on the same sample.
    """
    figures = ("rank_ic", "ic_lower", "ic_upper", "brier", "baseline_brier", "brier_skill", "coverage")
    finite = F.lit(True)
    for c in figures:
        finite &= _yes((F.abs(F.col(c)) < float("inf")) & ~F.isnan(c))
    near = lambda a, b: _yes(F.abs(a - b) <= tolerance)
    sample = F.struct("dates", "rows")
    rows = metrics.crossJoin(F.broadcast(metrics.agg((~F.min(sample).eqNullSafe(F.max(sample))).alias("_samples"))))  # one row
    rules = {
        "not_finite": ~finite, "outside_interval": ~_yes((F.col("ic_lower") <= F.col("rank_ic")) & (F.col("rank_ic") <= F.col("ic_upper"))),
        "skill_differs": ~near(F.col("brier_skill"), 1 - F.try_divide("brier", "baseline_brier")), "coverage_differs": ~near(F.col("coverage"), F.try_divide("covered", "available")), "unequal_samples": F.col("_samples"),
    }
    return rows.select(*by, F.explode(F.filter(F.array(*(F.when(c, n) for n, c in rules.items())), lambda x: x.isNotNull())).alias("problem"))


def cohort_panel(cohort: DataFrame, bars: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, audit): every declared identity (security_id) on every session, whatever was quoted, and a row of counts an identity.

    ``bars`` (security_id, date, close, quote_present, data_valid); missing flags are false. Bars of other identities are left out.
    """
    grid = cohort.select("security_id").distinct().crossJoin(F.broadcast(days.select("date", "pos")))  # a row an identity and session
    panel = grid.join(bars, ["security_id", "date"], "left")
    panel = panel.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quote_present", "data_valid")})
    good = F.col("quote_present") & F.col("data_valid")
    audit = panel.groupBy("security_id").agg(F.count_if(good).alias("valid_quotes"), F.min(F.when(good, F.col("date"))).alias("first_quote"), F.max(F.when(good, F.col("date"))).alias("last_quote"), F.count("close").alias("rows"))
    return panel, audit.withColumn("source", F.when(F.col("rows") > 0, "observed").otherwise("unavailable"))
