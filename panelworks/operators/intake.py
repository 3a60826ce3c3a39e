"""Vendor tables to panel inputs: unit scales, source joins, identity masks, capitalisation, legality of inputs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.windows import at_least, last_n, ratio_to

# Code forms of the mainland exchanges, and the day from which the youngest of them has listings.
CODE_FORM = r"^(?:60\d{4}\.SH|68\d{4}\.SH|00\d{4}\.SZ|30\d{4}\.SZ|\d{6}\.BJ)$"
FIRST_LISTING = {".BJ": "2021-11-15"}
# Fixed value: codes of mainland shares and depositary receipts, with the older Beijing prefixes.
SHARE_FORM = r"^(?:60\d{4}\.SH|68[89]\d{3}\.SH|(?:00|30)\d{4}\.SZ|(?:(?:4|8)\d{5}|92\d{4})\.BJ)$"
KEYS = ["security_id", "date"]


def listed_shares(rows: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code is a mainland share's; funds, bonds, indexes and unknown codes are left out, null too."""
    return rows.where(F.col(code).rlike(SHARE_FORM))


def positive(*columns: str) -> Column:
    """All are known, finite and above zero."""
    each = [(F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c) for c in columns]
    return F.coalesce(reduce(and_, each), F.lit(False))


def _left(daily: DataFrame, other: DataFrame) -> DataFrame:
    """Left join by KEYS; columns that daily has already are not taken from the other table."""
    return daily.join(other.select(*KEYS, *(c for c in other.columns if c not in daily.columns)), KEYS, "left")


def normalized_daily(daily: DataFrame, basic: DataFrame, factors: DataFrame, limits: DataFrame) -> DataFrame:
    """Quotes in hands and thousands, shares in ten-thousands and turnover in percent to base units, with flags.

    The other tables are unique by (security_id, date); what they lack stays null. ``quote_present``: volume, amount
    and close are positive. ``data_valid``: prices and factor are positive, and open and close lie inside the day's range.
    """
    rows = reduce(_left, (basic, factors, limits), daily)
    out = rows.withColumnsRenamed({"open": "raw_open", "close": "raw_close"}).withColumns({"volume": F.col("vol") * 100, "amount": F.col("amount") * 1000})
    out = out.withColumns({c: F.col(c) * 10000 for c in ("total_mv", "total_share", "free_share")})
    out = out.withColumns({"free_mv": F.col("free_share") * F.col("raw_close"), "turnover_ratio": F.col("turnover_rate") / 100, "adj_close": F.col("raw_close") * F.col("adj_factor")})
    ranged = F.least("raw_open", "raw_close", "low").eqNullSafe(F.col("low")) & F.greatest("raw_open", "raw_close", "high").eqNullSafe(F.col("high"))
    flags = {"quote_present": positive("volume", "amount", "raw_close"), "data_valid": positive("raw_open", "raw_close", "high", "low", "adj_factor", "adj_close") & ranged}
    return out.withColumns(flags).drop("vol", "turnover_rate")


def joined_sources(quotes: DataFrame, factors: DataFrame) -> DataFrame:
    """Quotes and adjusted reference rows of one market, whichever source has them, with flags.

    A row is not valid where the reference close is off the adjusted close by more than 0.02 and 0.1%, or the source's
    average price is off amount over volume by more than 0.005001.
    """
    both = quotes.join(factors, KEYS, "full_outer").withColumn("adj_close", F.col("raw_close") * F.col("factor"))
    both = both.withColumn("vwap", F.when(F.col("volume") > 0, F.col("amount") / F.col("volume")))
    off = F.abs(F.col("reference_close") - F.col("adj_close")) > F.greatest(F.lit(0.02), F.abs("adj_close") * 0.001)
    strange = F.abs(F.col("source_vwap") - F.col("vwap")) > 0.005001
    valid = positive("raw_close", "factor") & ~F.coalesce(off, F.lit(False)) & ~F.coalesce(strange, F.lit(False))
    return both.select(*KEYS, "raw_close", "adj_close", "vwap", positive("volume", "amount", "vwap").alias("quote_present"), valid.alias("data_valid"))


def normalized_securities(raw: DataFrame) -> DataFrame:
    """Rows whose code has a listed form, with exchange code, listing date not before its exchange's first, and lot size."""
    listed = raw.where(F.col("code").rlike(CODE_FORM)).withColumn("source_list_date", F.col("list_date"))
    for suffix, first in FIRST_LISTING.items():
        listed = listed.withColumn("list_date", F.when(F.col("code").endswith(suffix) & F.col("list_date").isNotNull(), F.greatest("list_date", F.lit(first).cast("date"))).otherwise(F.col("list_date")))
    lot = F.when(F.col("code").rlike("^68[89]"), 200).otherwise(100)
    return listed.withColumns({"exchange_code": F.substring("code", 1, 6), "lot_size": lot})


def flagged(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """rows with the boolean ``name``: whether (security_id, date) is among ``keys``."""
    return rows.join(keys.select(*KEYS).distinct().withColumn(name, F.lit(True)), KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def identity_mask(bars: DataFrame, master: DataFrame, scope: str) -> DataFrame:
    """bars with ``identity_valid``: inside a verified period, or with dated proof of the partly verified issue within ``scope``."""
    facts = master.select("security_id", *(F.col(c).alias(f"_{c}") for c in ("status", "valid_from", "valid_to", "issue_id", "scope")))
    met = bars.join(facts, "security_id", "left")
    inside = (F.col("_status") == "verified") & (F.col("date") >= F.col("_valid_from")) & (F.col("_valid_to").isNull() | (F.col("date") < F.col("_valid_to")))
    proof = (F.col("_status") == "partially_verified") & F.col("date_verified") & (F.col("issue_id") == F.col("_issue_id")) & (F.col("_scope") == scope)
    return met.withColumn("identity_valid", F.coalesce(inside, F.lit(False)) | F.coalesce(proof, F.lit(False))).select(*bars.columns, "identity_valid")


def isolated(masked: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """Numbers null and flags false outside the valid identity, so that no window sees them; rows stay."""
    return masked.withColumns({c: F.when(F.col("identity_valid"), F.col(c)) for c in numbers} | {c: F.col("identity_valid") & F.col(c) for c in flags})


def capitalisation(panel: DataFrame) -> DataFrame:
    """Logarithms of whole and free capitalisation, free share, mean turnover, and change of shares over 60 and 252 sessions."""

    def log(value):
        return F.when(value > 0, F.log(value))

    return panel.select(
        *KEYS, log(F.col("total_mv")).alias("log_market_cap"), log(F.col("free_mv")).alias("log_free_market_cap"),
        F.try_divide(F.col("free_share"), F.when(F.col("total_share") > 0, F.col("total_share"))).alias("free_share_ratio"),
        at_least(F.avg("turnover_ratio").over(last_n(20)), F.col("turnover_ratio"), 12, last_n(20)).alias("turnover_20"),
        *(ratio_to("total_share", n).alias(f"share_change_{n}") for n in (60, 252)),
    )


def valuation_ratios(rows: DataFrame) -> DataFrame:
    """earnings_yield and book_to_price from figures per share known at the date."""
    return rows.withColumns({"earnings_yield": F.try_divide(F.col("earnings"), F.col("close")), "book_to_price": F.try_divide(F.col("book"), F.col("close"))})


def legality(rows: DataFrame, features: list[str], horizons: tuple[int, ...], complete: bool = True) -> DataFrame:
    """rows with ``legal`` and ``reasons``: infinite or (if ``complete``) missing features, sigma, horizon, status."""
    infinite = reduce(lambda a, b: a | b, (F.coalesce(F.abs(c) == float("inf"), F.lit(False)) for c in features))
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in features)) if complete else F.lit(False)
    checks = {
        "infinite_feature": infinite, "missing_feature": missing, "sigma": ~positive("sigma"), "unsupported_horizon": ~F.col("horizon").isin(*horizons), "status": ~F.col("status").eqNullSafe(F.lit("ok")),
    }
    reasons = F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in checks.items()))
    return rows.withColumn("reasons", reasons).withColumn("legal", F.col("reasons") == "")


def windows_of(spans: DataFrame, kind: str) -> DataFrame:
    """Calendar windows (start, end) of each span (first, last), clipped to it; ``kind`` is month, quarter or half_month."""
    step = {"month": 1, "quarter": 3, "half_month": 1}[kind]
    unit = "quarter" if kind == "quarter" else "month"
    begins = spans.withColumn("_m", F.explode(F.sequence(F.trunc("first", unit), F.trunc("last", "month"), F.expr(f"interval {step} month"))))
    if kind == "half_month":
        halves = F.array(F.struct(F.col("_m").alias("a"), F.date_add("_m", 14).alias("b")), F.struct(F.date_add("_m", 15).alias("a"), F.last_day("_m").alias("b")))
        parts = begins.withColumn("_w", F.explode(halves))
    else:
        parts = begins.withColumn("_w", F.struct(F.col("_m").alias("a"), F.date_sub(F.add_months("_m", step), 1).alias("b")))
    clipped = parts.select(*spans.columns, F.greatest("first", "_w.a").alias("start"), F.least("last", "_w.b").alias("end"))
    return clipped.where("start <= end")


def momentum_score(ranked: DataFrame) -> DataFrame:
    """Twice the rank of the year's momentum without its last month, less one."""
    return ranked.withColumn("score", 2 * F.col("momentum_252_skip20") - 1)


def page_violations(rows: DataFrame, fields: list[str], first: str, last: str, by: str) -> DataFrame:
    """Counts per page ``by``: rows, missing fields, dates outside [first, last], rows beyond one of a (security_id, date)."""
    there = sum((F.col(c).isNull().cast("int") for c in fields), F.lit(0))
    outside = ~F.coalesce((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") <= F.lit(last).cast("date")), F.lit(False))
    again = F.row_number().over(Window.partitionBy(by, *KEYS).orderBy(*fields)) > 1
    return rows.withColumn("_again", again).groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(there).alias("missing_fields"), F.count_if(outside).alias("outside_range"), F.count_if("_again").alias("duplicates"))
