"""Rolling factors and forward labels on the dense panel: one shuffle by security serves all windows.

Prices count where ``data_valid`` holds, amount and volume where ``quote_present`` does; nothing is filled. A division by
zero is missing, not infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.rolling import rolling
from panelworks.functions.windows import at_least, last_n, ratio_to, sessions

HORIZONS = (1, 5, 20, 60)
ANNUAL = 252**0.5
LEAST_SPREAD = 1e-14
#: Amounts are summed in whole parts of so many to one: in doubles such sums are exact (up to 2^53), so equal sums are equal whatever the order of their rows.
PARTS = 10_000.0
# (column, highest power, sessions) of the sums that the factors are made of
_SUMS = (("log_return", 2, (20, 60, 252)), ("return_1", 3, (20, 60)), ("close", 1, (20, 60, 252)), ("amount", 2, (20, 120)), ("volume", 2, (20,)), ("illiquid", 1, (20,)), ("down", 1, (60,)))


def _change(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1


def label_ends(days: DataFrame) -> DataFrame:
    """(pos, label_end_h...): the session h places on in the calendar (a row per session meets in the window)."""
    return days.select("pos", *(F.lead("date", h).over(Window.orderBy("pos")).alias(f"label_end_{h}") for h in HORIZONS))


def price_factors(panel: DataFrame, days: DataFrame, least_adv: float = 0.0) -> DataFrame:
    """Returns, momentum, volatility, extremes, liquidity, labels and eligibility; float rounding is left to the caller.

    ``panel`` is dense; ``days`` (date, pos) is the whole calendar, by which labels end also after a name's last bar.
    ``status``, the last that applies: ok, insufficient_history (under 60 quotes), below_liquidity_floor (mean amount under
    ``least_adv``), no_trade_quote, data_issue (price missing or not valid). Mean amounts count amounts to four decimals.
    """
    w = sessions()
    quoted, valid = F.coalesce("quote_present", F.lit(False)), F.coalesce("data_valid", F.lit(False))
    base = panel.select(
        "security_id", "date", "pos", "open", "high", "low", F.col("close").alias("raw"), quoted.alias("quoted"), valid.alias("valid"),
        F.when(valid, F.col("close")).alias("close"), F.when(quoted, F.col("amount")).alias("amount"), F.when(quoted, F.col("volume")).alias("volume"),
    )
    base = base.withColumn("return_1", ratio_to("close", 1)).withColumn("local", F.row_number().over(w) - 1)
    base = base.withColumn("log_return", F.when(F.col("return_1") > -1, F.log1p("return_1")))
    r, p = F.col("return_1"), F.col("close")
    base = base.withColumns({"illiquid": F.try_divide(F.abs(r), F.col("amount")), "both": F.when(p.isNotNull(), F.col("volume"))})
    base = base.withColumn("down", F.when(F.col("log_return").isNotNull(), F.pow(F.least("log_return", F.lit(0.0)), 2)))
    wanted, powers = {}, {}
    for column, power, spans in _SUMS:
        for e in range(power + 1):
            plain = F.rint(F.col(column) * PARTS) if column == "amount" else F.col(column).cast("double")
            powers[f"{column}_{e}"] = F.when(F.col(column).isNotNull(), F.pow(column, F.lit(float(e))) if e != 1 else plain)
            wanted |= {f"{column}_{e}_{n}": (f"{column}_{e}", "sum", n) for n in spans}
    wanted |= {"high_252": ("close", "max", 252), "low_252": ("close", "min", 252), "return_max_20": ("return_1", "max", 20)}
    base = rolling(base.withColumns(powers), wanted)

    def known(column, n, least, value):
        return F.when(F.col(f"{column}_0_{n}") >= least, value)

    def middle_of(column, n):
        return F.try_divide(F.col(f"{column}_1_{n}"), F.col(f"{column}_0_{n}") * PARTS if column == "amount" else F.col(f"{column}_0_{n}"))

    def mean(column, n, least):
        return known(column, n, least, middle_of(column, n))

    def moments(column, n):
        """Count, mean and central second moment."""
        count = F.col(f"{column}_0_{n}")
        middle = middle_of(column, n)
        return count, middle, F.greatest(F.try_divide(F.col(f"{column}_2_{n}"), count) - middle * middle, F.lit(0.0))

    def deviation(column, n, least):
        count, _, second = moments(column, n)
        return known(column, n, least, F.sqrt(F.try_divide(second * count, count - 1)))

    count, middle, second = moments("return_1", 60)
    second = F.when(second > LEAST_SPREAD, second)  # of equal returns only rounding is left
    third = F.try_divide(F.col("return_1_3_60"), count) - 3 * middle * F.try_divide(F.col("return_1_2_60"), count) + 2 * F.pow(middle, F.lit(3.0))
    skew = F.try_divide(third, F.pow(second, F.lit(1.5))) * F.try_divide(F.sqrt(count * (count - 1)), count - 2)
    spread = F.stddev_pop("close").over(last_n(20)) * F.stddev_pop("both").over(last_n(20))  # read only where all 20 pairs are there
    last_quote = F.last(F.when(F.col("quoted"), F.col("local")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    adv20 = mean("amount", 20, 12)
    out = base.select(
        "security_id", "date", "pos", "quoted", "valid", "close", "amount", "volume", "return_1", "log_return",
        F.sum(F.col("quoted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("history_sessions"),
        adv20.alias("adv20_amount"),
        *(ratio_to("close", n).alias(f"momentum_{n}") for n in (5, 20, 60, 120, 252)),
        _change(F.lag("close", 20).over(w), F.lag("close", 252).over(w)).alias("momentum_252_skip20"),
        _change(F.lag("close", 20).over(w), F.lag("close", 60).over(w)).alias("momentum_60_skip20"),
        *((deviation("log_return", n, max(12, n // 2)) * ANNUAL).alias(f"volatility_{n}") for n in (20, 60, 252)),
        (known("log_return", 60, 30, F.sqrt(F.try_divide(F.col("down_1_60"), F.col("log_return_0_60")))) * ANNUAL).alias("downside_volatility_60"),
        known("return_1", 20, 12, F.col("return_max_20")).alias("max_return_20"),
        known("return_1", 60, 30, skew).alias("return_skew_60"),
        known("close", 252, 60, _change(p, F.col("high_252"))).alias("near_high_252"),
        known("close", 252, 60, _change(p, F.col("low_252"))).alias("near_low_252"),
        *(_change(p, mean("close", n, max(12, n // 2))).alias(f"bias_{n}") for n in (20, 60)),
        (mean("illiquid", 20, 12) * 1e8).alias("amihud_20"),
        F.when(adv20 > 0, F.log(adv20)).alias("log_amount_20"),
        F.try_divide(adv20, mean("amount", 120, 60)).alias("amount_ratio_20_120"),
        *(F.try_divide(deviation(c, 20, 12), mean(c, 20, 12)).alias(f"{c}_cv_20") for c in ("amount", "volume")),
        at_least(F.try_divide(F.covar_pop("close", "both").over(last_n(20)), spread), F.col("both"), 20, last_n(20)).alias("price_volume_corr_20"),
        F.try_divide(F.col("high") - F.col("low"), F.col("raw")).alias("intraday_range"),
        _change(F.col("raw"), F.col("open")).alias("intraday_return"),
        (F.col("local") - F.coalesce(last_quote, F.lit(-1))).alias("sessions_since_quote"),
        *(_change(F.lead("close", h).over(w), p).alias(f"fwd_return_{h}") for h in HORIZONS),
    )
    status = F.when(~F.col("valid") | F.col("close").isNull(), "data_issue").when(~F.col("quoted"), "no_trade_quote")
    status = status.when(F.col("adv20_amount") < least_adv, "below_liquidity_floor").when(F.col("history_sessions") < 60, "insufficient_history").otherwise("ok")
    return out.withColumn("status", status).drop("valid").join(F.broadcast(label_ends(days)), "pos")  # a row a session


def market_returns(factors: DataFrame, days: DataFrame) -> DataFrame:
    """(date, pos, market_return, market_breadth_60, names) for every session: the median return of quoted names, and the
    share of them above their 60-session mean."""
    known = factors.where("quoted").groupBy("date").agg(
        F.median("return_1").alias("market_return"), F.avg(F.when(F.col("bias_60").isNotNull(), (F.col("bias_60") > 0).cast("double"))).alias("market_breadth_60"), F.count("return_1").alias("names")
    )
    return days.select("date", "pos").join(known, "date", "left")


def market_context(factors: DataFrame, days: DataFrame) -> DataFrame:
    """Momentum of the compounded median return over 20, 60 and 252 sessions (null unless all are known), its volatility over
    60 (30 at least), breadth and names. A row per session meets in the windows."""
    along = Window.orderBy("pos")
    line = market_returns(factors, days).withColumn("_log", F.log1p("market_return"))

    def last(n):
        return along.rowsBetween(-(n - 1), 0)

    return line.select(
        "date", "market_return", "market_breadth_60", "names",
        *(F.when(F.count("_log").over(last(n)) == n, F.expm1(F.sum("_log").over(last(n)))).alias(f"market_momentum_{n}") for n in (20, 60, 252)),
        F.when(F.count("market_return").over(last(60)) >= 30, F.stddev_samp("market_return").over(last(60)) * ANNUAL).alias("market_volatility_60"),
    )


def single_factor_risk(factors: DataFrame, days: DataFrame, dates: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """Beta, daily intercept and yearly residual variance (n - 2) against the market's median return, per name and date of ``dates``.

    They come from the ``window`` sessions before the date, with ``least`` pairs; a date on which the market has fewer
    returns, or no variance, has no rows.
    """
    along = Window.orderBy("pos").rangeBetween(-window, -1)
    market = market_returns(factors, days).select("date", "pos", "market_return")
    market = market.select("*", F.count("market_return").over(along).alias("_n"), F.var_samp("market_return").over(along).alias("_var"))
    held = factors.select("date", "security_id", "return_1").join(market, "date")
    x, y = (F.when(F.col("return_1").isNotNull() & F.col("market_return").isNotNull(), F.col(c)) for c in ("market_return", "return_1"))
    held = held.withColumns({"_1": (x * y).isNotNull().cast("double"), "_x": x, "_y": y, "_xx": x * x, "_xy": x * y, "_yy": y * y})
    held = rolling(held, {f"s{c}": (c, "sum", window) for c in ("_1", "_x", "_y", "_xx", "_xy", "_yy")})
    before = held.select("date", "security_id", "_n", "_var", *(F.lag(f"s{c}").over(sessions()).alias(c) for c in ("_1", "_x", "_y", "_xx", "_xy", "_yy")))
    found = before.join(dates, "date").where((F.col("_1") >= least) & (F.col("_n") >= least) & (F.col("_var") > 0))
    n = F.col("_1")
    found = found.select(
        "date", "security_id", n.cast("long").alias("n"), F.try_divide(F.col("_x"), n).alias("mx"), F.try_divide(F.col("_y"), n).alias("my"),
        *((F.col(f"_{a}{b}") - F.try_divide(F.col(f"_{a}") * F.col(f"_{b}"), n)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")),
    ).where("sxx > 0")
    beta = F.col("sxy") / F.col("sxx")
    variance = (F.col("syy") - beta * F.col("sxy")) / (F.col("n") - 2) * 252
    return found.select("date", "security_id", "n", beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("intercept"), variance.alias("residual_variance"))


def coverage(factors: DataFrame, columns: list[str], least: float = 0.2) -> DataFrame:
    """(feature, known, rows, share, kept): how often each column is known; kept where the share is at least ``least``."""
    counts = factors.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))
    long = counts.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("known")) for c in columns))).alias("x"))
    share = F.try_divide(F.col("x.known"), F.col("rows"))
    return long.select("x.feature", "x.known", "rows", share.alias("share"), F.coalesce(share >= least, F.lit(False)).alias("kept"))
