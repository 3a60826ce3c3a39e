"""Monthly books: interval returns, costs, turnover, and summaries of a wealth curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signal_intervals(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """(signal, entry, exit): entry at the session after each signal date, exit at the session after the next signal."""
    after = calendar.select(F.col("date").alias("signal"), F.lead("date").over(Window.orderBy("pos")).alias("entry"))  # one row a session
    met = signals.select(F.col("date").alias("signal")).join(after, "signal")
    return met.withColumn("exit", F.lead("entry").over(Window.orderBy("signal"))).where("exit IS NOT NULL")


def interval_returns(selected: DataFrame, prices: DataFrame, intervals: DataFrame) -> DataFrame:
    """Return of each selected name from entry to exit; null where a price is missing or not positive."""
    held = selected.select(F.col("date").alias("signal"), "security_id").join(F.broadcast(intervals), "signal")  # one row a signal
    for side in ("entry", "exit"):
        held = held.join(prices.select("security_id", F.col("date").alias(side), F.col("close").alias(f"{side}_price")), ["security_id", side], "left")
    return held.withColumn("gross_return", F.when(F.col("entry_price") > 0, F.col("exit_price") / F.col("entry_price") - 1))


def monthly_book(returns: DataFrame, *by: str, fee: float = 0.0025) -> DataFrame:
    """Mean return of each signal (and group ``by``) and its share of gains after buying and selling fees; null when a selected outcome is missing."""
    gain = (1 + F.col("gross_return")) * (1 - fee) / (1 + fee) > 1
    whole = F.count("gross_return") == F.count(F.lit(1))
    return returns.groupBy(*by, "signal", "entry", "exit").agg(
        F.when(whole, F.avg("gross_return")).alias("gross_return"), F.when(whole, F.avg(gain.cast("double"))).alias("hit_rate"),
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("gross_return").isNull()).alias("missing"),
    )


def benchmarked_book(selected: DataFrame, pool: DataFrame, prices: DataFrame, intervals: DataFrame, fee: float = 0.0025, stress_fee: float = 0.005) -> DataFrame:
    """A row a signal: the selected names' mean return beside that of the whole ``pool`` (date, security_id) they were taken from.

    ``hit_rate`` and ``stress_hit_rate`` are shares of names that gain after fees, ``median_hit_rate`` of names above the pool's median. Figures
    of the book are null where one of its outcomes is missing, those of the pool where one of the pool's is.
    """
    chosen = selected.select("date", "security_id", F.lit(True).alias("chosen"))
    rows = interval_returns(pool.join(chosen, ["date", "security_id"], "left").select("date", "security_id"), prices, intervals)
    rows = rows.join(chosen.withColumnRenamed("date", "signal"), ["signal", "security_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    middle = rows.groupBy("signal").agg(F.median("gross_return").alias("middle"))
    r, own = F.col("gross_return"), F.col("chosen")
    after = lambda f: ((1 + r) * (1 - f) / (1 + f) > 1).cast("double")
    found = rows.join(middle, "signal").groupBy("signal", "entry", "exit").agg(
        F.count_if(own).alias("selected"), F.count(F.lit(1)).alias("pool"), F.count_if(own & r.isNull()).alias("missing"), F.count_if(r.isNull()).alias("pool_missing"),
        F.avg(F.when(own, r)).alias("gross_return"), F.avg(r).alias("benchmark_return"), F.avg(F.when(own, after(fee))).alias("hit_rate"), F.avg(F.when(own, after(stress_fee))).alias("stress_hit_rate"),
        F.avg(F.when(own, (r > F.col("middle")).cast("double"))).alias("median_hit_rate"),
    )
    book, whole = (F.col("missing") == 0) & (F.col("selected") > 0), F.col("pool_missing") == 0
    known = {"gross_return": book, "hit_rate": book, "stress_hit_rate": book, "benchmark_return": whole, "median_hit_rate": book & whole}
    return found.withColumns({c: F.when(ok, F.col(c)) for c, ok in known.items()})


def book_metrics(months: DataFrame, *by: str) -> DataFrame:
    """Yearly figures of monthly ``months`` (by..., signal, book, benchmark, ic, turnover): means times 12, ratios of mean to deviation, drawdowns.

    Where a book's month is missing only counts and a status are given. A ratio without deviation is null.
    """
    along = Window.partitionBy(*by).orderBy("signal").rowsBetween(Window.unboundedPreceding, 0)
    rows = months.withColumn("excess", F.col("book") - F.col("benchmark"))
    for c in ("book", "benchmark"):
        rows = rows.withColumn(f"_{c}", F.sum(F.log1p(c)).over(along))
        rows = rows.withColumn(f"_{c}", F.col(f"_{c}") - F.max(f"_{c}").over(along))
    bad = F.count("book") < F.count(F.lit(1))
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    figures = {
        "ic_mean": F.avg("ic"), "icir": F.try_divide(F.avg("ic"), F.stddev_samp("ic")), "ic_positive": share("ic"), "yearly_excess": F.avg("excess") * 12,
        "information_ratio": F.try_divide(F.avg("excess"), F.stddev_samp("excess")) * 12**0.5, "monthly_win": share("excess"), "yearly_turnover": F.avg("turnover") * 12, "yearly_return": F.avg("book") * 12,
        "yearly_benchmark": F.avg("benchmark") * 12, "drawdown": F.expm1(F.min("_book")), "benchmark_drawdown": F.expm1(F.min("_benchmark")),
    }
    return rows.groupBy(*by).agg(
        F.when(bad, "missing_execution_prices").otherwise("complete").alias("status"), F.count(F.lit(1)).alias("months"), F.count_if(F.col("book").isNull()).alias("missing_months"), *(F.when(~bad, v).alias(k) for k, v in figures.items())
    )


def metric_checks(metrics: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(..., metric, actual, passed) of a table's metric columns against declared bounds, "min" or "max"; a missing metric fails."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), (F.col(m) >= b if kind == "min" else F.col(m) <= b).alias("ok")) for m, (kind, b) in rules.items()))
    keys = [c for c in metrics.columns if c not in rules]
    return metrics.select(*keys, F.explode(each).alias("x")).select(*keys, "x.metric", "x.actual", F.coalesce("x.ok", F.lit(False)).alias("passed"))


def constraint_audit(weights: DataFrame, estimates: DataFrame, market_variance: float, name_cap: float, total_cap: float, volatility_cap: float, slack: float = 1e-7) -> DataFrame:
    """(book, constraint, security_id, actual, bound) of each bound that a book's weights (book, security_id, weight) exceed.

    ``estimates`` (security_id, beta, residual_variance) give the model's volatility: the residual variances with squared weights, and the market's
    with the squared beta of the book. A name without an estimate makes it unknown, and the row then has no figure.
    """
    met = weights.join(estimates, "security_id", "left")
    single = weights.where(F.col("weight") > name_cap + slack).select("book", F.lit("single_position").alias("constraint"), "security_id", F.col("weight").alias("actual"), F.lit(name_cap).alias("bound"))
    variance = F.sum(F.col("residual_variance") * F.pow("weight", F.lit(2.0))) + market_variance * F.pow(F.sum(F.col("beta") * F.col("weight")), F.lit(2.0))
    whole = F.count_if(F.col("beta").isNull() | F.col("residual_variance").isNull()) == 0
    sums = met.groupBy("book").agg(F.sum("weight").alias("total"), F.when(whole, F.sqrt(variance)).alias("volatility"))
    limits = F.array(*(F.struct(F.lit(c).alias("constraint"), F.lit(None).cast(weights.schema["security_id"].dataType).alias("security_id"), F.col(v).alias("actual"), F.lit(b).alias("bound")) for c, v, b in (("total_equity", "total", total_cap), ("annual_volatility", "volatility", volatility_cap))))
    whole_book = sums.select("book", F.explode(limits).alias("x")).select("book", "x.*").where(F.col("actual").isNull() | (F.col("actual") > F.col("bound") + slack))
    return single.unionByName(whole_book)


def signal_sheet(scores: DataFrame, n: int) -> DataFrame:
    """(date, security_id, score, place, selected, weight): each date's scores standardised and ranked, the first n with weight 1 / n."""
    day = Window.partitionBy("date")
    deviation = F.stddev_samp("score").over(day)
    z = F.when(deviation > 0, (F.col("score") - F.avg("score").over(day)) / deviation).otherwise(0.0)
    known = scores.where("score IS NOT NULL").withColumn("score", z)
    place = F.row_number().over(day.orderBy(F.desc(F.round("score", 9)), "security_id"))
    return known.select("date", "security_id", "score", place.alias("place")).withColumns({"selected": F.col("place") <= n, "weight": F.when(F.col("place") <= n, 1.0 / n).otherwise(0.0)})


def cohort_book(rows: DataFrame) -> DataFrame:
    """The reference book of equal slots: every eligible (``ok``) name of a date with weight one over their number."""
    fit = rows.where("status = 'ok'")
    return fit.select("date", "security_id", (1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))


def turnover(selected: DataFrame) -> DataFrame:
    """Share of each date's names that the date before did not hold; null on the first date."""
    dates = selected.select("date").distinct().select("date", F.lag("date").over(Window.orderBy("date")).alias("before"))  # one row a signal
    was = selected.select(F.col("date").alias("before"), "security_id", F.lit(1).alias("held"))
    met = selected.select("date", "security_id").join(F.broadcast(dates), "date").join(was, ["before", "security_id"], "left")
    return met.groupBy("date").agg(F.when(F.max("before").isNotNull(), 1 - F.count("held") / F.count(F.lit(1))).alias("turnover"))


def summary(book: DataFrame, *by: str, fee: float = 0.0025, equity: float = 0.95) -> DataFrame:
    """Total return, yearly growth, worst drawdown and hit rate of a book (each group's, ``by``) that is sold and bought whole each interval.

    The share ``equity`` is invested, the rest earns nothing. A missing outcome makes all figures null, with a status.
    """
    growth = 1 - equity + equity * (1 + F.col("gross_return")) * (1 - fee) / (1 + fee)
    along = Window.partitionBy(*by).orderBy("signal").rowsBetween(Window.unboundedPreceding, 0)  # one row a signal
    line = book.withColumn("log_wealth", F.sum(F.log(growth)).over(along))
    line = line.withColumn("peak", F.greatest(F.lit(0.0), F.max("log_wealth").over(along)))
    total = F.max_by("log_wealth", "signal")
    years = F.datediff(F.max("exit"), F.min("entry")) / 365.25
    bad = F.sum("missing") > 0
    found = (line.groupBy(*by) if by else line).agg(
        F.when(F.count(F.lit(1)) == 0, "insufficient_signals").when(bad, "incomplete_selected_returns").otherwise("complete").alias("status"), F.count(F.lit(1)).alias("months"), F.sum("missing").alias("missing"),
        F.when(~bad, F.expm1(total)).alias("total_return"), F.when(~bad, F.expm1(F.try_divide(total, years))).alias("cagr"), F.when(~bad, F.min(F.expm1(F.col("log_wealth") - F.col("peak")))).alias("max_drawdown"), F.when(~bad, F.avg("hit_rate")).alias("hit_rate"),
    )
    return found


def yearly(curve: DataFrame) -> DataFrame:
    """Compounded return, deviation and share of gains of a (date, book_return) curve by calendar year."""
    return curve.groupBy(F.year("date").alias("year")).agg(
        F.expm1(F.sum(F.log1p("book_return"))).alias("total_return"), F.stddev_samp("book_return").alias("deviation"), F.avg((F.col("book_return") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("periods")
    )


def capacity(selected: DataFrame, panel: DataFrame, participation: float = 0.05) -> DataFrame:
    """What can be traded of each name in the session after its signal: participation * min(signal's average amount, that day's amount)."""
    w = Window.partitionBy("security_id").orderBy("pos")
    known = panel.select("security_id", "date", "adv20_amount", F.lead("date").over(w).alias("trade_date"), F.lead("amount").over(w).alias("day_amount"))
    met = selected.select("date", "security_id").join(known, ["date", "security_id"], "left")
    both = F.col("adv20_amount").isNotNull() & F.col("day_amount").isNotNull()
    return met.select("date", "security_id", "trade_date", F.when(both, participation * F.least("adv20_amount", "day_amount")).alias("capacity"))


def positions_ledger(trades: DataFrame) -> DataFrame:
    """Running cash and quantity of each account's trades (account, ts, tie, quantity, price), buys positive."""
    w = Window.partitionBy("account").orderBy("ts", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumns({"cash": -F.sum(F.col("quantity") * F.col("price")).over(w), "held": F.sum("quantity").over(w)})
