"""Replays of selections: periods between signals, their benchmark, ideal returns with what is missing, and closed positions of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators.intake import positive


def period_groups(signals: DataFrame, calendar: DataFrame, last_exit: str | None = None) -> DataFrame:
    """(signal, entry, exit): entry at the session after a signal; exit as declared, else the next signal's entry, else ``last_exit``.

    ``signals`` (date, exit), unique by date. A signal without a later session has no period. One row a signal meets in the window.
    """
    after = calendar.select(F.col("date").alias("signal"), F.lead("date").over(Window.orderBy("date")).alias("entry"))  # one row a session
    met = signals.select(F.col("date").alias("signal"), F.col("exit").alias("declared")).join(after, "signal").where("entry IS NOT NULL")
    following = F.lead("entry").over(Window.orderBy("signal"))
    return met.select("signal", "entry", F.coalesce("declared", following, F.lit(last_exit).cast("date")).alias("exit"))


def _price(name: str) -> Column:
    return F.when(positive(name), F.col(name))


def _ends(rows: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the positive prices at their entry and exit, else null."""
    for side in ("entry", "exit"):
        at = prices.select(*keys, F.col("date").alias(side), _price("close").alias(f"{side}_price"))
        rows = rows.join(at, [*keys, side], "left")
    return rows


def _gaps(rows: DataFrame, kind: str, name: Column) -> DataFrame:
    each = F.array(*(F.when(F.col(f"{s}_price").isNull(), F.col(s)) for s in ("entry", "exit")))
    missing = rows.where("entry_price IS NULL OR exit_price IS NULL").select(F.lit(kind).alias("kind"), name.alias("security_id"), "exit", F.explode(each).alias("date"), "entry_price", "exit_price")
    return missing.where("date IS NOT NULL").select("kind", "security_id", "date")


def replayed_periods(selected: DataFrame, periods: DataFrame, adjusted: DataFrame, raw: DataFrame, benchmark: DataFrame, cost: float = 0.003) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(months, names, gaps) of ideal trades at adjusted closes.

    ``selected`` (date, security_id, place), unique by key; ``adjusted`` and ``raw`` (security_id, date, close; raw with volume); ``benchmark`` (date, close).
    Names give each selected return with both prices and whether the signal's own bar was traded. A month is given only where all its names have a return;
    its turnover is the share of names that the signal before did not select (1 at the first), whether that month is whole or not, and ``observable_return`` counts names without
    a bar at the signal as 0. A null exit has no return and no gap. Gaps (kind, security_id, date) list each missing price; the benchmark's have no security_id.
    """
    chosen = selected.select(F.col("date").alias("signal"), "security_id", "place")
    held = chosen.join(F.broadcast(periods), "signal")  # one row a signal
    rows = _ends(held, adjusted, ["security_id"])
    seen = raw.where(positive("close", "volume")).select("security_id", F.col("date").alias("signal"), F.lit(True).alias("observable"))
    rows = rows.join(seen, ["security_id", "signal"], "left").withColumns({"observable": F.coalesce("observable", F.lit(False)), "gross_return": F.col("exit_price") / F.col("entry_price") - 1})
    order = periods.select("signal", F.lag("signal").over(Window.orderBy("signal")).alias("before"))  # one row a signal
    was = chosen.select(F.col("signal").alias("before"), "security_id", F.lit(1).alias("held"))
    stayed = chosen.join(F.broadcast(order), "signal").join(was, ["before", "security_id"], "left").groupBy("signal").agg((1 - F.count("held") / F.count(F.lit(1))).alias("turnover"))
    ends = _ends(periods, benchmark, [])
    market = ends.select("signal", (F.col("exit_price") / F.col("entry_price") - 1).alias("benchmark_return"))
    whole = rows.groupBy("signal", "entry", "exit").agg(
        F.count(F.lit(1)).alias("stocks"), F.count("gross_return").alias("known"), F.avg("gross_return").alias("gross_return"), F.avg(F.when(F.col("observable"), F.col("gross_return")).otherwise(0.0)).alias("observable_return")
    ).where("known = stocks").drop("known")
    months = whole.join(stayed, "signal").join(market, "signal", "left")
    months = months.withColumns({"net_return": F.col("gross_return") - cost * F.col("turnover"), "observable_net": F.col("observable_return") - cost * F.col("turnover")})
    names = rows.where("gross_return IS NOT NULL").select("signal", "entry", "exit", "security_id", "place", "entry_price", "exit_price", "gross_return", "observable")
    none = F.lit(None).cast(selected.schema["security_id"].dataType)
    return months, names, _gaps(rows, "missing_endpoint", F.col("security_id")).unionByName(_gaps(ends, "missing_benchmark_close", none))


def closed_positions(fills: DataFrame) -> DataFrame:
    """Positions (account, position) whose fills sold all they bought: dates, cost, proceeds, fees, gain and whether it was won.

    ``fills`` (account, position, date, side, units, value, fee), units and value positive. Buying fees raise the cost, selling fees lower the
    proceeds. ``first_cohort`` marks positions that were entered on their account's first buying day.
    """
    buy = F.col("side") == "buy"
    found = fills.groupBy("account", "position").agg(
        F.min(F.when(buy, F.col("date"))).alias("entry"), F.max(F.when(~buy, F.col("date"))).alias("exit"), F.sum(F.when(buy, F.col("units")).otherwise(-F.col("units"))).alias("open_units"),
        F.sum(F.when(buy, F.col("value") + F.col("fee"))).alias("cost"), F.sum(F.when(~buy, F.col("value") - F.col("fee"))).alias("proceeds"), F.sum("fee").alias("fees"), F.count(F.lit(1)).alias("fills"),
    )
    first = found.groupBy("account").agg(F.min("entry").alias("first_entry"))
    closed = found.where("open_units = 0 AND entry IS NOT NULL AND exit IS NOT NULL").join(first, "account")
    gain = F.try_divide("proceeds", "cost") - 1
    return closed.select("account", "position", "entry", "exit", "cost", "proceeds", "fees", "fills", gain.alias("net_return"), (gain > 0).alias("won"), (F.col("entry") == F.col("first_entry")).alias("first_cohort"))


def cohort_figures(closed: DataFrame, initial_cash: float) -> DataFrame:
    """Sums of each account's first cohort: positions, winners, cost, proceeds, gain, its share of cost and of the initial cash, last exit."""
    rows = closed.where("first_cohort").groupBy("account").agg(
        F.min("entry").alias("entry"), F.max("exit").alias("final_exit"), F.count(F.lit(1)).alias("positions"), F.count_if("won").alias("winners"), F.sum("cost").alias("cost"), F.sum("proceeds").alias("proceeds"), F.sum("fees").alias("fees")
    )
    gain = F.col("proceeds") - F.col("cost")
    return rows.withColumns({"gain": gain, "return_on_cost": F.try_divide(gain, F.col("cost")), "share_of_cash": gain / initial_cash, "cash_after": initial_cash + gain})
