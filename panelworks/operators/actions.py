"""Corporate actions: validation, adjustment of prices, segments between breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.windows import last_n, sessions


def forward_adjusted(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with the cumulative adjustment of splits and cash, from the first session on.

    ``actions`` (security_id, date, split, cash), unique by key. The multiplier of an ex-session is
    split * P / (P - cash) with P the close of the session before; an action without a valid P is unresolved (null
    from there on). Prices are also given in the last session's split terms.
    """
    w = sessions()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    met = panel.join(actions, ["security_id", "date"], "left").withColumns({"split": F.coalesce("split", F.lit(1.0)), "cash": F.coalesce("cash", F.lit(0.0))})
    met = met.withColumn("previous", F.lag("close").over(w))
    acts, valid = (F.col("split") != 1) | (F.col("cash") != 0), (F.col("previous") > F.col("cash")) & (F.col("split") > 0) & (F.col("cash") >= 0)
    step = F.when(~acts, 0.0).when(valid, F.log(F.col("split") * F.col("previous") / (F.col("previous") - F.col("cash"))))
    met = met.withColumns({"step": step, "split_step": F.when(F.col("split") > 0, F.log("split"))})
    met = met.withColumn("unresolved", F.max(F.col("step").isNull()).over(so_far))
    level = F.sum("split_step").over(so_far) - F.sum("split_step").over(Window.partitionBy("security_id"))
    return met.select(
        "security_id", "date", "pos", "close", "unresolved",
        F.when(~F.col("unresolved"), F.exp(F.sum("step").over(so_far))).alias("adjustment"), F.exp(level).alias("split_factor"),
    ).withColumns({"adj_close": F.col("close") * F.col("adjustment"), "split_adjusted_close": F.col("close") * F.col("split_factor")})


def back_adjusted(rows: DataFrame, events: DataFrame) -> DataFrame:
    """History at a cutoff: every close times the factors (P - cash) / P of the events after its date.

    ``events`` (security_id, ex_date, factor): a null factor is unresolved and leaves all earlier rows null. Running
    sums of logarithms from the last session back replace a join of rows with all later events.
    """
    daily = events.groupBy("security_id", F.col("ex_date").alias("date")).agg(F.sum(F.log("factor")).alias("step"), F.max(F.col("factor").isNull()).alias("open"))
    marks = rows.select("security_id", "date", "close", F.lit(1).alias("bar")).unionByName(daily.select("security_id", "date", "step", "open"), allowMissingColumns=True)
    marks = marks.repartition("security_id")  # both windows, one exchange
    later = Window.partitionBy("security_id").orderBy(F.desc("date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # events of the date itself do not change it, so its own steps are taken off again
    same = Window.partitionBy("security_id", "date")
    met = marks.withColumns({
        "log_factor": F.coalesce(F.sum("step").over(later), F.lit(0.0)) - F.coalesce(F.sum("step").over(same), F.lit(0.0)),
        "open_events": F.count_if(F.coalesce("open", F.lit(False))).over(later) - F.count_if(F.coalesce("open", F.lit(False))).over(same),
    })
    met = met.where("bar = 1").withColumn("back_close", F.when(F.col("open_events") == 0, F.col("close") * F.exp("log_factor")))
    return met.select("security_id", "date", "close", "back_close", (F.col("open_events") > 0).alias("poisoned"))


def segments(rows: DataFrame, floor: float = 0.02, share: float = 0.003) -> DataFrame:
    """``segment`` numbers of runs without an unreconciled break: the implied previous close differs from the reported beyond max(floor, share)."""
    w = sessions()
    implied = F.lag("close").over(w) * F.lag("adj_factor").over(w) / F.col("adj_factor")
    out = rows.withColumn("broken", F.coalesce(F.abs(implied - F.col("pre_close")) > F.greatest(F.lit(floor), F.abs("pre_close") * share), F.lit(False)))
    return out.withColumn("segment", F.sum(F.col("broken").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def segment_momentum(rows: DataFrame, n: int) -> DataFrame:
    """Change over n sessions and the forward one, both inside a segment only; sessions near a break are flagged for n slots."""
    w = sessions(("security_id", "segment"))
    return rows.select(
        "security_id", "date", "segment", "broken",
        (F.try_divide("close", F.lag("close", n).over(w)) - 1).alias("momentum"), (F.try_divide(F.lead("close", n).over(w), "close") - 1).alias("forward"),
        F.max("broken").over(last_n(n)).alias("recent_break"),
    )


def validated(actions: DataFrame) -> DataFrame:
    """Each action with the list of reasons against it; an empty list is accepted. Equal versions of a key collapse, others conflict."""
    rules = {
        "missing_ex_date": F.col("ex_date").isNull(), "missing_announcement": F.col("published_at").isNull(),
        "announced_after_ex_date": F.col("published_at") >= F.col("ex_date"), "negative_cash": F.col("cash") < 0, "missing_terms": F.col("cash").isNull() & F.col("split").isNull(),
        "invalid_split": F.col("split") <= 0, "no_effect": (F.coalesce("cash", F.lit(0.0)) == 0) & (F.coalesce("split", F.lit(1.0)) == 1),
    }
    facts = F.struct("cash", "split")
    versions = actions.groupBy("security_id", "ex_date").agg(
        F.min("published_at").alias("published_at"), F.count(F.lit(1)).alias("versions"), F.min(facts).alias("low"), F.max(facts).alias("high")
    )
    one = versions.select("security_id", "ex_date", "published_at", "versions", "low.*", (~F.col("low").eqNullSafe(F.col("high"))).alias("conflict"))
    found = F.array(*(F.when(c, n) for n, c in rules.items()), F.when(F.col("conflict"), "conflicting_versions"))
    visible = F.date_add(F.to_date("published_at"), 1)
    return one.withColumns({"reasons": F.concat_ws(",", F.filter(found, lambda x: x.isNotNull())), "visible_from": visible}).drop("conflict")


def factor_changes(rows: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Sessions whose factor differs from the last known one before."""
    before = F.last("adj_factor", True).over(sessions().rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("ratio", F.col("adj_factor") / before).where(F.abs(F.col("ratio") - 1) > tolerance)
    return out.select("security_id", "date", "adj_factor", "ratio")


def fees(orders: DataFrame, schedule: DataFrame, commission: float = 0.0003, floor: float = 5.0) -> DataFrame:
    """Commission with a floor, stamp duty on sales and transfer fee by the schedule valid on the day, total in cents.

    ``schedule`` (valid_from, valid_to, stamp_rate, transfer_rate) is a declared list of half-open periods.
    """
    valid = (F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to")))
    met = orders.join(F.broadcast(schedule), valid, "left")
    amount = F.col("notional")
    fee = F.when(amount == 0, 0.0).otherwise(F.greatest(F.lit(floor), amount * commission))
    out = met.withColumns({"commission": fee, "stamp_duty": F.when(F.col("side") == "sell", amount * F.col("stamp_rate")).otherwise(0.0), "transfer_fee": amount * F.col("transfer_rate")})
    return out.withColumn("total", F.round(F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee") + 1e-10, 2)).drop("valid_from", "valid_to", "stamp_rate", "transfer_rate")


def tradability(bars: DataFrame, side: str) -> DataFrame:
    """``reason`` why an order at the open is refused, or ok; the first that holds counts."""
    price = F.col("open")
    at_limit = price >= F.col("up_limit") - 1e-8 if side == "buy" else price <= F.col("down_limit") + 1e-8
    good = lambda c: F.coalesce(c > 0, F.lit(False))
    reason = (
        F.when(~F.col("quoted"), "missing_quote").when(~good(F.col("volume")) | ~good(F.col("amount")), "suspended_or_no_liquidity").when(~good(price), "invalid_price")
        .when(~good(F.col("up_limit")) | ~good(F.col("down_limit")), "missing_price_limit").when(F.col("up_limit") <= F.col("down_limit"), "invalid_price_limit")
        .when((price > F.col("up_limit") + 1e-8) | (price < F.col("down_limit") - 1e-8), "price_outside_limit_range")
        .when(at_limit, "at_upper_limit" if side == "buy" else "at_lower_limit").otherwise("ok")
    )
    return bars.withColumn("reason", reason)


def lot_quantity(budget, price, minimum: int = 100, step: int = 100):
    """Shares that a budget buys, rounded down to a step; 0 below the minimum or where an input is not positive."""
    shares = F.floor(budget / price + 1e-10)
    return F.when((budget > 0) & (price > 0) & (shares >= minimum), shares - shares % step).otherwise(0)


def lot_rule(code: Column) -> tuple[Column, Column]:
    """(minimum, step) of orders by exchange code. 200 and 1 for 688 and 689, 100 and 1 in Beijing, else 100 and 100."""
    beijing, star = F.upper(code).endswith(".BJ"), code.startswith("688") | code.startswith("689")
    return F.when(~beijing & star, 200).otherwise(100), F.when(beijing | star, 1).otherwise(100)


def buy_quantity(budget: Column, price: Column, code: Column) -> Column:
    """Shares that a budget buys in whole steps, fees apart; 0 below the minimum or where an input is not positive."""
    minimum, step = lot_rule(code)
    shares = F.floor(F.try_divide(budget, price) + 1e-10)
    return F.coalesce(F.when((budget > 0) & (price > 0) & (shares >= minimum), shares - shares % step), F.lit(0))


def sell_quantity(requested: Column, holding: Column, code: Column) -> Column:
    """Shares of a sale in whole steps; a whole holding goes with its odd lot, a part below the minimum is 0."""
    minimum, step = lot_rule(code)
    shares = F.least(F.floor(requested), holding)
    part = F.when(shares >= minimum, shares - shares % step).otherwise(0)
    return F.coalesce(F.when((requested > 0) & (holding > 0), F.when(shares == holding, shares).otherwise(part)), F.lit(0))


def venue_fees(orders: DataFrame, schedule: DataFrame, commission: float = 0.0003, floor: float = 5.0) -> DataFrame:
    """``fees`` where a venue can have a transfer rate of its own; days before the schedule's first period are refused (null fees).

    ``orders`` (code, date, side, notional); ``schedule`` (valid_from, valid_to, stamp_rate, transfer_rate, beijing_rate) is a declared list of periods. The
    total is rounded half up as a decimal.
    """
    valid = (F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to")))
    met = orders.join(F.broadcast(schedule), valid, "left")  # a row a period
    amount, known = F.col("notional"), F.col("valid_from").isNotNull() & (F.col("notional") >= 0) & F.col("side").isin("buy", "sell")
    rate = F.when(F.upper("code").endswith(".BJ"), F.col("beijing_rate")).otherwise(F.col("transfer_rate"))
    parts = {"commission": F.when(amount == 0, 0.0).otherwise(F.greatest(F.lit(floor), amount * commission)), "stamp_duty": F.when(F.col("side") == "sell", amount * F.col("stamp_rate")).otherwise(0.0), "transfer_fee": amount * rate}
    out = met.withColumns({n: F.when(known, c) for n, c in parts.items()})
    exact = [F.col(n).cast("decimal(24,8)") for n in parts]
    return out.withColumn("total", F.round(exact[0] + exact[1] + exact[2], 2)).drop(*schedule.columns)
