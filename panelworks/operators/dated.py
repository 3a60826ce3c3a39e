"""Facts that hold from a date on: daily information sets, lot sizes, sparse valuations, offers, listing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.dates import on_days
from panelworks.functions.windows import sessions


def daily_versions(versions: DataFrame, days: DataFrame) -> DataFrame:
    """The latest version of each event that was visible on each day.

    ``versions`` (security_id, event_id, published_at, version, value); ``days`` (date) is a calendar. A version holds from
    its publication to that of the next one, so each day meets one version of an event and nothing is ranked afterwards.
    """
    along = Window.partitionBy("security_id", "event_id").orderBy("published_at", "version")
    spans = versions.withColumn("until", F.lead("published_at").over(along))
    return on_days(spans, days.select("date"), "published_at", "until").select("date", "security_id", "event_id", "published_at", "version", "value")


def lot_history(anchors: DataFrame, changes: DataFrame) -> DataFrame:
    """(security_id, valid_from, valid_to, lot, status): lot sizes inferred backwards from today's.

    ``anchors`` (security_id, lot) is today's lot, ``changes`` (security_id, effective, old_lot, new_lot). A span is
    ``closed`` while every later change leads to the one after it and the last to today's lot; from the first broken link
    back it is ``open``, and its lot null. The span before the first change has no valid_from.
    """
    later, back = Window.partitionBy("security_id").orderBy("effective"), Window.partitionBy("security_id").orderBy(F.desc("effective"))
    met = changes.join(anchors, "security_id").withColumns({"following": F.coalesce(F.lead("old_lot").over(later), "lot"), "valid_to": F.lead("effective").over(later), "number": F.row_number().over(later)})
    met = met.withColumn("closed", F.min(F.col("new_lot").eqNullSafe(F.col("following"))).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct(F.col("effective").alias("valid_from"), F.col("valid_to"), F.col("new_lot").alias("lot"))
    before = F.struct(F.lit(None).cast("date").alias("valid_from"), F.col("effective").alias("valid_to"), F.col("old_lot").alias("lot"))
    spans = met.select("security_id", "closed", F.explode(F.when(F.col("number") == 1, F.array(before, own)).otherwise(F.array(own))).alias("s"))
    return spans.select("security_id", "s.valid_from", "s.valid_to", F.when(F.col("closed"), F.col("s.lot")).alias("lot"), F.when(F.col("closed"), "closed").otherwise("open").alias("status"))


def carried_forward(panel: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """The panel with the last known value of a sparse series, and the number of sessions since.

    ``facts`` (security_id, date, column) is unique by key; days without a session take no part.
    """
    so_far = sessions().rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("security_id", "date")
    known = facts.select("security_id", "date", column).where("security_id IS NOT NULL AND date IS NOT NULL")
    both = panel.withColumn("_bar", F.lit(1)).unionByName(known, allowMissingColumns=True).repartition("security_id")  # both windows, one exchange
    met = both.withColumn(column, F.first(column, True).over(day)).where("_bar = 1").drop("_bar").withColumn("at", F.when(F.col(column).isNotNull(), F.col("pos")))
    return met.withColumns({column: F.last(column, True).over(so_far), "age": F.col("pos") - F.last("at", True).over(so_far)}).drop("at")


def offer_flags(rows: DataFrame, offers: DataFrame, known_from: str, recent: int = 60) -> DataFrame:
    """(security_id, date, offer_active, offer_recent) of ``rows`` (security_id, date), unique by key.

    An offer (security_id, start, end; end null while open) counts strictly after its start: it is active up to its end,
    recent for ``recent`` days. Both flags are null before ``known_from``, when offers were not recorded.
    """
    after = (F.col("o.security_id") == F.col("r.security_id")) & (F.col("r.date") > F.col("o.start")) & ((F.col("r.date") <= F.date_add("o.start", recent)) | F.col("o.end").isNull() | (F.col("r.date") <= F.col("o.end")))
    met = rows.alias("r").join(offers.alias("o"), after, "left")
    active = F.col("o.start").isNotNull() & (F.col("o.end").isNull() | (F.col("r.date") <= F.col("o.end")))
    near = F.coalesce(F.col("r.date") <= F.date_add("o.start", recent), F.lit(False))
    found = met.groupBy("r.security_id", "r.date").agg(F.max(active).alias("offer_active"), F.max(near).alias("offer_recent"))
    return found.withColumns({c: F.when(F.col("date") >= F.lit(known_from).cast("date"), F.col(c)) for c in ("offer_active", "offer_recent")})


def inside_listing(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """``rows`` with ``place``: inside, before_listing, after_delisting or unknown_security.

    ``periods`` (security_id, list_date, delist_date) is unique by security and half-open; a null list_date is unknown.
    """
    met = rows.join(periods, "security_id", "left")
    place = F.when(F.col("list_date").isNull(), "unknown_security").when(F.col("date") < F.col("list_date"), "before_listing").when(F.col("date") >= F.col("delist_date"), "after_delisting").otherwise("inside")
    return met.withColumn("place", place).drop("list_date", "delist_date")


def masked_returns(panel: DataFrame) -> DataFrame:
    """Session returns whose both ends are ``allowed``; null elsewhere."""
    w = sessions()
    both = F.col("allowed") & F.coalesce(F.lag("allowed").over(w), F.lit(False)) & (F.lag("close").over(w) > 0)
    return panel.select("security_id", "date", "allowed", F.when(both, F.col("close") / F.lag("close").over(w) - 1).alias("risk_return"))
