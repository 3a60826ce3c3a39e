"""Daily refresh of features and scores: one new session from its last sessions and the state of the session before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import features as fe
from panelworks.sources.tables import dense_panel

REACH = 252 + 60 + 1  # sessions that a row of features can depend on, its own included
STATE = "security_id long, quotes long, last_quote long, first_bar long"


def _written(spark: SparkSession, path: str, date: str) -> DataFrame | None:
    """The partition of one session, or None if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={date}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.option("basePath", path).parquet(f"{path}/date={date}").drop("date")


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def recent_bars(spark: SparkSession, bars_path: str, days: DataFrame, date: str) -> tuple[DataFrame, int]:
    """The bars of the last REACH sessions up to a date, pruned by partition, and the date's position; ``days`` (date, pos)."""
    day = F.lit(date).cast("date")
    at = days.where(F.col("date") == day).first()
    if at is None:
        raise ValueError(f"{date} is no session")
    start = days.where(F.col("pos") == max(0, at.pos - REACH + 1)).first().date
    return spark.read.parquet(bars_path).where((F.col("date") >= F.lit(start)) & (F.col("date") <= day)), at.pos


def state_of(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(security_id, quotes, last_quote, first_bar) of all bars: what is carried from session to session, from scratch."""
    quoted = F.coalesce("quote_present", F.lit(False))
    return bars.join(days, "date").groupBy("security_id").agg(F.count_if(quoted).alias("quotes"), F.max(F.when(quoted, F.col("pos"))).alias("last_quote"), F.min("pos").alias("first_bar"))


def refresh(spark: SparkSession, bars_path: str, days: DataFrame, target: str, date: str, least_adv: float = 0.0) -> None:
    """Writes the features, ranks and score of one session to ``target/features``, replacing that session only.

    ``bars_path`` is partitioned by date. Windows reach REACH sessions back; what reaches further (quotes so far, the last quote, the first bar)
    is the state of the session before, ``target/state``, and is written for the next. Run again, it gives the same; it refuses
    a session whose predecessor has no state. Securities without a bar in the session have no row. The result is that of
    a rebuild from all bars up to the date.
    """
    bars, at = recent_bars(spark, bars_path, days, date)
    day = F.lit(date).cast("date")
    before = days.where(F.col("pos") == at - 1).first()
    state = _written(spark, f"{target}/state", str(before.date)) if before else spark.createDataFrame([], STATE)
    if state is None:
        raise ValueError(f"the session before {date} has no state yet")
    today = bars.where(F.col("date") == day).select("security_id", F.coalesce("quote_present", F.lit(False)).alias("quoted"))
    now = state.join(today, "security_id", "full_outer").select(
        "security_id", (F.coalesce("quotes", F.lit(0)) + F.coalesce(F.col("quoted").cast("long"), F.lit(0))).alias("quotes"),
        F.when(F.col("quoted"), at).otherwise(F.col("last_quote")).alias("last_quote"), F.coalesce("first_bar", F.lit(at)).cast("long").alias("first_bar"), day.alias("date"),
    )
    _replace(now, f"{target}/state")
    now = _written(spark, f"{target}/state", date)
    panel = dense_panel(bars)
    local = panel.select("date", "pos").distinct()
    rows = fe.price_factors(panel, local, least_adv).where(F.col("date") == day).join(today.select("security_id"), "security_id", "left_semi")
    rows = rows.drop("history_sessions", "sessions_since_quote", "pos", *(c for c in rows.columns if c.startswith(("fwd_return", "label_end")))).join(now, "security_id")
    since = F.lit(at) - F.coalesce(F.col("last_quote"), F.col("first_bar") - 1)
    young = F.when(F.col("quotes") < 60, "insufficient_history").otherwise("ok")
    status = F.when(F.col("status").isin("ok", "insufficient_history"), young).otherwise(F.col("status"))
    rows = rows.withColumns({"history_sessions": F.col("quotes"), "sessions_since_quote": since, "status": status}).drop("quotes", "last_quote", "first_bar")
    score = xs.factor_score(xs.ranks(rows)).select("security_id", "score")
    _replace(rows.join(score, "security_id", "left"), f"{target}/features")
