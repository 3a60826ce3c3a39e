"""Quality of predictions: probabilities, intervals, calibration, paired comparisons, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.order import equal_bins, positions
from panelworks.functions.windows import average_rank
from panelworks.operators.cross_section import correlations
from panelworks.sources.store import written


def probability_skill(rows: DataFrame) -> DataFrame:
    """Brier score, the baseline's, and skill per horizon, with error and direction figures of the point forecast."""
    y, up = F.col("fwd_return"), (F.col("fwd_return") > 0).cast("double")
    sums = rows.groupBy("horizon").agg(
        F.avg((F.col("probability_up") - up) ** 2).alias("brier"),
        F.avg((F.col("baseline_probability") - up) ** 2).alias("baseline_brier"),
        F.avg(F.abs(F.col("expected_return") - y)).alias("mae"),
        F.avg(((F.col("expected_return") > 0) == (y > 0)).cast("double")).alias("direction_accuracy"),
        F.avg(up).alias("up_ratio"),
        F.count(F.lit(1)).alias("rows"),
    )
    return sums.withColumn("skill", F.when(F.col("baseline_brier") > 0, 1 - F.col("brier") / F.col("baseline_brier")))


def _calibration(binned: DataFrame) -> DataFrame:
    up = (F.col("fwd_return") > 0).cast("double")
    return binned.groupBy("horizon", "bin").agg(F.avg("probability_up").alias("predicted"), F.avg(up).alias("observed"), F.count(F.lit(1)).alias("rows"))


def calibration_equal(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted and observed frequency per horizon in bins of equal size by probability, then date and id."""
    placed = positions(rows.select("horizon", "date", "security_id", "probability_up", "fwd_return"), ("horizon",), "probability_up", ("date", "security_id"), 1e-3)
    return _calibration(placed.withColumn("bin", equal_bins(F.col("position"), F.col("n"), bins)))


def calibration_fixed(rows: DataFrame, bins: int = 10) -> DataFrame:
    """The same in bins of equal width."""
    return _calibration(rows.withColumn("bin", F.least(F.floor(F.col("probability_up") * bins), F.lit(bins - 1)).cast("int") + 1))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error per horizon: row-weighted mean gap of the bins."""
    gap = F.sum(F.col("rows") * F.abs(F.col("predicted") - F.col("observed")))
    return bins.groupBy("horizon").agg((gap / F.sum("rows")).alias("ece"), F.sum("rows").alias("rows"))


def interval_quality(rows: DataFrame, levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """Coverage of [q10, q90] and pinball loss of each level, per horizon."""
    y = F.col("fwd_return")
    losses = []
    for q in levels:
        error = y - F.col(f"q{round(q * 100)}")
        losses.append(F.avg(F.greatest(q * error, (q - 1) * error)).alias(f"pinball_{round(q * 100)}"))
    inside = ((y >= F.col("q10")) & (y <= F.col("q90"))).cast("double")
    return rows.groupBy("horizon").agg(F.avg(inside).alias("coverage"), *losses, F.count("q50").alias("rows"))


def block_bootstrap(series: DataFrame, value: str, reps: int = 2000, block: int = 60, level: float = 0.95) -> DataFrame:
    """Circular block bootstrap of the mean of (horizon, date, value): lower and upper bound per horizon.

    Starts are hashes of replicate and block, so a run repeats exactly. The series holds one row a date, so its rows
    are few; replicates are spread over the cluster.
    """
    along = Window.partitionBy("horizon").orderBy("date")
    line = series.where(F.col(value).isNotNull()).select("horizon", (F.row_number().over(along) - 1).alias("i"), F.col(value).alias("x"))
    sizes = line.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.join(series.sparkSession.range(reps).withColumnRenamed("id", "rep"))  # a stated set of replicates against one row a horizon
    plan = plan.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("block").cast("string"))), 1, 8), 16, 10).cast("long")
    plan = plan.withColumn("start", start % F.col("n")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    plan = plan.where(F.col("block") * block + F.col("step") < F.col("n")).withColumn("i", (F.col("start") + F.col("step")) % F.col("n"))
    means = plan.select("horizon", "rep", "i").join(line, ["horizon", "i"]).groupBy("horizon", "rep").agg(F.avg("x").alias("mean"))
    tail = (1 - level) / 2
    bounds = means.groupBy("horizon").agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))  # reps values
    return line.groupBy("horizon").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("dates")).join(bounds, "horizon")


def gathered_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (kind, horizon, date, security_id, score, fwd_return) as a row a key, with ``all`` (kind, score)."""
    return candidates.groupBy("horizon", "date", "security_id").agg(F.collect_set(F.struct("kind", "score")).alias("all"), F.max("fwd_return").alias("fwd_return"))


def _scored_by_all(gathered: DataFrame, kinds: int) -> DataFrame:
    scored = gathered.withColumn("all", F.filter("all", lambda one: one["score"].isNotNull()))
    return scored.where(F.size("all") == kinds)


def common_universe(candidates: DataFrame, kinds: int) -> DataFrame:
    """Rows (kind, horizon, date, security_id, score) of keys that every one of the ``kinds`` candidates scored."""
    keys = ["horizon", "date", "security_id"]
    whole = _scored_by_all(gathered_candidates(candidates.where("score IS NOT NULL")), kinds)
    return whole.select(*keys, "fwd_return", F.explode("all").alias("one")).select(*keys, "fwd_return", "one.*")


def gathered_ic(gathered: DataFrame, kinds: int, least: int = 20) -> DataFrame:
    """Daily rank correlation of each candidate on keys that all ``kinds`` scored; rows (horizon, date, fwd_return, all), unique by key.

    The outcomes' ranks are the same for all candidates, so they are made before the scores are unfolded.
    """
    whole = _scored_by_all(gathered.where("fwd_return IS NOT NULL").select("horizon", "date", "fwd_return", "all"), kinds)
    ranked = whole.select("horizon", "date", "all", average_rank(F.col("fwd_return"), "horizon", "date").alias("f"))
    long = ranked.select("horizon", "date", "f", F.explode("all").alias("one")).select("horizon", "date", "f", "one.*")
    by = ("kind", "horizon")
    return correlations(long.select(*by, "date", average_rank(F.col("score"), *by, "date").alias("s"), "f"), least, by)


def candidate_ic(candidates: DataFrame, kinds: int) -> DataFrame:
    """Daily rank correlation of each candidate on the common universe; candidates as long rows."""
    return gathered_ic(gathered_candidates(candidates.where("score IS NOT NULL")), kinds)


def paired_difference(ic: DataFrame, a: str, b: str) -> DataFrame:
    """(horizon, date, difference) of two candidates on dates that have both."""
    both = ic.groupBy("horizon", "date").agg(F.max(F.when(F.col("kind") == a, F.col("rank_ic"))).alias("a"), F.max(F.when(F.col("kind") == b, F.col("rank_ic"))).alias("b"))
    return both.select("horizon", "date", (F.col("a") - F.col("b")).alias("difference")).where("difference IS NOT NULL")


def ic_table(ic: DataFrame) -> DataFrame:
    """Mean, mean over deviation (null where that is 0), and share of positive dates of each candidate and horizon."""
    return ic.groupBy("kind", "horizon").agg(
        F.avg("rank_ic").alias("mean_ic"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("ratio"), F.avg((F.round("rank_ic", 9) > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("dates")
    )


def nested_selection(ic: DataFrame, order: dict[str, int]) -> DataFrame:
    """For each outer year the candidate with the best mean annual correlation in the years before; ties by the declared order."""
    # read three times and a row a candidate, horizon and year: written, so the correlations are made once
    yearly = written(ic.groupBy("kind", "horizon", F.year("date").alias("year")).agg(F.avg("rank_ic").alias("annual")), "yearly")
    inner = yearly.alias("i").join(yearly.select("horizon", F.col("year").alias("outer_year")).distinct().alias("o"), "horizon").where("year < outer_year")
    place = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    stats = inner.groupBy("horizon", "outer_year", "kind").agg(
        F.avg("annual").alias("inner_mean"), F.median("annual").alias("inner_median"), F.min("annual").alias("inner_worst"), F.count_if(F.round("annual", 9) > 0).alias("positive_years")
    )
    best = Window.partitionBy("horizon", "outer_year").orderBy(F.desc("inner_mean"), place)
    chosen = stats.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    return chosen.join(yearly.select("horizon", "kind", F.col("year").alias("outer_year"), F.col("annual").alias("outer_ic")), ["horizon", "kind", "outer_year"], "left")


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each (metric, horizon) against its threshold (metric, least); a missing metric fails. Thresholds are a declared list."""
    met = metrics.join(F.broadcast(thresholds), "metric", "right")
    return met.select("metric", "horizon", "actual", "least", F.coalesce(F.col("actual") >= F.col("least"), F.lit(False)).alias("passed"))


def status_coverage(rows: DataFrame, as_of: str) -> DataFrame:
    """Counts per horizon: rows, mature, immature and pending labels, and status ok."""
    end, at = F.col("label_end"), F.lit(as_of).cast("date")
    return rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(end <= at).alias("mature"), F.count_if(end > at).alias("immature"), F.count_if(end.isNull()).alias("pending"),
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if((end <= at) & F.col("fwd_return").isNull()).alias("mature_without_return"),
    )
