"""One prediction head a task: metrics on common samples, the choice against simple candidates, the combined forecast.

Candidates come as long rows, unique by (kind, date, security_id, horizon), with the outputs and the status of each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.order import bin_sums
from panelworks.operators.cross_section import daily_ic
from panelworks.operators.models import LEVELS, REJECTED

# fixed values: tasks with their outputs and the columns of their status
OUTPUTS = {
    "score": ("score",),
    "probability_up": ("probability_up", "baseline_probability"),
    "intervals": ("q10", "q50", "q90", "baseline_q10", "baseline_q50", "baseline_q90"),
    "expected_return": ("expected_return",),
}
STATUS = {"score": "score_status", "probability_up": "probability_status", "intervals": "interval_status", "expected_return": "return_status"}
NO_INPUTS = "insufficient_model_inputs"
KEYS = ("date", "security_id", "horizon")


def common_samples(candidates: DataFrame, kinds: int, as_of: str) -> DataFrame:
    """Adds ``mature_<task>`` and ``common_<task>``: the row can be measured, and so can the key's rows of all ``kinds``.

    Measured are rows whose task is ok and whose outcome is finite, not below -1 and complete by ``as_of``. Tasks do not
    affect each other. One shuffle by key; no group holds more rows than there are candidates.
    """
    y = F.col("fwd_return")
    legal = F.coalesce((y >= -1) & (y < float("inf")) & ~F.isnan(y) & (F.col("label_end") <= F.lit(as_of).cast("date")), F.lit(False))
    out = candidates.withColumns({f"mature_{t}": legal & F.coalesce(F.col(s) == "ok", F.lit(False)) for t, s in STATUS.items()})
    of_key = Window.partitionBy(*KEYS)
    return out.withColumns({f"common_{t}": F.count_if(f"mature_{t}").over(of_key) == kinds for t in OUTPUTS})


def task_coverage(common: DataFrame) -> DataFrame:
    """Rows of each task, horizon, candidate and year: all, scorable, mature, without inputs, rejected, common to all candidates."""
    each = [
        F.struct(
            F.lit(t).alias("task"), F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col(s) == "ok").alias("scorable_rows"), F.count_if(f"mature_{t}").alias("mature_rows"),
            F.count_if(F.col(s) == NO_INPUTS).alias("input_unavailable_rows"), F.count_if(F.col(s).isin(*REJECTED)).alias("model_rejected_rows"), F.count_if(f"common_{t}").alias("common_rows"),
        )
        for t, s in STATUS.items()
    ]
    counts = common.groupBy("horizon", "kind", F.year("date").alias("year")).agg(F.array(*each).alias("each"))
    return counts.select("horizon", "kind", "year", F.explode("each").alias("x")).select("horizon", "kind", "year", "x.*")


def _calibration_error(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    bins = bin_sums(rows.select(*keys, "date", "security_id", "probability_up", "up"), keys, "probability_up", ("date", "security_id"), ("probability_up", "up"), 10, 1e-5)
    bins = bins.select(*keys, "n", (F.col("probability_up") / F.col("n")).alias("p"), (F.col("up") / F.col("n")).alias("o"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n")).alias("ece"))


def component_metrics(common: DataFrame) -> DataFrame:
    """Figures of each candidate by horizon and ``period`` (a year, or ``all``) over the samples common to all candidates.

    Mean daily rank correlation, Brier score, mean pinball loss and squared error with the baselines', coverage and
    calibration error in ten equal bins; all years weigh by their rows (correlations by their dates). Null without samples.
    """
    keys = ("horizon", "kind", "period")
    y = F.col("fwd_return")
    rows = common.withColumns({"period": F.year("date").cast("string"), "up": (y > 0).cast("double")})

    def total(task, value):
        return F.sum(F.when(F.col(f"common_{task}"), value))

    def pinball(prefix):
        errors = [(q, y - F.col(f"{prefix}q{round(q * 100)}")) for q in LEVELS]
        return sum(F.greatest(q * e, (q - 1) * e) for q, e in errors) / len(errors)

    sums = rows.groupBy(*keys).agg(
        *(F.count_if(f"common_{t}").alias(f"{t}_samples") for t in OUTPUTS),
        total("probability_up", (F.col("probability_up") - F.col("up")) ** 2).alias("probability_up"),
        total("probability_up", (F.col("baseline_probability") - F.col("up")) ** 2).alias("baseline_brier"),
        total("intervals", pinball("")).alias("intervals"),
        total("intervals", pinball("baseline_")).alias("baseline_pinball"),
        total("intervals", ((y >= F.col("q10")) & (y <= F.col("q90"))).cast("double")).alias("interval_coverage"),
        total("expected_return", (F.col("expected_return") - y) ** 2).alias("expected_return"),
    )
    daily = daily_ic(rows.where("common_score"), by=("horizon", "kind"))
    yearly = daily.groupBy("horizon", "kind", F.year("date").cast("string").alias("period")).agg(F.sum("rank_ic").alias("score"), F.count(F.lit(1)).alias("score_dates"))
    met = sums.join(yearly, list(keys), "left").na.fill(0, ["score_dates"])
    figures = [c for c in met.columns if c not in keys]
    met = met.withColumn("period", F.explode(F.array("period", F.lit("all")))).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in figures))
    known = rows.where("common_probability_up")
    errors = _calibration_error(known, keys).unionByName(_calibration_error(known.withColumn("period", F.lit("all")), keys))
    over = {
        "score": "score_dates", "probability_up": "probability_up_samples", "baseline_brier": "probability_up_samples", "intervals": "intervals_samples",
        "baseline_pinball": "intervals_samples", "interval_coverage": "intervals_samples", "expected_return": "expected_return_samples",
    }
    counts = [c for c in figures if c not in over]
    return met.join(errors, list(keys), "left").select(*keys, *counts, *(F.when(F.col(n) > 0, F.col(c) / F.col(n)).alias(c) for c, n in over.items()), "ece")


def choose_heads(metrics: DataFrame, coverage: DataFrame, kinds: list[str], years: list[int], simple: tuple[str, ...] = ("factor", "linear"), least_wins: float = 0.6) -> DataFrame:
    """(horizon, task, kind, loss, base): the candidate that serves each task of each horizon; kind is null where none qualifies.

    A candidate needs figures for all ``years`` and overall. The better of the ``simple`` ones is the base; another must beat
    it overall and in ``least_wins`` of the years. Rejected outputs disqualify; probabilities must beat the baseline with a
    calibration error of 0.05 at most, intervals must beat theirs and cover 75% to 85%. The least loss wins (a correlation
    is a negative loss), ties go to the simple ones and then to the declared order.
    """
    gates = {
        "probability_up": (F.col("probability_up") < F.col("baseline_brier")) & (F.col("ece") <= 0.05),
        "intervals": (F.col("intervals") < F.col("baseline_pinball")) & F.col("interval_coverage").between(0.75, 0.85),
    }
    each = [
        F.struct(F.lit(t).alias("task"), (-F.col(t) if t == "score" else F.col(t)).alias("loss"), F.coalesce(gates.get(t, F.lit(True)), F.lit(False)).alias("gate"))
        for t in OUTPUTS
    ]
    long = metrics.select("horizon", "kind", "period", F.explode(F.array(*each)).alias("x")).select("horizon", "kind", "period", "x.*")
    overall = F.col("period") == "all"
    wide = long.groupBy("horizon", "task", "kind").agg(
        F.max(F.when(overall, F.col("loss"))).alias("loss"), F.max(F.when(overall, F.col("gate"))).alias("gate"),
        F.array(*(F.max(F.when(F.col("period") == str(y), F.col("loss"))) for y in years)).alias("annual"),
    )
    rejected = coverage.groupBy("horizon", "task", "kind").agg(F.sum("model_rejected_rows").alias("rejected"))
    order = [*simple, *(k for k in kinds if k not in simple)]
    met = wide.join(rejected, ["horizon", "task", "kind"]).withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("kind")))
    plain = F.col("kind").isin(*simple)
    met = met.withColumn("usable", F.col("loss").isNotNull() & ~F.exists("annual", lambda x: x.isNull()))
    base = F.min(F.when(F.col("usable") & plain, F.struct("loss", "place", "kind", "annual"))).over(Window.partitionBy("horizon", "task"))
    met = met.withColumn("base", base)
    wins = F.size(F.filter(F.zip_with("annual", "base.annual", lambda a, b: a < b), lambda won: won)) / len(years)
    beats = (wins >= least_wins) & (F.col("loss") < F.col("base.loss"))
    fit = F.col("usable") & F.col("gate") & (F.col("rejected") == 0) & (plain | F.coalesce(beats, F.lit(False))) & F.col("base").isNotNull()
    best = met.groupBy("horizon", "task").agg(F.min(F.when(fit, F.struct("loss", "place", "kind"))).alias("best"), F.max("base.kind").alias("base"))
    return best.select("horizon", "task", "best.kind", "best.loss", "base")


def combine_heads(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """One row a key: each task's outputs and status from the candidate chosen for its horizon, and the status of all tasks.

    A task that failed in its chosen candidate keeps its status and has no outputs; it never turns to another candidate.
    Tasks without a chosen candidate lack inputs. Rejections take precedence over missing inputs, the last named first.
    """
    chosen = heads.groupBy("horizon").agg(*(F.max(F.when(F.col("task") == t, F.col("kind"))).alias(f"_{t}") for t in OUTPUTS))
    met = candidates.join(F.broadcast(chosen), "horizon", "left")  # one row a horizon
    found = []
    for t, s in STATUS.items():
        own = F.col("kind") == F.col(f"_{t}")
        found.append(F.coalesce(F.max(F.when(own, F.col(s))), F.lit(NO_INPUTS)).alias(s))
        found += [F.max(F.when(own & (F.col(s) == "ok"), F.col(c))).alias(c) for c in OUTPUTS[t]]
    out = met.groupBy(*KEYS).agg(*found)
    every, ladder = F.array(*STATUS.values()), F.lit("ok")
    for status in (NO_INPUTS, "unrepresentable_prediction", "invalid_return_range", "invalid_quantile_order"):
        ladder = F.when(F.array_contains(every, status), status).otherwise(ladder)
    return out.withColumn("status", ladder)
