"""Aliases, reconciliation of sources, gap fills, listing periods, reporting currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.dates import on_days
from panelworks.operators import cross_section as xs
from panelworks.sources.store import written


def alias_closure(aliases: DataFrame) -> DataFrame:
    """(old, code): the last code of each chain, however long; cycles are refused.

    ``aliases`` (old, new) is unique by old. Every round doubles the reach, so a chain of n steps takes log2(n) rounds, and one that
    goes on for more rounds than there are bits in the number of aliases is a cycle. Each round is written, so plans stay short.
    """
    now = aliases.where("old <> new").select("old", F.col("new").alias("code"))
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        if not _has_chain(now):
            return now
        further = now.select(F.col("old").alias("code"), F.col("code").alias("further"))
        now = written(now.join(further, "code", "left").select("old", F.coalesce("further", "code").alias("code")), "aliases")
    if _has_chain(now):
        raise ValueError("alias chains are cyclic")
    return now


def _has_chain(now: DataFrame) -> bool:
    return bool(now.join(now.select(F.col("old").alias("code")), "code", "left_semi").head(1))


def canonical(rows: DataFrame, closed: DataFrame, values: list[str], factor: str) -> DataFrame:
    """One row per (security_id, date) under canonical codes, with ``decision``.

    Equal rows collapse; where only ``factor`` differs by at most 0.0005 and some are rounded to three decimals, a
    finer one stays; any other difference is a conflict (null values, for the error table).
    """
    mapped = rows.join(closed.withColumnRenamed("old", "security_id"), "security_id", "left")
    mapped = mapped.select(F.coalesce("code", "security_id").alias("id"), F.col("security_id").alias("source_id"), "date", factor, *values)
    coarse = F.abs(F.col(factor) * 1000 - F.round(F.col(factor) * 1000)) <= 1e-8
    # the preferred source: a finer factor, then the canonical code, then the smallest
    order = F.struct(coarse.cast("int"), (F.col("source_id") != F.col("id")).cast("int"), "source_id")
    found = mapped.groupBy("id", "date").agg(
        F.count(F.lit(1)).alias("sources"), F.min_by(F.struct("source_id", factor, *values), order).alias("best"), F.max(coarse).alias("some_coarse"), F.min(coarse).alias("all_coarse"),
        F.array_contains(F.array(*(~F.min(F.struct(v)).eqNullSafe(F.max(F.struct(v))) for v in values)), True).alias("differ"), (F.max(factor) - F.min(factor)).alias("range"),
    )
    bounded = (F.col("range") <= 0.0005000001) & F.col("some_coarse") & ~F.col("all_coarse")
    decision = F.when(F.col("sources") == 1, "single").when(F.col("differ"), "conflict").when(F.coalesce("range", F.lit(0.0)) == 0, "equal").when(bounded, "finer_factor").otherwise("conflict")
    kept = [F.when(F.col("decision") != "conflict", F.col(f"best.{c}")).alias(c) for c in (factor, *values)]
    return found.withColumn("decision", decision).select(F.col("id").alias("security_id"), "date", "sources", "decision", *kept)


def reconciled(primary: DataFrame, reference: DataFrame) -> DataFrame:
    """Two sources of (security_id, date, close, volume, amount): a class for each key.

    Keys found twice on a side are ambiguous; closes are compared as 32-bit floats; amounts may agree below one unit.
    """

    def side(df, name):
        columns = ("close", "volume", "amount")
        return df.groupBy("security_id", "date").agg(F.count(F.lit(1)).alias(f"{name}_rows"), *(F.max(c).alias(f"{name}_{c}") for c in columns))

    both = side(primary, "p").join(side(reference, "r"), ["security_id", "date"], "full_outer")
    same = F.coalesce((F.col("p_close").cast("float") == F.col("r_close").cast("float")) & (F.col("p_volume") == F.col("r_volume")), F.lit(False))
    gap = F.abs(F.col("p_amount") - F.col("r_amount"))
    status = (
        F.when(F.col("p_rows").isNull(), "reference_only").when(F.col("r_rows").isNull(), "primary_only").when((F.col("p_rows") > 1) | (F.col("r_rows") > 1), "ambiguous")
        .when(same & (gap == 0), "exact").when(same & (gap < 1), "below_one_unit").otherwise("mismatch")
    )
    return both.select("security_id", "date", status.alias("status"), gap.alias("amount_gap"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Primary rows, and those of the fallback whose keys it lacks, with their ``origin``."""
    extra = fallback.join(primary.select(*keys), keys, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(extra.withColumn("origin", F.lit("fallback")))


def with_gap_fills(rows: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and explicit fills; fills that meet an existing row, or each other, are refused."""
    if fills.join(rows.select(*keys), keys, "left_semi").head(1) or fills.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError("gap fills overlap existing rows")
    return rows.unionByName(fills)


def universe_asof(master: DataFrame, days: DataFrame) -> DataFrame:
    """(date, security_id) of securities that are listed and not yet delisted on each day of ``days`` (date)."""
    return on_days(master.select("security_id", "list_date", "delist_date"), days.select("date"), "list_date", "delist_date").select("date", "security_id")


def observed_periods(bars: DataFrame) -> DataFrame:
    traded = F.when(F.col("volume") > 0, F.col("date"))
    return bars.groupBy("security_id").agg(F.min(traded).alias("first_quote"), F.max(traded).alias("last_quote"), F.count(traded).alias("quotes"))


def reporting_currency(rows: DataFrame, rates: DataFrame, base: str, columns: list[str]) -> DataFrame:
    """Columns times the rate of (date, currency); the base currency's rate is 1, a missing rate gives null."""
    met = rows.join(rates, ["date", "currency"], "left")
    rate = F.when(F.col("currency") == base, 1.0).otherwise(F.col("rate"))
    return met.withColumns({c: F.col(c) * rate for c in columns}).drop("rate")


def identity_classes(evidence: DataFrame) -> DataFrame:
    """Each isin's issue: unique, conflict, or missing."""
    found = evidence.groupBy("isin").agg(F.count_distinct("issue").alias("issues"), F.min("issue").alias("issue"))
    return found.select("isin", "issues", F.when(F.col("issues") == 1, F.col("issue")).alias("issue"), F.when(F.col("issues") == 0, "missing").when(F.col("issues") == 1, "unique").otherwise("conflict").alias("status"))


def append_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new versions without repeats; one version with different facts is refused."""
    both = old.unionByName(new).dropDuplicates()
    if both.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError("a version has different facts")
    return both


def apply_label_patches(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Missing returns taken from patches with the same label end; ``patched`` tells which. Patches are unique by key."""
    named = patches.select("date", "security_id", "horizon", F.col("label_end").alias("_end"), F.col("new_fwd_return").alias("_new"))
    met = rows.join(named, ["date", "security_id", "horizon"], "left")
    fits = F.coalesce(F.col("fwd_return").isNull() & F.col("label_end").eqNullSafe(F.col("_end")) & F.col("_new").isNotNull(), F.lit(False))
    return met.withColumn("patched", fits).withColumn("fwd_return", F.when(F.col("patched"), F.col("_new")).otherwise(F.col("fwd_return"))).drop("_end", "_new")


def patched_examples(factors: DataFrame, patches: DataFrame) -> DataFrame:
    """The examples of ``factors`` (a row a date and security) with apply_label_patches done before horizons are unfolded.

    A row meets its patches of all horizons once, so a quarter of the rows is dealt and sorted.
    """
    per = {h: F.col("horizon") == h for h in xs.HORIZONS}
    wide = patches.groupBy("date", "security_id").agg(
        *(F.max(F.when(at, F.col("label_end"))).alias(f"_end_{h}") for h, at in per.items()), *(F.max(F.when(at, F.col("new_fwd_return"))).alias(f"_new_{h}") for h, at in per.items())
    )
    met = factors.select("date", "security_id", *xs.LABELS).join(wide, ["date", "security_id"], "left")
    fits = {h: F.col(f"fwd_return_{h}").isNull() & F.col(f"label_end_{h}").eqNullSafe(F.col(f"_end_{h}")) & F.col(f"_new_{h}").isNotNull() for h in xs.HORIZONS}
    patched = F.create_map(*(x for h, fit in fits.items() for x in (F.lit(h), F.coalesce(fit, F.lit(False)))))
    met = met.withColumns({"patched": patched} | {f"fwd_return_{h}": F.when(fit, F.col(f"_new_{h}")).otherwise(F.col(f"fwd_return_{h}")) for h, fit in fits.items()})
    return xs.examples(met, "patched").withColumn("patched", F.col("patched")[F.col("horizon")])


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, count): rows that break each rule, a boolean SQL expression that must hold; null breaks it."""
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.expr(e), F.lit(False)).alias("holds")) for n, e in rules.items()))
    return rows.select(F.explode(each).alias("x")).groupBy("x.rule").agg(F.count_if(~F.col("x.holds")).alias("broken"), F.count(F.lit(1)).alias("rows"))


def latest_visible(versions: DataFrame, cutoff) -> DataFrame:
    """The last version of each (security_id, event_id) published by the cutoff."""
    last = Window.partitionBy("security_id", "event_id").orderBy(F.desc("published_at"), F.desc("version"))
    return versions.where(F.col("published_at") <= F.lit(cutoff)).withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")
