"""Dividend schedules of a provider: every row judged, versions of one event resolved, and the part that selected names need."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.operators.intake import SHARE_FORM
from panelworks.sources.store import written

# Texts for no value, the state of a final schedule, words for no and words of events that no cash factor describes.
MISSING = ("", "none", "null", "nan", "nat", "<na>")
FINAL = "实施"
NO = ("false", "0", "0.0", "no", "n")
SPECIAL_WORDS = ("差异化", "回购", "配股", "rights", "differential", "buyback", "excluded")
DATES = ("end_date", "ann_date", "imp_ann_date", "record_date", "ex_date", "pay_date", "list_date", "base_date")
NUMBERS = ("gross", "net", "stock", "bonus", "converted", "base_share")


def _known(name: str) -> Column:
    """The trimmed text of a raw column, null where it stands for no value."""
    text = F.trim(F.col(name).cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def _date(name: str) -> Column:
    text = _known(name)
    forms = {r"^\d{8}$": "yyyyMMdd", r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd"}
    return F.coalesce(*(F.when(text.rlike(p), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for p, f in forms.items()))


def _number(name: str) -> Column:
    value = _known(name).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _parsed(raw: DataFrame, closed: DataFrame) -> DataFrame:
    """Raw rows under canonical codes: dates read into columns ``d_``, numbers into ``n_`` (plain columns: fields of a struct would be read again at each use)."""
    named = raw.join(closed.select(F.col("old").alias("source_code"), "code"), "source_code", "left")
    return named.select(
        F.coalesce("code", "source_code").alias("security_id"), *raw.columns,
        *(_date(c).alias(f"d_{c}") for c in DATES), *(_number(c).alias(f"n_{c}") for c in NUMBERS),
    )


def _stock_reasons() -> dict[str, Column]:
    """Share distributions: only an explicit zero, nowhere contradicted, is accepted."""
    total, parts = F.col("n_stock"), [F.col("n_bonus"), F.col("n_converted")]
    zero, unknown = _is(total == 0), reduce(or_, (c.isNull() for c in (total, *parts)))
    told_otherwise = reduce(or_, (_known(c).isNotNull() & ~_is(F.col(f"n_{c}") == 0) for c in ("bonus", "converted")))
    whole = parts[0] + parts[1]
    unequal = F.abs(total - whole) > F.greatest(F.greatest(F.abs(total), F.abs(whole)) * 1e-8, F.lit(1e-10))
    wrong = reduce(or_, (_is(c < 0) for c in (total, *parts))) | _is(unequal)
    return {
        "inconsistent_stock_distribution": (zero & told_otherwise) | (~zero & ~unknown & wrong), "missing_stock_distribution_fields": ~zero & unknown,
        "unsupported_stock_distribution": ~zero & ~unknown & ~wrong, "ambiguous_stock_distribution": zero & F.col("d_list_date").isNotNull(),
    }


def _row_reasons(asof: str | None) -> Column:
    """All that speaks against a row by itself, sorted."""
    d, n = (lambda c: F.col(f"d_{c}")), (lambda c: F.col(f"n_{c}"))
    unread = lambda c: _known(c).isNotNull() & d(c).isNull()
    absent = {"imp_ann_date": "missing_implementation_publication", "record_date": "missing_record_date", "ex_date": "missing_ex_date", "pay_date": "missing_payment_date"}
    special = _is(~F.lower(_known("special")).isin(*NO)) | _is(_known("note").rlike(f"(?i){'|'.join(SPECIAL_WORDS)}"))
    rules = {
        "invalid_security_id": ~_is(F.col("source_code").rlike(SHARE_FORM)), "not_implemented": ~_is(F.trim("state") == FINAL),
        **{f"invalid_{c}": unread(c) for c in DATES}, **{r: _known(c).isNull() for c, r in absent.items()},
        "publication_not_before_record": d("imp_ann_date") >= d("record_date"), "proposal_after_implementation_publication": d("ann_date") > d("imp_ann_date"),
        "invalid_event_dates": _is(d("record_date") >= d("ex_date")) | _is(d("pay_date") < d("ex_date")) | _is(d("list_date") < d("ex_date")),
        "not_yet_visible": F.date_add(d("imp_ann_date"), 1) > F.lit(asof).cast("date"),
        "invalid_gross_cash": n("gross").isNull() | (n("gross") < 0), "no_cash_distribution": n("gross") == 0,
        "inconsistent_provider_after_tax_cash": _known("net").isNotNull() & (n("net").isNull() | (n("net") < 0) | _is(n("net") > n("gross") + 1e-10)),
        **_stock_reasons(),
        "invalid_distribution_basis": (_known("base_share").isNotNull() & ~_is(n("base_share") > 0)) | _is(d("base_date") > d("record_date")),
        "unsupported_rights_or_differential_event": special,
    }
    return F.array_sort(F.filter(F.array(*(F.when(_is(c), r) for r, c in rules.items())), lambda x: x.isNotNull()))


def _terms() -> Column:
    """What two equal versions agree in: all dates but that of the proposal, and all figures; parts of a plain zero are zero."""
    plain = _is(F.col("n_stock") == 0) & ~F.array_contains("own", "inconsistent_stock_distribution")
    figures = [F.when(plain, 0.0).otherwise(F.col(f"n_{c}")).alias(c) if c in ("bonus", "converted") else F.col(f"n_{c}").alias(c) for c in NUMBERS if c != "base_share"]
    return F.struct(*(F.col(f"d_{c}").alias(c) for c in DATES if c != "ann_date"), *figures, F.col("base_share"))


def _several(least: str, most: str, known: str, rows: str) -> Column:
    """More than one value in a group, null counted as one."""
    return _is(F.col(least) != F.col(most)) | ((F.col(known) > 0) & (F.col(known) < F.col(rows)))


def judged_dividends(raw: DataFrame, closed: DataFrame, asof: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedules, rejected): one accepted row a security and ex-date, and every other raw row with its reasons.

    ``raw`` (source_code, state, the DATES and NUMBERS as texts, special, note); ``closed`` (old, code) maps old codes to the last, as
    ``alias_closure`` gives it. A schedule is known from the day after its publication; with ``asof`` later ones are not yet visible.
    Of one (security, ex-date) the last published version counts, if it was out before the entitlement, all versions are of one fiscal period
    and equals of that day agree; otherwise all are conflicts. A fiscal period with two ex-dates is ambiguous. Equal rows are merged
    and counted. Judged rows are written once: three aggregations and joins read them, and filters on reasons must not be pushed into
    the parsing of every date. Groups are built by partial aggregation, first by version and then by event, so that a hot event is never gathered.
    """
    rows = _parsed(raw, closed).withColumn("own", _row_reasons(asof))
    rows = written(rows.withColumns({"terms": _terms(), "open": F.arrays_overlap("own", F.array(F.lit("not_implemented"), F.lit("not_yet_visible"))), "ex": F.col("d_ex_date"), "out": F.col("d_imp_ann_date"), "end": F.col("d_end_date")}), "dividends")
    periods = rows.where("NOT open AND end IS NOT NULL").groupBy("security_id", "end").agg(F.min("ex").alias("a"), F.max("ex").alias("b"), F.count("ex").alias("k"), F.count(F.lit(1)).alias("n_rows"))
    ambiguous = periods.where(_several("a", "b", "k", "n_rows")).select("security_id", "end", F.lit(True).alias("ambiguous"))
    rows = rows.join(ambiguous, ["security_id", "end"], "left")
    rows = rows.withColumn("own", F.when(F.col("ambiguous"), F.array_append("own", F.lit("ambiguous_period_schedule"))).otherwise(F.col("own")))
    fit = rows.where("NOT open AND ex IS NOT NULL").withColumn("late", F.array_contains("own", "publication_not_before_record"))
    order = F.struct(F.col("source_code") != F.col("security_id"), "source_code")
    versions = fit.groupBy("security_id", "ex", "out").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("terms").alias("low"), F.max("terms").alias("high"), F.max(F.size("own") > 0).alias("bad"), F.max("late").alias("late"),
        F.min("end").alias("a"), F.max("end").alias("b"), F.count("end").alias("k"), F.min("d_record_date").alias("record"),
        F.min_by(F.struct("source_code", "terms"), order).alias("best"), F.array_sort(F.collect_set("source_code")).alias("sources"),
    )
    last = F.struct("n_rows", "low", "high", "bad", "best", "sources")
    events = versions.groupBy("security_id", "ex").agg(
        F.sum("n_rows").alias("n_rows"), F.max(F.col("out").isNull() | F.col("late")).alias("undated"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum("k").alias("k"),
        F.max("out").alias("latest"), F.min("record").alias("record"), F.max_by(last, F.coalesce("out", F.lit("0001-01-01").cast("date"))).alias("last"), F.count(F.lit(1)).alias("versions"),
    )
    clash = ((F.col("n_rows") > 1) & (F.col("undated") | _is(F.col("latest") >= F.col("record")))) | _several("a", "b", "k", "n_rows") | ~F.col("last.low").eqNullSafe(F.col("last.high"))
    events = events.withColumn("fate", F.when(clash, "conflict").when(F.col("last.bad"), "invalid").otherwise("accepted"))
    best = F.col("last.best.terms")
    schedules = events.where("fate = 'accepted'").select(
        F.substring(F.sha2(F.concat_ws("|", "security_id", F.col("ex").cast("string"), F.to_json(best)), 256), 1, 24).alias("action_id"), "security_id", F.col("latest").alias("ann_date"), best["record_date"].alias("record_date"),
        F.col("ex").alias("ex_date"), best["pay_date"].alias("pay_date"), best["gross"].alias("gross"), best["net"].alias("net"), F.date_add("latest", 1).alias("available_from"), F.col("last.best.source_code").alias("source_code"),
        F.array_join("last.sources", ",").alias("sources"), F.col("last.n_rows").alias("merged"), "versions",
    )
    fates = events.select("security_id", "ex", "fate", "latest")
    met = rows.join(fates, ["security_id", "ex"], "left").withColumn("fate", F.when(~F.col("open"), F.col("fate")))
    older = ~F.col("out").eqNullSafe(F.col("latest"))
    added = F.when(F.col("fate") == "conflict", "conflicting_final_versions").when((F.col("fate") == "invalid") & (F.size("own") == 0), "invalid_final_version").when((F.col("fate") == "accepted") & older, "superseded_provider_version")
    rejected = met.where(F.col("fate").isNull() | (F.col("fate") != "accepted") | older)
    reasons = F.array_join(F.array_sort(F.array_compact(F.array_append("own", added))), ";")
    return schedules, rejected.select(*raw.columns, "security_id", reasons.alias("reasons"))


def selected_dividends(raw: DataFrame, closed: DataFrame, selected: DataFrame, row_limit: int, asof: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(schedules, coverage) of ``selected`` (security_id) names only, whatever code of theirs the provider used.

    Coverage (security_id, sources, empty, capped, schedules, status): a code without any row, or with ``row_limit`` rows or more (the
    provider's own limit, so that more may exist), makes a name incomplete; a name that is no share is refused. The limit drops no row.
    """
    names = selected.join(closed.withColumnRenamed("old", "security_id"), "security_id", "left").select(F.coalesce("code", "security_id").alias("security_id")).distinct()
    old = closed.join(names.withColumnRenamed("security_id", "code"), "code", "left_semi").select(F.col("old").alias("source_code"), F.col("code").alias("security_id"))
    sources = names.select(F.col("security_id").alias("source_code"), "security_id").unionByName(old).distinct()
    mine = raw.join(sources, "source_code", "left_semi")
    schedules, _ = judged_dividends(mine, closed, asof)
    counts = mine.groupBy("source_code").agg(F.count(F.lit(1)).alias("n_rows"))
    each = sources.join(counts, "source_code", "left").groupBy("security_id").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("n_rows").isNull()).alias("empty"), F.count_if(F.col("n_rows") >= row_limit).alias("capped"))
    found = each.join(schedules.groupBy("security_id").agg(F.count(F.lit(1)).alias("schedules")), "security_id", "left")
    status = F.when(~_is(F.col("security_id").rlike(SHARE_FORM)), "not_a_share").when((F.col("empty") > 0) | (F.col("capped") > 0), "incomplete").otherwise("complete")
    return schedules, found.select("security_id", "sources", "empty", "capped", F.coalesce("schedules", F.lit(0)).alias("schedules"), status.alias("status"))
