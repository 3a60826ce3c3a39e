"""Readers of vendor formats: chart JSON, CSV with rules, two-line quotations, wide dividends; unit scales; writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHART = """chart struct<result: array<struct<
  meta: struct<symbol: string, currency: string, exchangeTimezoneName: string>, timestamp: array<bigint>,
  indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"""
_FIELDS = ("open", "high", "low", "close", "volume")


def chart_bars(payloads: DataFrame) -> DataFrame:
    """Daily bars of chart payloads (symbol, json) with quote and validity flags; ``problem`` names a refused payload.

    A refused payload gives one row without a date: no result, another symbol, another currency than USD, or arrays
    of unequal lengths.
    """
    one = payloads.select("symbol", F.from_json("json", _CHART).alias("j")).select("symbol", F.try_element_at("j.chart.result", F.lit(1)).alias("r"))
    quote, adjusted = F.try_element_at("r.indicators.quote", F.lit(1)), F.try_element_at("r.indicators.adjclose", F.lit(1))
    flat = one.select("symbol", "r.meta", "r.timestamp", *(quote[c].alias(c) for c in _FIELDS), adjusted["adjclose"].alias("adj_close"))
    lengths = F.array_distinct(F.array(F.size("timestamp"), *(F.size(c) for c in (*_FIELDS, "adj_close"))))
    problem = (
        F.when(F.col("timestamp").isNull(), "no_history").when(~F.col("meta.symbol").eqNullSafe(F.col("symbol")), "symbol_mismatch")
        .when(~F.col("meta.currency").eqNullSafe(F.lit("USD")), "currency").when(F.size(lengths) > 1, "array_lengths")
    )
    flat = flat.withColumn("problem", problem)
    zipped = F.when(F.col("problem").isNull(), F.arrays_zip("timestamp", *_FIELDS, "adj_close"))
    rows = flat.select(F.col("symbol").alias("security_id"), "problem", F.col("meta.exchangeTimezoneName").alias("zone"), F.explode_outer(zipped).alias("b"))
    rows = rows.select("security_id", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.timestamp"), F.coalesce("zone", F.lit("UTC")))).alias("date"), *(f"b.{c}" for c in (*_FIELDS, "adj_close")), "problem")
    prices = [F.col(c) for c in ("open", "high", "low", "close", "adj_close")]
    positive = F.forall(F.array(*prices), lambda x: F.coalesce(~F.isnan(x) & (x > 0) & (x < float("inf")), F.lit(False)))
    ordered = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    return rows.withColumns({
        "quote_present": F.coalesce((F.col("volume") > 0) & F.col("close").isNotNull(), F.lit(False)),
        "data_valid": F.coalesce(positive & ordered & (F.col("volume") >= 0), F.lit(False)),
        "dollar_volume": F.col("close") * F.col("volume"),
    })


def csv_records(spark: SparkSession, path: str, schema: str, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, gaps): rows of a CSV with a header that fit the schema and all rules; the others with their reasons.

    ``rules`` maps a reason to an SQL condition that must hold; null fails it. Malformed lines become gaps.
    """
    rows = spark.read.csv(path, schema=f"{schema}, _malformed string", header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
    rows = rows.withColumn("_malformed", F.when(F.greatest(*(F.col(c).isNotNull().cast("int") for c in rows.columns)) >= 0, F.col("_malformed")))  # reads all columns: a line is malformed whichever are asked for
    reasons = F.array(F.when(F.col("_malformed").isNotNull(), "malformed"), *(F.when(~F.coalesce(F.expr(e), F.lit(False)), n) for n, e in rules.items()))
    judged = rows.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))
    return judged.where("size(reasons) = 0").drop("reasons", "_malformed"), judged.where("size(reasons) > 0")


def quotations(lines: DataFrame) -> DataFrame:
    """Rows of two-line daily quotations (document, line_no, value): the head line has a code, the next four figures.

    ``status`` is reported_trade, no_reported_trade, exchange_reported_suspension or, where the second line is
    missing or does not have four fields, malformed. A dash or N/A is null. Lines of one document meet in one window.
    """
    filled = lines.where(F.trim("value") != "")
    nxt = F.lead("value").over(Window.partitionBy("document").orderBy("line_no"))
    fields = F.split(F.trim(F.translate("value", "*#", "  ")), r"\s+")  # a code of up to five digits, a name, four figures
    code = fields[0]
    head = (F.length(code) <= 5) & (F.length(code) > 0) & (F.translate(code, "0123456789", "") == "") & (F.upper("value") != F.lower("value"))
    rows = filled.withColumns({"second": nxt, "first": F.slice(fields, 2, F.size(fields)), "code": F.lpad(code, 5, "0"), "head": head}).where("head")
    first, second = F.col("first"), F.split(F.trim("second"), r"\s+")
    suspended = F.array_join("first", " ").endswith("TRADING SUSPENDED")

    def number(parts, i):
        return F.regexp_replace(F.try_element_at(parts, F.lit(i)), ",", "").try_cast("double")

    names = {"previous_close": (first, -4), "ask": (first, -3), "high": (first, -2), "volume": (first, -1), "close": (second, 1), "bid": (second, 2), "low": (second, 3), "amount": (second, 4)}
    whole = (F.size(first) >= 5) & F.coalesce(F.size(second) == 4, F.lit(False))
    rows = rows.select("document", "code", suspended.alias("suspended"), whole.alias("whole"), *(F.when(~suspended & whole, number(*at)).alias(n) for n, at in names.items()))
    traded = F.coalesce((F.col("volume") > 0) & (F.col("amount") > 0), F.lit(False))
    status = F.when(F.col("suspended"), "exchange_reported_suspension").when(~F.col("whole"), "malformed").when(traded, "reported_trade").otherwise("no_reported_trade")
    return rows.withColumns({"status": status, "vwap": F.when(traded, F.col("amount") / F.col("volume"))}).drop("suspended", "whole")


def long_dividends(table: DataFrame) -> DataFrame:
    """(security_id, year, kind, ex_date, amount) of a wide table with interim and final texts; texts without both are null."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("interim", "final")))
    long = table.select("security_id", "year", F.explode(each).alias("x")).select("security_id", "year", "x.*").where("text IS NOT NULL")
    date, amount = F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract("text", r"([0-9]+\.[0-9]+)", 1)
    return long.select("security_id", "year", "kind", F.try_to_date(F.nullif(date, F.lit(""))).alias("ex_date"), F.nullif(amount, F.lit("")).cast("decimal(18,6)").alias("amount"))


def merged_announcements(records: DataFrame) -> DataFrame:
    """One row per (published_at, url) with all codes, sorted and distinct."""
    return records.groupBy("published_at", "url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def base_units(rows: DataFrame, scales: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.col(c) * s for c, s in scales.items()})


def write_years(rows: DataFrame, path: str) -> None:
    """Parquet by year of ``date``; only the years that are written are replaced. One shuffle keeps files few."""
    rows.withColumn("year", F.year("date")).repartition("year", "security_id").write.partitionBy("year").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
