"""Security masters: lifecycle candidates, conflicts with the current list, evidence by ISIN, fund trusts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The classes that evidence of an issue's type maps to.
ASSET_TYPES = {"ordinary_share": "equity", "reit": "reit", "preference": "preference", "depositary_receipt": "depositary_receipt", "other_security_type": "other_security_type"}


def iso_currency(value: Column) -> Column:
    """The exchange shows CNY as RMB."""
    return F.when(value == "RMB", "CNY").otherwise(value)


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def security_master(basic: DataFrame, observed: DataFrame, current: DataFrame, source_date: str) -> DataFrame:
    """One row per security identifier that was quoted, is listed or is on the exchange's current list.

    ``basic`` (code, name, isin, list_date, delist_date, status, currency) has lifecycles, ``observed`` (security_id, first_quote,
    last_quote) what was quoted, ``current`` (exchange_code, name, isin, currency, lot, category), unique by code, today's list. An identifier
    starts with five digits, its exchange code; a quoted one's candidates are the lifecycles of that code that hold all its
    quotes, others have their own row. Just one candidate verifies; several or none leave a gap. A current code whose
    own listed row agrees with today's list in ISIN and currency takes that row, one that disagrees takes none
    (``current_list_conflict``). Today's list adds name, lot and type, from ``source_date`` on. The primary identifier of an ISIN
    is its one undelisted HKD line.
    """
    exchange = lambda c: F.concat(F.regexp_extract(c, r"^(\d{5})", 1), F.lit(".HK"))
    basic = basic.withColumn("exchange_code", exchange(F.col("code")))
    ids = observed.select("security_id").union(basic.where("status = 'L'").select("code")).union(current.select("exchange_code")).distinct()
    ids = ids.withColumn("exchange_code", exchange(F.col("security_id"))).join(observed, "security_id", "left")
    fact = F.struct("b.name", "b.isin", "b.list_date", "b.delist_date", "b.status", "b.currency")
    own = ids.join(basic.alias("b"), F.col("security_id") == F.col("b.code")).groupBy("security_id").agg(F.count(F.lit(1)).alias("own_n"), F.min(fact).alias("own"))
    holds = (F.col("b.list_date") <= F.col("first_quote")) & (F.col("b.delist_date").isNull() | (F.col("b.delist_date") >= F.col("last_quote")))
    life = ids.alias("i").join(basic.alias("b"), (F.col("i.exchange_code") == F.col("b.exchange_code")) & holds).groupBy("security_id").agg(F.count(F.lit(1)).alias("life_n"), F.min(fact).alias("life"))
    listed = current.select("exchange_code", F.struct("name", "isin", "currency", "lot", "category").alias("now"))
    rows = ids.join(own, "security_id", "left").join(life, "security_id", "left").join(listed, "exchange_code", "left")
    is_code, quoted = F.col("security_id") == F.col("exchange_code"), F.col("first_quote").isNotNull()
    meets = is_code & (F.coalesce("own_n", F.lit(0)) == 1) & F.coalesce(F.col("own.status") == "L", F.lit(False)) & F.col("now").isNotNull()
    same = F.coalesce((_text(F.col("own.isin")) == F.col("now.isin")) & iso_currency(F.col("own.currency")).eqNullSafe(iso_currency(F.col("now.currency"))), F.lit(False))
    rows = rows.withColumns({"conflict": meets & ~same, "agrees": meets & same})
    count = F.when(F.col("conflict"), 0).when(F.col("agrees"), 1).when(quoted, F.coalesce("life_n", F.lit(0))).otherwise(F.coalesce("own_n", F.lit(0)))
    one = F.when(F.col("agrees"), F.col("own")).when(quoted, F.col("life")).otherwise(F.col("own"))
    rows = rows.withColumns({"candidates": count.cast("long"), "one": F.when(count == 1, one)})
    usable = is_code & ~F.col("conflict") & F.col("now").isNotNull() & (~quoted | F.coalesce(F.col("one.status") == "L", F.lit(False)))
    rows = rows.withColumn("usable", usable).withColumn("verified", F.col("usable") | F.col("one").isNotNull())
    pick = lambda c: F.when(F.col("usable"), F.col(f"now.{c}")).otherwise(F.col(f"one.{c}"))
    start = F.when(F.col("verified"), F.coalesce("one.list_date", F.lit(source_date).cast("date")))
    early, late = F.col("first_quote") < start, (F.col("last_quote") >= F.col("one.delist_date"))
    outside = F.coalesce(early, F.lit(False)) | F.coalesce(late, F.lit(False))
    kind = F.when(F.col("usable"), F.when(F.col("now.category") == "Real Estate Investment Trusts", "reit").otherwise("equity")).when(F.col("one").isNotNull(), "equity").otherwise("unresolved")
    found = rows.select(
        "security_id", "exchange_code", pick("name").alias("name"), pick("isin").alias("isin"), F.col("one.list_date").alias("list_date"), F.col("one.delist_date").alias("delist_date"),
        iso_currency(pick("currency")).alias("currency"), pick("currency").alias("currency_label"), kind.alias("asset_type"), F.when(F.col("usable"), F.col("now.lot")).alias("lot"),
        F.when(F.col("usable"), F.lit(source_date).cast("date")).alias("lot_valid_from"), F.when(F.col("verified"), "verified").otherwise("unresolved").alias("identity_status"), "candidates",
        start.alias("valid_from"), F.when(F.col("verified"), F.col("one.delist_date")).alias("valid_to"),
        F.when(~F.col("verified"), "unresolved").when(outside, "source_outside_verified_period").otherwise("verified_period").alias("period_status"),
        F.when(F.col("verified"), F.when(outside, "quotes_outside_period")).when(F.col("conflict"), "current_list_conflict").when(F.col("candidates") > 1, "several_candidates").otherwise("no_candidate").alias("gap"),
        "first_quote", "last_quote",
    )
    return _with_primary(found)


def _with_primary(master: DataFrame) -> DataFrame:
    """``primary_id``: the one undelisted HKD identifier of the row's ISIN, or its own."""
    line = (F.col("currency") == "HKD") & F.col("delist_date").isNull()
    primary = master.where("isin IS NOT NULL").groupBy("isin").agg(F.count_if(line).alias("lines"), F.min(F.when(line, F.col("security_id"))).alias("line")).where("lines = 1").select("isin", "line")
    return master.join(primary, "isin", "left").withColumn("primary_id", F.coalesce("line", "security_id")).drop("line")


def with_asset_types(master: DataFrame, evidence: DataFrame) -> DataFrame:
    """The master with asset types from evidence (security_id, mapping_status, matched_isin, asset_class, source_url), unique by security.

    Only evidence matched by a unique ISIN counts, and only where that is the row's own; ``type_status`` tells what became of it.
    """
    met = master.join(evidence, "security_id", "left")
    matched = F.coalesce(F.col("mapping_status") == "matched_unique_isin", F.lit(False))
    same = F.coalesce(F.col("isin") == F.col("matched_isin"), F.lit(False))
    known = F.create_map(*(x for k, v in ASSET_TYPES.items() for x in (F.lit(k), F.lit(v))))[F.col("asset_class")]
    sourced = F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))
    status = F.when(~matched, "provider_category_only").when(~same, "isin_mismatch").when(known.isNull(), "provider_category_only").when(~sourced, "evidence_without_source").otherwise("isin_matched_security_type")
    met = met.withColumns({"type_status": status, "provider_type": F.col("asset_type")})
    took = F.col("type_status") == "isin_matched_security_type"
    met = met.withColumns({"asset_type": F.when(took, known).otherwise(F.col("asset_type")), "type_source": F.when(took, F.col("source_url"))})
    return met.drop("mapping_status", "matched_isin", "asset_class", "source_url")


def trust_master(listings: DataFrame, current: DataFrame, trust_board: int, home_boards: list[int]) -> tuple[DataFrame, DataFrame]:
    """(master, gaps) of fund trusts: issues ever on the trust board, and current trusts by their unique ISIN.

    ``listings`` (listing_id, issue, board, code, isin, delist_date), ``current`` (code, name, isin). An issue takes its one current code; without one
    it is historical if all its home listings are closed. Others, and current trusts without a unique issue, are gaps.
    Codes are reused and names change, so neither is ever matched.
    """
    by_isin = listings.select(_text(F.col("isin")).alias("isin"), "issue").where("isin IS NOT NULL").distinct().groupBy("isin").agg(F.count(F.lit(1)).alias("issues"), F.min("issue").alias("issue"))
    met = current.select("code", "name", _text(F.col("isin")).alias("isin")).join(by_isin, "isin", "left").withColumn("issues", F.coalesce("issues", F.lit(0)).cast("long"))
    by_issue = met.where("issues = 1").groupBy("issue").agg(F.count(F.lit(1)).alias("codes"), F.min(F.struct("code", "name", "isin")).alias("now"))
    home = listings.where(F.col("board").isin(home_boards)).groupBy("issue").agg(F.count(F.lit(1)).alias("listings"), F.count("delist_date").alias("closed"), F.array_sort(F.collect_list("listing_id")).alias("listing_ids"))
    universe = listings.where(F.col("board") == trust_board).select("issue").union(by_issue.select("issue")).distinct()
    rows = universe.join(by_issue, "issue", "left").join(home, "issue", "left")
    one, shut = F.col("codes") == 1, F.col("listings") == F.col("closed")
    scope = F.when(one, "current_list_by_isin").when(F.col("codes") > 1, "several_current_codes").when(shut, "historical_issue").otherwise("unresolved")
    rows = rows.withColumn("scope", scope)
    name = F.when(one, F.col("now.code")).when(F.col("scope") == "historical_issue", F.concat(F.lit("TRUST:"), F.col("issue")))
    master = rows.select("issue", name.alias("security_id"), F.when(one, F.col("now.name")).alias("name"), F.when(one, F.col("now.isin")).alias("isin"), "scope", F.coalesce("listings", F.lit(0)).cast("long").alias("listings"), "listing_ids")
    gaps = met.where("issues <> 1").select("code", F.lit(None).cast(listings.schema["issue"].dataType).alias("issue"), F.when(F.col("issues") == 0, "isin_unmatched").otherwise("isin_ambiguous").alias("reason"))
    return master, gaps.unionByName(rows.where("scope IN ('several_current_codes', 'unresolved')").select(F.lit(None).cast("string").alias("code"), "issue", F.col("scope").alias("reason")))
