"""Published notices: changes of board lots from their sentences, and forms tied to a dated security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words by which a notice names other subjects, proposals, conditions and effective dates.
OTHER_SUBJECTS = ("(?:share )?consolidation", "capital (?:reduction|reorgani[sz]ation)", "(?:share )?sub[- ]?division", "adjustments? to (?:the )?share options?", "appointment", "resignation", "change of company name")
PROPOSALS = ("proposed", "proposes?", "proposal", "intends?")
CONDITIONS = ("subject to", "conditional (?:on|upon)", "upon (?:the )?completion", "may or may not")
EFFECTS = ("(?:became|becomes|becoming|has become|will become) effective (?:on|from)", "with effect from")
SHARE_WORDS = ("existing", "consolidated", "new", "adjusted", "ordinary", "h", "a", "b")
DATE_FORMS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")


def _any(words) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


SUBJECT, OTHER, PROPOSED, CONDITIONAL = _any(("board lot(?: size)?",)), _any(OTHER_SUBJECTS), _any(PROPOSALS), _any(CONDITIONS)
_COUNT = rf"([1-9][0-9]{{0,2}}(?:,[0-9]{{3}})+|[1-9][0-9]*) (?:(?:{'|'.join(SHARE_WORDS)}) )*(?:shares?|units?)\b(?: each)?"
LOTS = rf"(?i)\bfrom {_COUNT} to {_COUNT}"
_CLOCK = r"[0-9]{1,2} ?: ?[0-9]{2} ?[ap]m (?:on )?"
EFFECTIVE = rf"(?i)\b(?:{'|'.join(EFFECTS)}) (?:{_CLOCK})?(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day,? )?([0-9]{{1,2}} [a-z]+ [0-9]{{4}}|[a-z]+ [0-9]{{1,2}},? [0-9]{{4}})\b"
SENTENCE_END, HALF_DAY, ALTERNATIVE = r"([.;!?]) ", r"(?i)\b([ap])\.m\.", r"(?i)\(or "


def _day(text: Column) -> Column:
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("")), F.lit(f))) for f in DATE_FORMS))


def lot_mentions(notices: DataFrame) -> DataFrame:
    """Each mention of a board lot in ``notices`` (url, published_at, text): what is said after it, up to another subject.

    ``reason`` is proposed or conditional where the mention is not certain; ``days`` and ``lots`` hold all effective dates (null where
    unreadable) and all pairs of old and new lots in its scope. A notice without mentions, or without text, gives one row without a scope.
    Each sentence is cut once, so that a text of many mentions costs its length.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), HALF_DAY, "$1m")
    sentences = notices.select("url", "published_at", F.explode_outer(F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")).alias("sentence"))
    parts = sentences.select("url", "published_at", F.split("sentence", SUBJECT).alias("parts"))
    proposing = F.array_position(F.transform("parts", lambda p: p.rlike(PROPOSED)), True)  # from 1; 0: none
    pieces = parts.select("url", "published_at", proposing.alias("proposing"), F.posexplode_outer("parts").alias("mention", "piece"))
    rows = pieces.withColumn("scope", F.when(F.col("mention") > 0, F.split("piece", OTHER, 2)[0]))
    certain = F.split("scope", ALTERNATIVE, 2)[0]
    before = (F.col("proposing") > 0) & (F.col("proposing") <= F.col("mention"))
    found = rows.withColumns({
        "days": F.transform(F.regexp_extract_all("scope", F.lit(EFFECTIVE), 1), _day),
        "lots": F.zip_with(*(F.regexp_extract_all("scope", F.lit(LOTS), i) for i in (1, 2)), lambda a, b: F.struct(*(F.replace(x, F.lit(","), F.lit("")).try_cast("long").alias(n) for x, n in ((a, "old"), (b, "new"))))),
        "reason": F.when(before | certain.rlike(PROPOSED), "proposed").when(certain.rlike(CONDITIONAL), "conditional"),
    })
    said = F.coalesce((F.size("days") > 0) | (F.size("lots") > 0), F.lit(False))
    return found.select("url", "published_at", *(F.when(said, F.col(c)).alias(c) for c in ("scope", "reason", "days", "lots")))


def lot_notices(notices: DataFrame) -> DataFrame:
    """One row a notice (url, published_at): a change of lot with its day where all certain mentions name one of each, else reasons for a review.

    A proposal, a condition or an unreadable date anywhere sends the notice to review; numbers beyond 64 bits are no lots.
    """
    sure = F.col("reason").isNull()
    found = lot_mentions(notices).groupBy("url", "published_at").agg(
        F.max(F.when(sure, F.array_max("days"))).alias("effective_date"), F.min(F.when(sure, F.array_min("days"))).alias("first_day"),
        F.max(F.when(sure, F.array_max("lots"))).alias("lot"), F.min(F.when(sure, F.array_min("lots"))).alias("first_lot"),
        F.max(F.col("reason") == "proposed").alias("proposed"), F.max(F.col("reason") == "conditional").alias("conditional"), F.max(F.when(sure, F.exists("days", lambda x: x.isNull()))).alias("unreadable"), F.count("scope").alias("mentions"),
    )
    one_day = F.coalesce(F.col("effective_date") == F.col("first_day"), F.lit(False))
    one_lot = F.coalesce((F.col("lot") == F.col("first_lot")) & F.col("lot.old").isNotNull() & F.col("lot.new").isNotNull(), F.lit(False))
    reasons = F.concat_ws(",", F.when(F.col("proposed"), "proposed"), F.when(F.col("conditional"), "conditional"), F.when(F.col("unreadable"), "unreadable_date"), F.when(~one_day, "no_single_date"), F.when(~one_lot, "no_single_lot"))
    clear = F.col("reasons") == ""
    return found.withColumn("reasons", reasons).select(
        "url", "published_at", F.when(clear, F.col("effective_date")).alias("effective_date"), F.when(clear, F.col("lot.old")).alias("old_lot"), F.when(clear, F.col("lot.new")).alias("new_lot"),
        F.when(clear, "candidate_effective").otherwise("needs_review").alias("status"), "reasons", "mentions",
    )


def mapped_forms(forms: DataFrame, catalog: DataFrame, master: DataFrame, zone: str = "Asia/Hong_Kong") -> DataFrame:
    """Dividend forms with the security they belong to, by the catalog of notices and the lines of a dated master.

    ``forms`` (form_id, url, code, kind, nature, period_end, ex_date), unique by form_id; ``catalog`` (url, published_at, codes); ``master``
    (security_id, exchange_code, asset_type, identity_status, valid_from, valid_to). A form is mapped where one catalog line has its
    url, a time and its code, and one verified share holds the code both on the local day of publication and on the ex-date; ``status`` names the first rule that fails.
    """
    lines = catalog.groupBy("url").agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct("published_at", "codes")).alias("c"))
    rows = forms.join(lines, "url", "left").select(*forms.columns, "lines", "c.*")
    local = F.to_date(F.from_utc_timestamp("published_at", zone))
    rows = rows.withColumns({"day": local, "exchange_code": F.concat("code", F.lit(".HK"))})
    periods = master.where("asset_type = 'equity' AND identity_status = 'verified'").select("exchange_code", F.struct("security_id", "valid_from", "valid_to").alias("m"))
    holds = lambda day: (F.col("m.valid_from") <= F.col(day)) & (F.col("m.valid_to").isNull() | (F.col("m.valid_to") > F.col(day)))
    owners = rows.join(periods, "exchange_code").where(holds("day") & holds("ex_date")).groupBy("form_id").agg(F.count(F.lit(1)).alias("owners"), F.min("m").alias("m"))
    status = (
        F.when(F.col("lines").isNull(), "no_catalog_line").when(F.col("lines") > 1, "several_catalog_lines").when(F.col("published_at").isNull(), "no_publication_time")
        .when(~F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False)), "code_not_in_catalog").when(F.col("owners").isNull(), "no_security").when(F.col("owners") > 1, "several_securities").otherwise("mapped")
    )
    met = rows.join(owners, "form_id", "left").withColumn("status", status)
    mapped = F.col("status") == "mapped"
    event = F.concat_ws("|", "m.security_id", "kind", "nature", F.date_format("period_end", "yyyy-MM-dd"))
    return met.select("form_id", "status", "published_at", *(F.when(mapped, F.col(f"m.{c}")).alias(c) for c in ("security_id", "valid_from", "valid_to")), F.when(mapped, event).alias("event_id"))
