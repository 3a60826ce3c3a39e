"""Queries of security masters. The stand-in lists are one text for both engines; what is done with them is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import identity as idt
from panelworks.operators import quality as ql
from panelworks.plans.panel import _BARS
from panelworks.sources import tables as src

_SOURCE_DATE = "2001-10-01"
_K = "s_suppkey"
# two suppliers a code: the even one is today's line, the odd one an earlier line of the code
_CODE = f"lpad(CAST({_K} // 2 AS VARCHAR), 5, '0') || '.HK'"
_ID = f"CASE WHEN {_K} % 2 = 0 THEN {_CODE} ELSE lpad(CAST({_K} // 2 AS VARCHAR), 5, '0') || '!1.HK' END"
_ISIN = f"'HK' || CAST({_K} // 4 AS VARCHAR)"
_BASIC = {
    "code": _ID, "name": f"'name ' || CAST({_K} AS VARCHAR)", "isin": f"CASE WHEN {_K} % 17 = 0 THEN ' ' ELSE {_ISIN} END", "list_date": f"DATE '1994-06-01' + CAST({_K} * 37 % 330 AS INT)",
    "delist_date": f"CASE WHEN {_K} % 2 = 1 OR {_K} % 14 = 0 THEN DATE '2001-08-15' + CAST({_K} * 13 % 120 AS INT) END", "status": f"CASE WHEN {_K} % 2 = 1 OR {_K} % 14 = 0 THEN 'D' ELSE 'L' END", "currency": f"CASE WHEN {_K} % 3 = 0 THEN 'CNY' ELSE 'HKD' END",
}
_NOW = {
    "exchange_code": _CODE, "name": f"'now ' || CAST({_K} AS VARCHAR)", "isin": f"CASE WHEN {_K} % 22 = 0 THEN 'XX' ELSE {_ISIN} END", "currency": f"CASE WHEN {_K} % 3 = 0 THEN 'RMB' WHEN {_K} % 26 = 0 THEN 'USD' ELSE 'HKD' END",
    "lot": f"CAST({_K} % 5 + 1 AS DOUBLE) * 100", "category": f"CASE WHEN {_K} % 12 = 0 THEN 'Real Estate Investment Trusts' ELSE 'Equity' END",
}
_FROM_NOW, _AGAIN = f"{_K} % 2 = 0 AND {_K} % 10 <> 0", f"{_K} % 18 = 0"
_PROOF = {
    "security_id": _ID, "mapping_status": f"CASE WHEN {_K} % 5 = 0 THEN 'ambiguous' ELSE 'matched_unique_isin' END", "matched_isin": f"CASE WHEN {_K} % 7 = 0 THEN 'YY' ELSE {_ISIN} END",
    "asset_class": f"CASE {_K} % 6 WHEN 0 THEN 'reit' WHEN 1 THEN 'ordinary_share' WHEN 2 THEN 'preference' WHEN 3 THEN 'depositary_receipt' WHEN 4 THEN 'bond' ELSE 'other_security_type' END", "source_url": f"CASE WHEN {_K} % 19 = 0 THEN NULL ELSE 'https://list' END",
}
_LISTING = {
    "listing_id": _K, "issue": f"{_K} // 3", "board": f"CAST({_K} % 4 AS INT)", "code": _CODE, "isin": f"CASE WHEN {_K} % 13 = 0 THEN '' ELSE 'T' || CAST({_K} // 3 - CASE WHEN {_K} % 30 = 0 THEN 1 ELSE 0 END AS VARCHAR) END",
    "delist_date": f"CASE WHEN {_K} % 5 <> 0 THEN DATE '1999-01-01' END",
}
_TRUST = {"code": _CODE, "name": f"'trust ' || CAST({_K} AS VARCHAR)", "isin": f"CASE WHEN {_K} % 14 = 0 THEN NULL WHEN {_K} % 8 = 0 THEN 'T' || CAST({_K} // 3 - 1 AS VARCHAR) ELSE 'T' || CAST({_K} // 3 AS VARCHAR) END"}
_IS_TRUST = f"{_K} % 4 = 2 OR {_K} % 8 = 0"


def _spark(text: str) -> str:
    return text.replace("VARCHAR", "STRING").replace(f"{_K} // 2", f"{_K} DIV 2").replace(f"{_K} // 3", f"{_K} DIV 3").replace(f"{_K} // 4", f"{_K} DIV 4")


def _made(spark, d, spec: dict[str, str], where: str = "true") -> DataFrame:
    return src.table(spark, d, "supplier").where(where).selectExpr(*(f"{_spark(e)} AS {n}" for n, e in spec.items()))


def _lists(spark, d):
    basic = _made(spark, d, _BASIC)
    again = _made(spark, d, _BASIC, _AGAIN).withColumn("code", F.concat(F.substring("code", 1, 5), F.lit("!9.HK")))
    quoted = ql.observed_periods(src.weekly_bars(spark, d)).select("security_id", "first_quote", "last_quote")
    names = _made(spark, d, {"key": _K, "id": _ID}, f"{_K} % 9 <> 0")
    observed = quoted.join(names, quoted.security_id == names.key).select(F.col("id").alias("security_id"), "first_quote", "last_quote")
    return basic.unionByName(again), observed, _made(spark, d, _NOW, _FROM_NOW)


def security_master(spark, d):
    return idt.security_master(*_lists(spark, d), _SOURCE_DATE)


def asset_types(spark, d):
    found = idt.with_asset_types(security_master(spark, d), _made(spark, d, _PROOF))
    return found.select("security_id", "isin", "provider_type", "asset_type", "type_status", "type_source")


def _trusts(spark, d):
    return idt.trust_master(_made(spark, d, _LISTING), _made(spark, d, _TRUST, _IS_TRUST), 2, [0, 1, 2])


def trust_master(spark, d):
    return _trusts(spark, d)[0].withColumn("listing_ids", F.array_join("listing_ids", ","))


def trust_gaps(spark, d):
    return _trusts(spark, d)[1]


QUERIES = {f.__name__: f for f in (security_master, asset_types, trust_master, trust_gaps)}


def _sql(spec):
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


_MASTER = f"""{_BARS}, basic0 AS (SELECT {_sql(_BASIC)} FROM supplier), basic AS (SELECT * FROM basic0 UNION ALL SELECT substr(code, 1, 5) || '!9.HK' AS code, * EXCLUDE code FROM (SELECT {_sql(_BASIC)} FROM supplier WHERE {_AGAIN})),
now AS (SELECT {_sql(_NOW)} FROM supplier WHERE {_FROM_NOW}), quoted AS (SELECT security_id AS k, min(date) AS first_quote, max(date) AS last_quote FROM bars WHERE volume > 0 GROUP BY 1),
obs AS (SELECT {_ID} AS security_id, first_quote, last_quote FROM quoted JOIN supplier ON k = {_K} WHERE {_K} % 9 <> 0),
ids AS (SELECT i.security_id, substr(i.security_id, 1, 5) || '.HK' AS x, o.first_quote AS fq, o.last_quote AS lq FROM (SELECT security_id FROM obs UNION SELECT code FROM basic WHERE status = 'L' UNION SELECT exchange_code FROM now) i LEFT JOIN obs o USING (security_id)),
cand AS (SELECT i.security_id, b.* FROM ids i JOIN basic b ON CASE WHEN i.fq IS NULL THEN b.code = i.security_id ELSE substr(b.code, 1, 5) || '.HK' = i.x AND b.list_date <= i.fq AND (b.delist_date IS NULL OR b.delist_date >= i.lq) END),
exact AS (SELECT i.security_id, count(b.code) AS n, min(b.status) AS status, min(trim(b.isin)) AS isin, min(b.currency) AS currency FROM ids i LEFT JOIN basic b ON b.code = i.security_id GROUP BY 1),
st AS (SELECT i.*, n.exchange_code IS NOT NULL AS has_now, n.name AS n_name, n.isin AS n_isin, n.currency AS n_currency, n.lot, n.category, i.security_id = i.x AS is_code,
  i.security_id = i.x AND e.n = 1 AND e.status = 'L' AND n.exchange_code IS NOT NULL AS meets, coalesce(e.isin <> '' AND e.isin = n.isin AND e.currency = CASE WHEN n.currency = 'RMB' THEN 'CNY' ELSE n.currency END, false) AS same
  FROM ids i LEFT JOIN now n ON n.exchange_code = i.x JOIN exact e USING (security_id)),
ch AS (SELECT st.*, CASE WHEN meets AND NOT same THEN 0 WHEN meets THEN 1 ELSE (SELECT count(*) FROM cand c WHERE c.security_id = st.security_id) END AS candidates FROM st),
one AS (SELECT ch.security_id, b.name, b.isin, b.list_date, b.delist_date, b.status, b.currency FROM ch JOIN basic b ON b.code = ch.security_id WHERE meets AND same
  UNION ALL SELECT ch.security_id, c.name, c.isin, c.list_date, c.delist_date, c.status, c.currency FROM ch JOIN cand c USING (security_id) WHERE NOT meets AND candidates = 1),
us AS (SELECT ch.*, o.security_id IS NOT NULL AS found, o.name, o.isin, o.list_date, o.delist_date, o.currency AS o_currency, is_code AND NOT (meets AND NOT same) AND has_now AND (fq IS NULL OR coalesce(o.status = 'L', false)) AS usable FROM ch LEFT JOIN one o USING (security_id)),
ma AS (SELECT security_id, x AS exchange_code, CASE WHEN usable THEN n_name ELSE name END AS name, CASE WHEN usable THEN n_isin ELSE isin END AS isin, list_date, delist_date, CASE WHEN usable THEN n_currency ELSE o_currency END AS currency_label,
  CASE WHEN usable AND category LIKE 'Real%' THEN 'reit' WHEN usable OR found THEN 'equity' ELSE 'unresolved' END AS asset_type, CASE WHEN usable THEN lot END AS lot, CASE WHEN usable THEN DATE '{_SOURCE_DATE}' END AS lot_valid_from,
  CASE WHEN usable OR found THEN 'verified' ELSE 'unresolved' END AS identity_status, candidates, CASE WHEN usable OR found THEN coalesce(list_date, DATE '{_SOURCE_DATE}') END AS valid_from, CASE WHEN usable OR found THEN delist_date END AS valid_to,
  coalesce(fq < coalesce(list_date, DATE '{_SOURCE_DATE}'), false) OR coalesce(lq >= delist_date, false) AS outside, usable OR found AS ok, meets AND NOT same AS conflict, fq AS first_quote, lq AS last_quote FROM us),
mb AS (SELECT *, CASE WHEN currency_label = 'RMB' THEN 'CNY' ELSE currency_label END AS currency FROM ma),
pr AS (SELECT isin, min(security_id) AS line FROM mb WHERE currency = 'HKD' AND delist_date IS NULL AND isin IS NOT NULL GROUP BY 1 HAVING count(*) = 1)"""
_TRUSTS = f"""li AS (SELECT {_sql(_LISTING)} FROM supplier), cu AS (SELECT {_sql(_TRUST)} FROM supplier WHERE {_IS_TRUST}), bi AS (SELECT isin, count(DISTINCT issue) AS issues, min(issue) AS issue FROM li WHERE isin <> '' GROUP BY 1),
me AS (SELECT cu.*, coalesce(issues, 0) AS issues, issue FROM cu LEFT JOIN bi USING (isin)), un AS (SELECT issue FROM li WHERE board = 2 UNION SELECT issue FROM me WHERE issues = 1),
sc AS (SELECT un.issue, (SELECT count(*) FROM me WHERE me.issues = 1 AND me.issue = un.issue) AS codes, (SELECT count(*) FROM li WHERE li.issue = un.issue AND board <= 2) AS listings, (SELECT count(delist_date) FROM li WHERE li.issue = un.issue AND board <= 2) AS closed,
  (SELECT string_agg(listing_id::VARCHAR, ',' ORDER BY listing_id) FROM li WHERE li.issue = un.issue AND board <= 2) AS listing_ids FROM un),
sd AS (SELECT *, CASE WHEN codes = 1 THEN 'current_list_by_isin' WHEN codes > 1 THEN 'several_current_codes' WHEN listings > 0 AND closed = listings THEN 'historical_issue' ELSE 'unresolved' END AS scope FROM sc)"""
ORACLES = {
    "security_master": f"""WITH {_MASTER} SELECT security_id, exchange_code, name, mb.isin, list_date, delist_date, currency, currency_label, asset_type, lot, lot_valid_from, identity_status, candidates, valid_from, valid_to,
      CASE WHEN NOT ok THEN 'unresolved' WHEN outside THEN 'source_outside_verified_period' ELSE 'verified_period' END AS period_status, CASE WHEN ok AND outside THEN 'quotes_outside_period' WHEN ok THEN NULL WHEN conflict THEN 'current_list_conflict' WHEN candidates > 1 THEN 'several_candidates' ELSE 'no_candidate' END AS gap,
      first_quote, last_quote, coalesce(line, security_id) AS primary_id FROM mb LEFT JOIN pr ON pr.isin = mb.isin""",
    "asset_types": f"""WITH {_MASTER}, ev AS (SELECT {_sql(_PROOF)} FROM supplier), k AS (SELECT mb.security_id, mb.isin, asset_type, ev.*, CASE WHEN coalesce(mapping_status, '') <> 'matched_unique_isin' THEN 'provider_category_only' WHEN mb.isin IS DISTINCT FROM matched_isin OR mb.isin IS NULL THEN 'isin_mismatch'
        WHEN asset_class = 'bond' THEN 'provider_category_only' WHEN source_url IS NULL THEN 'evidence_without_source' ELSE 'isin_matched_security_type' END AS type_status FROM mb LEFT JOIN ev ON ev.security_id = mb.security_id)
      SELECT security_id, isin, asset_type AS provider_type, CASE WHEN type_status <> 'isin_matched_security_type' THEN asset_type WHEN asset_class = 'ordinary_share' THEN 'equity' ELSE asset_class END AS asset_type, type_status, CASE WHEN type_status = 'isin_matched_security_type' THEN source_url END AS type_source FROM k""",
    "trust_master": f"""WITH {_TRUSTS} SELECT s.issue, CASE WHEN codes = 1 THEN m.code WHEN scope = 'historical_issue' THEN 'TRUST:' || s.issue END AS security_id, CASE WHEN codes = 1 THEN m.name END AS name, CASE WHEN codes = 1 THEN m.isin END AS isin, scope, listings, listing_ids
      FROM sd s LEFT JOIN me m ON codes = 1 AND m.issues = 1 AND m.issue = s.issue""",
    "trust_gaps": f"""WITH {_TRUSTS} SELECT code, NULL::BIGINT AS issue, CASE WHEN issues = 0 THEN 'isin_unmatched' ELSE 'isin_ambiguous' END AS reason FROM me WHERE issues <> 1 UNION ALL SELECT NULL, issue, scope FROM sd WHERE scope IN ('several_current_codes', 'unresolved')""",
}
