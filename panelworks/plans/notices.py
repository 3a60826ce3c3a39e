"""Queries of notices, forms and dividend schedules. The stand-in rows are one text for both engines; what is done with them is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators import dividends as dv
from panelworks.operators import notices as nt
from panelworks.operators import quality as ql
from panelworks.plans import identity as idp
from panelworks.sources import tables as src
from panelworks.sources.store import materialised

_K, _C = "o_orderkey", "o_custkey"
_N = f"CAST({_K} % 7 + 1 AS VARCHAR)"
_CASES = (
    f"'The board lot size of the shares will be changed from ' || {_N} || ',000 shares to 20,000   shares with effect from 9:00 a.m. on Monday, ' || DAY_FIRST || '. Dealings go on.'",
    "'It is proposed that the board lot be changed from 500 shares to 1,000 shares with effect from ' || DAY_FIRST || '.'",
    "'The change in board lot size from 400 units to 200 units will become effective on ' || DAY_FIRST || ', subject to approval.'",
    "'The board lot will be changed from 500 H shares to 1,000 H shares; the change of company name became effective on ' || DAY_FIRST || '.'",
    "'Board lot size changes from 100 shares to 200 shares with effect from ' || DAY_FIRST || '. The board lot changes from 100 shares to 300 shares.'",
    "'The board lot changes from 2000 new shares each to 4000 new shares each (or conditional on completion, others) with effect from 31 Smarch 1997.'",
    "'No lot is named here.'",
    f"'Board lot: from ' || {_N} || '00 shares to 300 shares. Board   LOT size will become effective from ' || MONTH_FIRST || '! The board lot stays.'",
    "'Share consolidation became effective on ' || DAY_FIRST || '. The board lot, upon share consolidation, is from 10 shares to 20 shares with effect from ' || DAY_FIRST || '.'",
    "'The board lot changes from 10 shares to 50 shares (or subject to completion 5 others) with effect from ' || DAY_FIRST",
)
_NOTICE = f"CASE {_K} % 11 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_CASES)) + " END"

# codes of customers: two a supplier's code; forms are told of quarter ends
_FORM_CODE = f"lpad(CAST({_C} // 30 AS VARCHAR), 5, '0')"
_DAY = "CAST(o_orderdate AS DATE)"
_FORM = {
    "form_id": _K, "url": f"'https://n/' || CAST({_K} AS VARCHAR)", "code": _FORM_CODE, "kind": f"CASE WHEN {_K} % 2 = 0 THEN 'final' ELSE 'interim' END", "nature": "'ordinary'",
    "period_end": f"CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1", "ex_date": f"CASE WHEN {_K} % 37 <> 0 THEN {_DAY} + CAST({_K} % 400 AS INT) END",
}
_LINE = {"url": f"'https://n/' || CAST({_K} AS VARCHAR)", "published_at": f"CASE WHEN {_K} % 31 <> 0 THEN HOURS END", "codes": f"CASE WHEN {_K} % 13 = 0 THEN 'none' ELSE {_FORM_CODE} || ',99999' END"}
_LISTED, _TWICE = f"{_K} % 29 <> 0", f"{_K} % 41 = 0"

_Q = "CAST(date_trunc('quarter', o_orderdate) AS DATE)"
_SHARE = "'00' || lpad(CAST(CUST % 10000 AS VARCHAR), 4, '0') || '.SZ'"


def _text(date: str, compact: bool = False) -> str:
    return f"replace(CAST({date} AS VARCHAR), '-', '')" if compact else f"CAST({date} AS VARCHAR)"


_RAW = {
    "source_code": f"CASE WHEN {_K} % 97 = 0 THEN 'X' || CAST({_C} AS VARCHAR) ELSE {_SHARE.replace('CUST', _C)} END", "state": f"CASE WHEN {_K} % 29 = 0 THEN 'plan' ELSE '{dv.FINAL}' END",
    "end_date": f"CASE WHEN {_K} % 19 = 0 THEN {_text(f'''CAST(date_trunc('quarter', {_Q} - 1) AS DATE) - 1''')} ELSE {_text(f'{_Q} - 1')} END", "ann_date": f"CASE WHEN {_K} % 73 = 0 THEN {_text(f'{_Q} + 30')} ELSE {_text(f'{_Q} + 5')} END",
    "imp_ann_date": f"CASE WHEN {_K} % 43 = 0 THEN NULL WHEN {_K} % 47 = 0 THEN '1996-02-30' ELSE {_text(f'{_Q} + CAST(10 + {_K} % 2 AS INT)', True)} END", "record_date": f"CASE WHEN {_K} % 53 = 0 THEN '' WHEN {_K} % 59 = 0 THEN {_text(f'{_Q} + 10')} ELSE {_text(f'{_Q} + 44')} END",
    "ex_date": f"CASE WHEN {_K} % 61 = 0 THEN NULL WHEN {_K} % 67 = 0 THEN {_text(f'{_Q} + 44')} WHEN {_K} % 149 = 0 THEN 'soon' ELSE {_text(f'{_Q} + 45')} END", "pay_date": f"CASE WHEN {_K} % 71 = 0 THEN ' None ' WHEN {_K} % 151 = 0 THEN {_text(f'{_Q} + 40')} ELSE {_text(f'{_Q} + 55')} END",
    "list_date": f"CASE WHEN {_K} % 79 = 0 THEN {_text(f'{_Q} + 60')} END", "base_date": f"CASE WHEN {_K} % 83 = 0 THEN {_text(f'{_Q} + 50')} END",
    "gross": f"CASE WHEN {_K} % 89 = 0 THEN '-1' WHEN {_K} % 37 = 0 THEN '0' WHEN {_K} % 101 = 0 THEN 'abc' WHEN {_K} % 11 = 0 THEN '2.25' ELSE CAST({_C} // 4 % 9 + 1 AS VARCHAR) || '.5' END", "net": f"CASE WHEN {_K} % 103 = 0 THEN '99' WHEN {_K} % 17 = 0 THEN NULL ELSE '0.5' END",
    "stock": f"CASE WHEN {_K} % 107 = 0 THEN '0.3' WHEN {_K} % 109 = 0 THEN NULL ELSE '0' END", "bonus": f"CASE WHEN {_K} % 107 = 0 THEN '0.1' WHEN {_K} % 113 = 0 THEN '1' WHEN {_K} % 3 = 0 THEN '0' END", "converted": f"CASE WHEN {_K} % 214 = 0 THEN '0.3' WHEN {_K} % 107 = 0 THEN '0.2' END",
    "base_share": f"CASE WHEN {_K} % 127 = 0 THEN '0' ELSE '1000' END", "special": f"CASE WHEN {_K} % 131 = 0 THEN 'yes' ELSE 'No' END", "note": f"CASE WHEN {_K} % 137 = 0 THEN 'A Rights issue' END",
}
_ALIAS = {"old": _SHARE.replace("CUST", "c_custkey"), "new": _SHARE.replace("CUST", "(c_custkey - 1)")}
_ALIASED, _ASOF, _ROWS = "c_custkey % 4 = 1", "2000-06-30", 16


def _spark(text: str) -> str:
    text = text.replace("VARCHAR", "STRING").replace(f"{_C} // 30", f"{_C} DIV 30").replace(f"{_C} // 4", f"{_C} DIV 4")
    return text.replace("DAY_FIRST", "date_format(o_orderdate, 'd MMMM yyyy')").replace("MONTH_FIRST", "date_format(o_orderdate, 'MMM d, yyyy')").replace("HOURS", f"o_orderdate + make_dt_interval(0, CAST({_K} % 24 AS INT))")


def _duck(text: str) -> str:
    return text.replace("DAY_FIRST", "strftime(o_orderdate, '%-d %B %Y')").replace("MONTH_FIRST", "strftime(o_orderdate, '%b %-d, %Y')").replace("HOURS", f"o_orderdate + to_hours(({_K} % 24)::INT)")


def _made(rows: DataFrame, spec: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*(f"{_spark(e)} AS {n}" for n, e in spec.items()))


def lot_notices(spark, d):
    return nt.lot_notices(_made(src.table(spark, d, "orders"), {"url": _K, "published_at": _DAY, "text": _NOTICE}))


def mapped_forms(spark, d):
    orders = src.table(spark, d, "orders")
    catalog = _made(orders.where(_LISTED), _LINE).unionByName(_made(orders.where(_TWICE), _LINE)).withColumn("codes", F.split("codes", ","))
    return nt.mapped_forms(_made(orders, _FORM), catalog, idp.security_master(spark, d))


def _dividends(spark, d):
    raw = _made(src.table(spark, d, "orders"), {"key": _K, **_RAW})
    closed = materialised(spark, d, "share_aliases", lambda: ql.alias_closure(_made(src.table(spark, d, "customer").where(_ALIASED), _ALIAS).distinct()))
    return raw, closed


def dividend_schedules(spark, d):
    return dv.judged_dividends(*_dividends(spark, d), _ASOF)[0].drop("action_id")


def rejected_dividends(spark, d):
    return dv.judged_dividends(*_dividends(spark, d), _ASOF)[1].select("key", "security_id", "reasons")


def _selected(spark, d):
    raw, closed = _dividends(spark, d)
    names = _made(src.table(spark, d, "customer").where("c_custkey % 3 = 0"), {"security_id": _ALIAS["old"]})
    return dv.selected_dividends(raw, closed, names, _ROWS, _ASOF)


def selected_dividends(spark, d):
    return _selected(spark, d)[0].drop("action_id")


def dividend_coverage(spark, d):
    return _selected(spark, d)[1]


QUERIES = {f.__name__: f for f in (lot_notices, mapped_forms, dividend_schedules, rejected_dividends, selected_dividends, dividend_coverage)}


def _sql(spec):
    return ", ".join(f"{_duck(e)} AS {n}" for n, e in spec.items())


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


def _seen(c):
    return f"CASE WHEN lower(trim({c})) NOT IN ({_list(dv.MISSING)}) THEN trim({c}) END"


def _day(c):
    return f"CASE WHEN regexp_full_match({_seen(c)}, '\\d{{8}}') THEN try_strptime({_seen(c)}, '%Y%m%d')::DATE WHEN regexp_full_match({_seen(c)}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({_seen(c)}, '%Y-%m-%d')::DATE END"


_WORDS = {
    "invalid_security_id": f"NOT regexp_full_match(source_code, '{dv.SHARE_FORM[1:-1]}')", "not_implemented": f"state IS DISTINCT FROM '{dv.FINAL}'", **{f"invalid_{c}": f"t_{c} IS NOT NULL AND d_{c} IS NULL" for c in dv.DATES},
    "missing_implementation_publication": "t_imp_ann_date IS NULL", "missing_record_date": "t_record_date IS NULL", "missing_ex_date": "t_ex_date IS NULL", "missing_payment_date": "t_pay_date IS NULL",
    "publication_not_before_record": "out >= rec", "proposal_after_implementation_publication": "d_ann_date > out", "invalid_event_dates": "rec >= ex OR d_pay_date < ex OR d_list_date < ex", "not_yet_visible": f"out + 1 > DATE '{_ASOF}'",
    "invalid_gross_cash": "coalesce(n_gross < 0, true)", "no_cash_distribution": "n_gross = 0", "inconsistent_provider_after_tax_cash": "t_net IS NOT NULL AND (n_net IS NULL OR n_net < 0 OR n_net > n_gross + 1e-10)",
    "inconsistent_stock_distribution": "bad_stock", "missing_stock_distribution_fields": "n_stock IS DISTINCT FROM 0 AND (n_stock IS NULL OR n_bonus IS NULL OR n_converted IS NULL)", "ambiguous_stock_distribution": "n_stock = 0 AND d_list_date IS NOT NULL",
    "unsupported_stock_distribution": "n_stock <> 0 AND n_bonus IS NOT NULL AND n_converted IS NOT NULL AND NOT bad_stock", "invalid_distribution_basis": "(t_base_share IS NOT NULL AND coalesce(n_base_share <= 0, true)) OR d_base_date > rec",
    "unsupported_rights_or_differential_event": f"lower(special) NOT IN ({_list(dv.NO)}) OR lower(note) LIKE '%rights%'",
}
_TERMS = "{'a': end_, 'b': out, 'c': rec, 'd': ex, 'e': d_pay_date, 'f': d_list_date, 'g': d_base_date, 'h': n_gross, 'i': n_net, 'j': n_stock, 'k': CASE WHEN n_stock = 0 AND NOT coalesce(bad_stock, false) THEN 0 ELSE n_bonus END, 'l': CASE WHEN n_stock = 0 AND NOT coalesce(bad_stock, false) THEN 0 ELSE n_converted END, 'm': base_share}::VARCHAR"


def _judged(only: str = "true") -> str:
    """Each event taken whole, by joins of a row with all rows of its event."""
    return f"""al AS (SELECT DISTINCT {_sql(_ALIAS)} FROM customer WHERE {_ALIASED}), sel AS (SELECT DISTINCT coalesce(new, c) AS id FROM (SELECT {_sql({'c': _ALIAS['old']})} FROM customer WHERE c_custkey % 3 = 0) LEFT JOIN al ON old = c),
    raw0 AS (SELECT {_K} AS key, {_sql(_RAW)} FROM orders), raw1 AS (SELECT coalesce(new, source_code) AS id, raw0.* FROM raw0 LEFT JOIN al ON old = source_code), raw AS (SELECT * FROM raw1 WHERE {only}),
    ps AS MATERIALIZED (SELECT *, {", ".join(f"{_seen(c)} AS t_{c}, {_day(c)} AS d_{c}" for c in dv.DATES)}, {", ".join(f"{_seen(c)} AS t_{c}, TRY_CAST({_seen(c)} AS DOUBLE) AS n_{c}" for c in dv.NUMBERS)} FROM raw),
    pq AS MATERIALIZED (SELECT *, d_end_date AS end_, d_imp_ann_date AS out, d_record_date AS rec, d_ex_date AS ex, CASE WHEN n_stock = 0 THEN (t_bonus IS NOT NULL AND n_bonus IS DISTINCT FROM 0) OR (t_converted IS NOT NULL AND n_converted IS DISTINCT FROM 0) ELSE abs(n_stock - n_bonus - n_converted) > 1e-9 END AS bad_stock FROM ps),
    jd AS MATERIALIZED (SELECT *, {_TERMS} AS terms, [x FOR x IN [{", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in _WORDS.items())}] IF x IS NOT NULL] AS own0 FROM pq),
    je AS (SELECT *, list_contains(own0, 'not_implemented') OR list_contains(own0, 'not_yet_visible') AS open_ FROM jd),
    am AS (SELECT id, end_ FROM je WHERE NOT open_ AND end_ IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT coalesce(ex, DATE '1900-01-01')) > 1),
    jf AS MATERIALIZED (SELECT je.*, CASE WHEN am.id IS NOT NULL THEN list_append(own0, 'ambiguous_period_schedule') ELSE own0 END AS own FROM je LEFT JOIN am ON am.id = je.id AND am.end_ = je.end_),
    fit AS MATERIALIZED (SELECT *, max(out) OVER (PARTITION BY id, ex) AS latest FROM jf WHERE NOT open_ AND ex IS NOT NULL),
    ev AS (SELECT id, ex, latest, count(*) > 1 AND (bool_or(out IS NULL) OR bool_or(list_contains(own, 'publication_not_before_record')) OR coalesce(bool_or(latest >= rec), false)) OR count(DISTINCT coalesce(end_, DATE '1900-01-01')) > 1
      OR count(DISTINCT terms) FILTER (out IS NOT DISTINCT FROM latest) > 1 AS clash, bool_or(len(own) > 0) FILTER (out IS NOT DISTINCT FROM latest) AS bad, count(DISTINCT coalesce(out, DATE '1900-01-01')) AS versions FROM fit GROUP BY 1, 2, 3),
    sc AS (SELECT ev.id AS security_id, ev.latest AS ann_date, arg_min(rec, row(source_code <> ev.id, source_code)) AS record_date, ev.ex AS ex_date, any_value(d_pay_date) AS pay_date, any_value(n_gross) AS gross, any_value(n_net) AS net, ev.latest + 1 AS available_from,
      arg_min(source_code, row(source_code <> ev.id, source_code)) AS source_code, string_agg(DISTINCT source_code, ',' ORDER BY source_code) AS sources, count(*) AS merged, ev.versions FROM ev JOIN fit ON fit.id = ev.id AND fit.ex = ev.ex AND out = ev.latest WHERE NOT clash AND NOT bad GROUP BY ALL)"""


_CLEAR = "NOT proposed AND NOT conditional AND NOT unreadable AND days = 1 AND lots = 1"
ORACLES = {
    "lot_notices": f"""WITH n AS (SELECT {_K} AS url, {_DAY} AS published_at, regexp_replace(trim(regexp_replace({_duck(_NOTICE)}, '\\s+', ' ', 'g')), '{nt.HALF_DAY}', '\\1m', 'g') AS t FROM orders),
      s AS (SELECT url, unnest(string_split(regexp_replace(t, '{nt.SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))) AS s FROM n), p AS (SELECT url, string_split_regex(s, '{nt.SUBJECT}') AS parts FROM s),
      m AS (SELECT url, array_to_string(parts[1:i - 1], ' ') AS before, string_split_regex(parts[i], '{nt.OTHER}')[1] AS scope FROM (SELECT url, parts, unnest(range(2, len(parts) + 1)) AS i FROM p)),
      f AS (SELECT url, regexp_extract_all(scope, '{nt.EFFECTIVE}', 1) AS e, regexp_extract_all(scope, '{nt.LOTS}', 0) AS l, string_split_regex(scope, '{nt.ALTERNATIVE}')[1] AS sure, before FROM m),
      g AS (SELECT url, e, l, regexp_matches(before || ' ' || sure, '{nt.PROPOSED}') AS proposed, regexp_matches(sure, '{nt.CONDITIONAL}') AS conditional FROM f WHERE len(e) + len(l) > 0),
      d AS (SELECT url, try_strptime(replace(x, ',', ''), ['%d %B %Y', '%d %b %Y', '%B %d %Y', '%b %d %Y'])::DATE AS day FROM (SELECT url, unnest(e) AS x FROM g WHERE NOT proposed AND NOT conditional)),
      q AS (SELECT url, regexp_extract(x, '{nt.LOTS}', 1) AS o, regexp_extract(x, '{nt.LOTS}', 2) AS w FROM (SELECT url, unnest(l) AS x FROM g WHERE NOT proposed AND NOT conditional)),
      c AS (SELECT n.url, published_at, coalesce((SELECT bool_or(proposed) FROM g WHERE g.url = n.url), false) AS proposed, coalesce((SELECT bool_or(conditional AND NOT proposed) FROM g WHERE g.url = n.url), false) AS conditional, coalesce((SELECT bool_or(day IS NULL) FROM d WHERE d.url = n.url), false) AS unreadable,
        (SELECT count(DISTINCT day) FROM d WHERE d.url = n.url) AS days, (SELECT max(day) FROM d WHERE d.url = n.url) AS day, (SELECT count(DISTINCT row(o, w)) FROM q WHERE q.url = n.url) AS lots, (SELECT max(replace(o, ',', '')::BIGINT) FROM q WHERE q.url = n.url) AS o, (SELECT max(replace(w, ',', '')::BIGINT) FROM q WHERE q.url = n.url) AS w,
        (SELECT count(*) FROM g WHERE g.url = n.url) AS mentions FROM n)
      SELECT url, published_at, CASE WHEN {_CLEAR} THEN day END AS effective_date, CASE WHEN {_CLEAR} THEN o END AS old_lot, CASE WHEN {_CLEAR} THEN w END AS new_lot, CASE WHEN {_CLEAR} THEN 'candidate_effective' ELSE 'needs_review' END AS status,
        concat_ws(',', CASE WHEN proposed THEN 'proposed' END, CASE WHEN conditional THEN 'conditional' END, CASE WHEN unreadable THEN 'unreadable_date' END, CASE WHEN days <> 1 THEN 'no_single_date' END, CASE WHEN lots <> 1 THEN 'no_single_lot' END) AS reasons, mentions FROM c""",
    "mapped_forms": f"""WITH {idp._MASTER}, fo AS (SELECT {_sql(_FORM)} FROM orders), ca AS (SELECT {_sql(_LINE)} FROM orders WHERE {_LISTED} UNION ALL SELECT {_sql(_LINE)} FROM orders WHERE {_TWICE}),
      mm AS (SELECT security_id, exchange_code, valid_from, valid_to FROM mb WHERE asset_type = 'equity' AND identity_status = 'verified'),
      j AS (SELECT fo.*, published_at, codes, (SELECT count(*) FROM ca WHERE ca.url = fo.url) AS lines FROM fo LEFT JOIN (SELECT DISTINCT * FROM ca) c USING (url)),
      o AS (SELECT form_id, count(*) AS owners, min(security_id) AS sid, min(valid_from) AS vf, min(valid_to) AS vt FROM j JOIN mm ON exchange_code = code || '.HK' AND valid_from <= least((published_at + to_hours(8))::DATE, ex_date) AND (valid_to IS NULL OR valid_to > greatest((published_at + to_hours(8))::DATE, ex_date)) WHERE published_at IS NOT NULL AND ex_date IS NOT NULL GROUP BY 1),
      k AS (SELECT j.*, sid, vf, vt, CASE WHEN lines = 0 THEN 'no_catalog_line' WHEN lines > 1 THEN 'several_catalog_lines' WHEN published_at IS NULL THEN 'no_publication_time' WHEN NOT list_contains(string_split(codes, ','), code) THEN 'code_not_in_catalog' WHEN owners IS NULL THEN 'no_security' WHEN owners > 1 THEN 'several_securities' ELSE 'mapped' END AS status FROM j LEFT JOIN o USING (form_id))
      SELECT form_id, status, published_at, CASE WHEN status = 'mapped' THEN sid END AS security_id, CASE WHEN status = 'mapped' THEN vf END AS valid_from, CASE WHEN status = 'mapped' THEN vt END AS valid_to, CASE WHEN status = 'mapped' THEN concat_ws('|', sid, kind, nature, strftime(period_end, '%Y-%m-%d')) END AS event_id FROM k""",
    "dividend_schedules": f"WITH {_judged()} SELECT * FROM sc",
    "rejected_dividends": f"""WITH {_judged()}, r AS (SELECT jf.*, CASE WHEN NOT open_ THEN ev.id IS NOT NULL END AS has, clash, bad, latest FROM jf LEFT JOIN ev ON ev.id = jf.id AND ev.ex = jf.ex)
      SELECT key, id AS security_id, array_to_string(list_sort(CASE WHEN NOT coalesce(has, false) THEN own WHEN clash THEN list_append(own, 'conflicting_final_versions') WHEN bad AND len(own) = 0 THEN ['invalid_final_version'] WHEN NOT bad THEN list_append(own, 'superseded_provider_version') ELSE own END), ';') AS reasons
      FROM r WHERE NOT (coalesce(has, false) AND NOT clash AND NOT bad AND out IS NOT DISTINCT FROM latest)""",
    "selected_dividends": f"WITH {_judged('id IN (SELECT id FROM sel)')} SELECT * FROM sc",
    "dividend_coverage": f"""WITH {_judged('id IN (SELECT id FROM sel)')}, so AS (SELECT id, id AS code FROM sel UNION SELECT new, old FROM al WHERE new IN (SELECT id FROM sel)), n AS (SELECT so.*, (SELECT count(*) FROM raw WHERE source_code = code) AS n FROM so)
      SELECT id AS security_id, count(*) AS sources, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n >= {_ROWS}) AS capped, (SELECT count(*) FROM sc WHERE sc.security_id = n.id) AS schedules, CASE WHEN count(*) FILTER (n = 0 OR n >= {_ROWS}) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM n GROUP BY id""",
}
