"""DuckDB SQL for the queries of ``more``, written apart from their plans."""

from __future__ import annotations

from factorloom.plans.oracles import _NORMAL, PARTS, sql

_DAY = "strftime({}, '%d-%b-%Y')"
_REVIEWS = "(SELECT o_orderkey AS attempt_id, o_custkey % 150 AS isin, CASE o_orderstatus WHEN 'F' THEN 'PENDING' WHEN 'O' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, (o_orderkey % 4 * 0.3)::DOUBLE AS confidence, o_orderdate::DATE AS queued_at FROM orders)"
_LAST = "'2001-10-31'"
PARTS |= {
    "consolidated": "SELECT *, isin * 10000 + year(period_end_date) AS doc_id FROM annual WHERE basis = 'CONSOLIDATED'",
    "mfz": "SELECT as_of, isin, factor, z FROM mzz",
    "mshare": "SELECT *, CASE WHEN z IS NOT NULL THEN 1.0::DOUBLE / count(z) OVER (PARTITION BY as_of, isin) END AS share FROM mfz",
    "seen_prices": "SELECT g.as_of, g.isin, count(*) AS n, max(p.date) AS last FROM grid g JOIN prices p ON p.isin = g.isin AND p.date BETWEEN g.as_of - 400 AND g.as_of GROUP BY ALL",
    "seen_annual": "SELECT as_of, isin, least(count(*), 5) AS n FROM visible GROUP BY ALL",
    "seen_quarters": "SELECT as_of, isin, count(*) AS n, max(period_end_date) AS last FROM recent GROUP BY ALL",
    "seen_holding": "SELECT as_of, isin, count(*) AS n, max(quarter_end) AS last FROM held GROUP BY ALL",
    "seen_news": "SELECT g.as_of, g.isin, count(*) FILTER (n.confidence >= 0.7) AS n, count(*) AS total FROM grid g JOIN old_news n ON n.isin = g.isin AND published_at >= g.as_of - INTERVAL 30 DAY AND published_at < g.as_of + INTERVAL 1 DAY GROUP BY ALL",
    "statuses": """
    SELECT as_of, isin, 'prices' AS dataset, coalesce(n, 0) AS n, last, CASE WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n < 180 OR as_of - last > 45 THEN 'PARTIAL' ELSE 'PRESENT' END AS status FROM grid LEFT JOIN seen_prices USING (as_of, isin)
    UNION ALL SELECT as_of, isin, 'annual', coalesce(n, 0), NULL, CASE WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n < 3 THEN 'PARTIAL' ELSE 'PRESENT' END FROM grid LEFT JOIN seen_annual USING (as_of, isin)
    UNION ALL SELECT as_of, isin, 'quarterly', coalesce(n, 0), last, CASE WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n < 5 OR as_of - last > 270 THEN 'PARTIAL' ELSE 'PRESENT' END FROM grid LEFT JOIN seen_quarters USING (as_of, isin)
    UNION ALL SELECT as_of, isin, 'shareholding', coalesce(n, 0), last, CASE WHEN coalesce(n, 0) = 0 THEN 'ABSENT' WHEN n < 4 OR as_of - last > 270 THEN 'PARTIAL' ELSE 'PRESENT' END FROM grid LEFT JOIN seen_holding USING (as_of, isin)
    UNION ALL SELECT as_of, isin, 'news', coalesce(n, 0), NULL, CASE WHEN coalesce(total, 0) = 0 THEN 'ABSENT' WHEN n < 3 THEN 'PARTIAL' ELSE 'PRESENT' END FROM grid LEFT JOIN seen_news USING (as_of, isin)""",
    "has": "SELECT as_of, isin, max(status) FILTER (dataset = 'annual') AS sa, max(status) FILTER (dataset = 'prices') AS sp, max(status) FILTER (dataset = 'quarterly') AS sq, max(status) FILTER (dataset = 'news') AS sn, max(n) FILTER (dataset = 'annual') AS na, max(n) FILTER (dataset = 'quarterly') AS nq, max(n) FILTER (dataset = 'news') AS nn FROM statuses GROUP BY ALL",
}
_METRICS = "periods, years, total_return, cagr, volatility, sharpe, sortino, max_drawdown, calmar, hit_rate, best_period, worst_period"


def _metrics(source: str) -> str:
    return f"""(SELECT *, CASE WHEN volatility > 0 THEN (cagr - 0.065) / volatility ELSE 0 END AS sharpe, CASE WHEN down > 0 THEN (cagr - 0.065) / down ELSE 0 END AS sortino, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM (
      SELECT count(ret)::DOUBLE AS periods, round(count(ret) / 12, 2) AS years, last(nav ORDER BY date) / first(nav ORDER BY date) - 1 AS total_return, (last(nav ORDER BY date) / first(nav ORDER BY date)) ** (12.0 / count(ret)) - 1 AS cagr, stddev_samp(ret) * sqrt(12) AS volatility,
        stddev_samp(ret) FILTER (ret < 0) * sqrt(12) AS down, min(nav / peak - 1) AS max_drawdown, avg((ret > 0)::INT) AS hit_rate, max(ret) AS best_period, min(ret) AS worst_period
      FROM (SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret, max(nav) OVER (ORDER BY date) AS peak FROM {source})))"""


def _unpivoted(source: str, out: str) -> str:
    return f"SELECT * FROM (UNPIVOT (SELECT {', '.join(f'{c.strip()}::DOUBLE AS {c.strip()}' for c in _METRICS.split(','))} FROM {_metrics(source)}) ON {_METRICS} INTO NAME metric VALUE {out})"


_ITEMS = "revenue, pat, ocf, capex, profit_before_tax, interest_expense, ebitda, fcf, depreciation, total_debt, cash, total_equity, total_assets, eps, contingent_liabilities"
_DENSITY = "(SELECT CASE WHEN len(t) < 20 THEN 0.0 ELSE len(list_filter(t, lambda x: regexp_full_match(x, '\\(?-?[0-9,]+\\.?[0-9]*\\)?')))::DOUBLE / len(t) END)"
_ARTICLES = "(SELECT CASE WHEN doc_id % 3 <> 0 THEN 'http://x/' || doc_id ELSE '' END AS url, 'Story ' || (doc_id % 200) AS headline, DATE '2024-01-01' + (doc_id % 5)::INT AS day, doc_id % 200 AS k FROM documents WHERE text IS NOT NULL)"
SQL = {
    "s2_constituents": "SELECT 'INE' || lpad(s_suppkey::VARCHAR, 9, '0') AS isin, 'S' || s_suppkey AS nse_symbol, s_name AS name, s_nationkey::VARCHAR AS industry FROM supplier WHERE s_suppkey % 4 <> 0",
    "s4_normalise_ohlcv": sql("isin date:d open:f close:f adj_close:f volume", "SELECT isin::VARCHAR AS isin, date, NULL AS open, adj_close * 2 AS close, CASE WHEN isin % 3 <> 0 THEN adj_close ELSE adj_close * 2 END AS adj_close, volume FROM prices WHERE isin % 7 <> 0"),
    "s5_cached_prices": sql("isin cached n mean_close:f", "SELECT isin::VARCHAR AS isin, isin % 2 = 0 AS cached, count(*) AS n, avg(adj_close) AS mean_close FROM prices GROUP BY ALL"),
    "s6_quarterly_json": sql("isin period_end_date:d filing_date:d revenue:f pat:f", "SELECT isin, period_end_date, CASE WHEN isin % 4 = 0 THEN period_end_date + 45 ELSE period_end_date + 20 END AS filing_date, floor(revenue) * 0.01::DOUBLE AS revenue, floor(pat) * 0.01::DOUBLE AS pat FROM quarterly WHERE isin % 5 <> 0"),
    "s7_filing_index": sql("isin period_end_date:d broadcast_date:d relating_to is_consolidated is_audited basis xbrl_url", "SELECT isin, period_end_date, CASE WHEN isin % 4 <> 0 THEN period_end_date + 30 END AS broadcast_date, 'Quarterly' AS relating_to, CASE isin % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_consolidated, isin % 2 = 0 AS is_audited, CASE isin % 3 WHEN 0 THEN 'CONSOLIDATED' WHEN 1 THEN 'STANDALONE' ELSE 'UNKNOWN' END AS basis, CASE WHEN isin % 6 <> 0 THEN 'https://x/' || isin || '.xml' END AS xbrl_url FROM quarterly"),
    "s8_crawl_windows": sql("isin window_start:d window_end:d", "SELECT isin, s AS window_start, least(s + 89, b) AS window_end FROM (SELECT isin, b, unnest(generate_series(a, b, INTERVAL 90 DAY))::DATE AS s FROM (SELECT isin, min(date) AS a, max(date) AS b FROM prices GROUP BY isin))"),
    "s9_shareholding_json": sql("isin quarter_end:d disclosed_date:d promoter_pct:f promoter_pledged_pct:f", "SELECT * FROM holding"),
    "s10_annual_reports": sql("isin fiscal_year:INT period_end:d broadcast_date:d broadcast_date_source", "SELECT isin, y AS fiscal_year, make_date(y, 3, 31) AS period_end, CASE WHEN isin % 4 = 0 THEN make_date(y, 7, 15) ELSE make_date(y, 9, 30) END AS broadcast_date, CASE WHEN isin % 4 = 0 THEN 'NSE' ELSE 'ASSUMED' END AS broadcast_date_source FROM (SELECT isin, (2001 + isin % 5)::INT AS y FROM instruments WHERE isin % 11 <> 0)"),
    "s11_registered_files": "SELECT doc_id::VARCHAR AS path, CASE WHEN text IS NOT NULL THEN sha256(text || repeat('/Type /Page ', (doc_id % 3)::INT)) END AS sha256, strlen(text || repeat('/Type /Page ', (doc_id % 3)::INT))::INT AS n_bytes, CASE WHEN text IS NOT NULL THEN (doc_id % 3)::INT END AS n_pages FROM documents",
    "s12_quarterly_xbrl": sql("doc_id field value:f start:d finish:d", "SELECT doc_id, 'revenue' AS field, revenue / 4 AS value, make_date(year(period_end_date), 10, 1) AS start, period_end_date AS finish FROM consolidated UNION ALL SELECT doc_id, 'total_assets', total_assets, NULL, period_end_date FROM consolidated"),
    "s13_annual_xbrl": sql("doc_id period_start:d period_end:d revenue:f pat:f total_assets:f tax_expense:f opinion_note", "SELECT doc_id, make_date(year(period_end_date), 1, 1) AS period_start, period_end_date AS period_end, revenue / 1e7 AS revenue, pat / 1e7 AS pat, total_assets / 1e7 AS total_assets, NULL AS tax_expense, CASE WHEN isin % 4 = 0 THEN 'Statement on audit qualification' ELSE 'Unmodified opinion' END AS opinion_note FROM consolidated"),
    "e6_xbrl_ingest": sql("isin fiscal_year:INT basis filing_date:d period_start:d revenue:f pat:f total_assets:f auditor_opinion run:INT reason", "SELECT *, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN CASE WHEN isin % 3 <> 0 THEN told ELSE period_end_date + 60 END END AS filing_date, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN make_date(fiscal_year, 1, 1) END AS period_start, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN r / 1e7 END AS revenue, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN p / 1e7 END AS pat, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN t / 1e7 END AS total_assets, CASE WHEN kind NOT BETWEEN 1 AND 5 THEN CASE WHEN isin % 4 = 0 THEN 'QUALIFIED' ELSE 'UNMODIFIED' END END AS auditor_opinion, CASE WHEN fiscal_year <= 1997 THEN 1 ELSE 2 END AS run, CASE kind WHEN 1 THEN 'not well-formed XML' WHEN 2 THEN 'longest period ending ' || period_end_date::DATE::VARCHAR || ' spans ' || (period_end_date::DATE - make_date(fiscal_year, 7, 1)) || ' days, short of 300' WHEN 3 THEN 'no instant context' WHEN 4 THEN 'missing revenue' WHEN 5 THEN 'no XBRL contexts' END AS reason FROM (SELECT isin, year(period_end_date) AS fiscal_year, CASE WHEN isin % 5 = 0 THEN 'STANDALONE' ELSE 'CONSOLIDATED' END AS basis, period_end_date, filing_date AS told, revenue AS r, pat AS p, total_assets AS t, (isin + year(period_end_date)) % 7 AS kind FROM annual WHERE isin % 5 = 0 OR basis = 'CONSOLIDATED')"),
    "s14_derivations": sql("isin period_end_date:d basis pat:f total_debt:f total_liabilities:f", "SELECT isin, period_end_date, basis, CASE WHEN isin % 5 = 2 THEN pat * 1.1 ELSE pat END AS pat, CASE WHEN isin % 6 <> 0 THEN total_debt * (CASE WHEN isin % 3 <> 0 THEN 0.4 ELSE 0 END + CASE WHEN isin % 2 <> 0 THEN 0.6 ELSE 0 END) END AS total_debt, total_assets - total_equity AS total_liabilities FROM annual"),
    "s15_unmapped_elements": sql("element n", "SELECT 'OtherThing' AS element, count(*) AS n FROM consolidated"),
    "s16_feed_items": "SELECT 'feed-' || (doc_id % 97) AS feed, 'Story & ' || doc_id AS title, 'http://x/' || doc_id AS link, 'body of it' AS body, (make_timestamp(2024, 1, (doc_id % 28 + 1)::INT, 20, 30, 0) + INTERVAL 330 MINUTE)::VARCHAR AS published_at FROM documents WHERE doc_id IS NOT NULL AND doc_id % 97 % 10 <> 7",
    "s17_feed_status": "SELECT 'feed-' || (doc_id % 97) AS feed, CASE WHEN min(doc_id % 97 % 10) = 7 THEN -1 ELSE count(*) FILTER (make_timestamp(2024, 1, (doc_id % 28 + 1)::INT, 20, 30, 0) + INTERVAL 330 MINUTE >= TIMESTAMP '2024-01-15') END AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1",
    "s19_tagged_news": sql("url headline isin score:f label", "SELECT 'http://x/' || l_orderkey AS url, 'Order ' || l_orderkey AS headline, l_suppkey AS isin, s AS score, CASE WHEN s > 0.15 THEN 'positive' WHEN s < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT l_orderkey, l_suppkey, round(first(l_discount ORDER BY l_linenumber, l_discount)::DOUBLE * 10 - 0.5, 2) AS s FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_suppkey % 5 <> 0 GROUP BY ALL)"),
    "k2_backfilled_membership": sql("isin from_date:d to_date:d index_name", "SELECT isin, CASE WHEN isin % 2 = 0 AND from_date > DATE '1992-01-15' THEN DATE '1992-01-15' ELSE from_date END AS from_date, to_date, CASE WHEN isin % 2 = 0 THEN 'A' ELSE 'B' END AS index_name FROM membership"),
    "k4_last_record": sql("l_suppkey period:d l_returnflag l_orderkey l_linenumber", "SELECT l_suppkey, date_trunc('month', l_shipdate) AS period, l_returnflag, max(l_orderkey) AS l_orderkey, arg_max(l_linenumber, l_orderkey * 100 + l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL"),
    "k8_positions": sql("run_id date:d isin weight:f", "SELECT substr(sha256('{\"factor\": \"momentum_12_1\", \"top\": 20}'), 1, 8) AS run_id, as_of AS date, isin, weight FROM top"),
    "k9_export": sql("as_of:d isin red_flags", "SELECT as_of, isin, replace(red_flags, ',', ';') AS red_flags FROM flag_sums"),
    "k10_loaded_history": sql("index_name isin from_date:d to_date:d verified_from:d verified_to:d source", "SELECT 'X' AS index_name, isin, from_date, CASE WHEN isin % 3 = 0 THEN from_date + 100 END AS to_date, DATE '1992-01-01' AS verified_from, DATE '2000-12-31' AS verified_to, 'list' AS source FROM membership"),
    "k11_decided_reviews": sql("attempt_id status notes revenue:f", f"SELECT attempt_id, CASE WHEN status <> 'PENDING' THEN status WHEN attempt_id % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status, CASE WHEN status = 'PENDING' THEN 'seen' END AS notes, CASE WHEN status = 'PENDING' AND attempt_id % 3 = 0 THEN NULL WHEN status = 'PENDING' AND attempt_id % 2 = 0 THEN 2.0 WHEN confidence >= 0.6 THEN 1.0 END AS revenue FROM {_REVIEWS}"),
    "k12_json_safe": sql("p_partkey x:f", "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size > 25 THEN ln((p_size - 25)::DOUBLE) / 0.5 END AS x FROM part"),
    "p13_promoter_trend": sql("isin quarter_end:d promoter_pct:f", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY quarter_end DESC) AS k FROM holding WHERE disclosed_date <= DATE {_LAST}) WHERE k <= 8"),
    "f2_names_ignoring_case": sql("isin symbol", "SELECT isin, symbol FROM instruments WHERE lower(symbol) IN ('s7', 's8')"),
    "f3_predicates": "SELECT page_id, url FROM pages WHERE url LIKE 'https://%.com/%' AND url <> '' AND split_part(url, '/', 4) IN ('en', 'fr')",
    "f4_search": sql("isin symbol name", "SELECT * FROM instruments WHERE name ILIKE '%er#00000000%' OR symbol ILIKE '%er#00000000%'"),
    "j10_rows_of_each": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders",
    "j11_at_the_latest": sql("as_of:d isin z:f", "SELECT as_of, isin, z FROM mz WHERE as_of = (SELECT max(as_of) FROM mz)"),
    "a1_store_status": sql('"table" n first last', " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n, min({d})::DATE::VARCHAR AS first, max({d})::DATE::VARCHAR AS last FROM {t}" for t, d in (("prices", "date"), ("annual", "filing_date"), ("quarterly", "filing_date"), ("holding", "disclosed_date")))),
    "a5_any_value": "SELECT o_orderkey, any_value(o_custkey) AS custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "a20_median_ratio": sql("k median_ratio:f", "SELECT k, median(r) AS median_ratio FROM (SELECT date_trunc('month', published_at) AS m, isin % 10 AS k, count(*) FILTER (confidence >= 0.7) / count(*) AS r FROM news GROUP BY ALL) GROUP BY k"),
    "t2_lowest_n": sql("as_of:d isin weight:f", "SELECT as_of, isin, (1 / count(*) OVER (PARTITION BY as_of))::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY raw, isin) AS r FROM quality WHERE factor = 'debt_to_equity' AND raw IS NOT NULL) WHERE r <= 10"),
    "t3_top_and_bottom": sql('as_of:d "end" rank:INT isin z:f', "SELECT as_of, 'TOP' AS \"end\", a AS rank, isin, z FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY z DESC, isin) AS a FROM mz WHERE z IS NOT NULL) WHERE a <= 5 UNION ALL SELECT as_of, 'BOTTOM', b, isin, z FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY z, isin) AS b FROM mz WHERE z IS NOT NULL) WHERE b <= 5"),
    "t5_stored_signal": sql("isin made:d z:f", "SELECT isin, max(as_of) AS made, arg_max(coalesce(z, 'nan'::DOUBLE), as_of) AS z0, CASE WHEN isnan(z0) THEN NULL ELSE z0 END AS z FROM mz WHERE as_of <= DATE '2000-07-15' GROUP BY isin"),
    "e11_review_queue": sql("attempt_id isin symbol confidence:f queued_at:d", f"SELECT * FROM {_REVIEWS} r LEFT JOIN instruments i USING (isin) WHERE status = 'PENDING' ORDER BY confidence, queued_at, attempt_id LIMIT 50"),
    "e11_review_summary": sql("status n avg_confidence:f", f"SELECT status, count(*) AS n, round(avg(confidence), 2) AS avg_confidence FROM {_REVIEWS} GROUP BY status"),
    "e11_review_detail": sql("filing_id symbol filing_date:d revenue unit", "SELECT isin * 10 + year(period_end_date) % 10 AS filing_id, symbol, filing_date, floor(revenue)::BIGINT AS revenue, 'CRORE' AS unit FROM consolidated JOIN instruments USING (isin)"),
    "e4_routing": f"SELECT attempt_id, status, round(confidence, 1) >= 0.6 AS stored, round(confidence, 1) < 1 AS review FROM {_REVIEWS}",
    "e6_annual_filings": sql("isin fiscal_year:INT basis fcf:f auditor_opinion reason", "SELECT isin, year(period_end_date) AS fiscal_year, CASE WHEN isin % 6 <> 0 AND pat IS NOT NULL THEN basis END AS basis, CASE WHEN isin % 6 <> 0 AND isin % 4 <> 0 THEN ocf - capex END AS fcf, CASE WHEN isin % 6 <> 0 THEN CASE isin % 3 WHEN 0 THEN 'UNMODIFIED' WHEN 1 THEN 'QUALIFIED' END END AS auditor_opinion, CASE WHEN isin % 6 = 0 THEN 'missing pat' END AS reason FROM annual WHERE isin % 5 = 0 OR basis = 'CONSOLIDATED'"),
    "e8_page_budget": "SELECT doc, page, least(n, 20000 - b)::BIGINT AS n_chars FROM (SELECT concat_ws('-', source, lang) AS doc, doc_id AS page, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY concat_ws('-', source, lang) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE text IS NOT NULL) WHERE b + n <= 20000 OR b < 20000",
    "e10_model_rates": sql("model n succeeded persisted clean nse_checked nse_agreed cost:f seconds:f persist_rate:f nse_rate:f", "SELECT *, persisted / n AS persist_rate, CASE WHEN nse_checked > 0 THEN nse_agreed / nse_checked END AS nse_rate FROM (SELECT model, count(*) AS n, count(*) FILTER (done) AS succeeded, count(*) FILTER (done AND c >= 0.6) AS persisted, count(*) FILTER (done AND c >= 1) AS clean, count(*) FILTER (done AND k % 3 <> 0) AS nse_checked, count(*) FILTER (done AND k % 3 <> 0 AND k % 2 = 0) AS nse_agreed, count(*) * 0.5 AS cost, sum(k % 9) AS seconds FROM (SELECT 'm' || (o_custkey % 3) AS model, o_orderkey AS k, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS done, round(o_orderkey % 4 * 0.35::DOUBLE, 2) AS c FROM orders) GROUP BY model)"),
    "e12_narrative_inputs": sql("as_of:d isin score:f signal strengths weaknesses red_flags", "SELECT c.as_of, c.isin, CASE WHEN n_flags = 0 THEN factor_score END AS score, CASE WHEN factor_score IS NULL THEN NULL WHEN n_flags > 0 THEN 'SELL' WHEN factor_score >= 75 THEN 'BUY' WHEN factor_score >= 45 THEN 'HOLD' ELSE 'SELL' END AS signal, strengths, weaknesses, red_flags FROM scored c LEFT JOIN flag_sums USING (as_of, isin) LEFT JOIN (SELECT as_of, isin, array_to_string((list(factor ORDER BY -z, factor) FILTER (z > 0))[:3], ',') AS s0, array_to_string((list(factor ORDER BY z, factor) FILTER (z < 0))[:3], ',') AS w0, coalesce(s0, '') AS strengths, coalesce(w0, '') AS weaknesses FROM (SELECT as_of, isin, factor, CASE WHEN factor IN ('debt_to_equity', 'accruals') THEN -z ELSE z END AS z FROM fz) WHERE z IS NOT NULL GROUP BY as_of, isin) d USING (as_of, isin)"),
    "c16_page_scores": sql("doc_id score:f anchors", "SELECT doc_id, CASE WHEN k = 0 THEN 10 WHEN k = 1 THEN 10 ELSE 0 END + CASE WHEN d > 0.15 THEN 4 * least(d / 0.15, 2) ELSE 0 END - CASE WHEN k = 1 THEN 8 ELSE 0 END AS score, CASE WHEN k = 0 THEN 'balance\\s+sheet' WHEN k = 1 THEN 'cash\\s*flow\\s+statement' ELSE '' END AS anchors FROM (SELECT doc_id, doc_id % 5 AS k, CASE WHEN len(t) < 20 THEN 0 ELSE len(list_filter(t, lambda x: regexp_full_match(x, '\\(?-?[0-9,]+\\.?[0-9]*\\)?')))::DOUBLE / len(t) END AS d FROM (SELECT doc_id, list_filter(regexp_split_to_array(CASE doc_id % 5 WHEN 0 THEN 'Consolidated Balance  Sheet ' WHEN 1 THEN 'Chairman''s Letter, with the Cash Flow Statement ' WHEN 2 THEN repeat('1,234.5 (67) x ', 400) ELSE '' END || text, '\\s+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL))"),
    "c4_legal_names": f"SELECT s_suppkey, {_NORMAL.format('s_name')} || CASE WHEN s_suppkey % 6 = 3 THEN ' pvt' ELSE '' END AS name FROM supplier",
    "c5_article_ids": f"SELECT doc_id, a AS article_id, a || CASE WHEN doc_id % 3 = 0 THEN ':' || doc_id ELSE '' END AS news_id FROM (SELECT doc_id, substr(sha1(CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id ELSE {_NORMAL.format('text')} || '|2024-01-05' END), 1, 20) AS a FROM documents WHERE text IS NOT NULL)",
    "c6_indian_time": "SELECT event_id, (ts + INTERVAL 330 MINUTE)::VARCHAR AS local FROM events",
    "c13_amounts_in_crore": sql("o_orderkey crore:f", "SELECT o_orderkey, o_totalprice::DOUBLE * [1e-7, 1e-4, 1e-2, 1e-1, 1.0, 1e2][o_orderkey % 6 + 1] AS crore FROM orders"),
    "c14_config_version": "SELECT o_orderkey, substr(sha256('{\"priority\": \"' || o_orderpriority || '\", \"status\": \"' || o_orderstatus || '\", \"top_n\": ' || o_custkey % 5 || '}'), 1, 8) AS version FROM orders",
    "c17_scoring_text": "SELECT doc_id, head || CASE WHEN doc_id % 4 = 3 AND trim(text, ' ') NOT IN ('', head) THEN '. ' || trim(text, ' ') ELSE '' END AS said FROM (SELECT *, source || ' in ' || lang AS head FROM documents WHERE text IS NOT NULL)",
    "c18_shown": "SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 10 AND 20 THEN 'th' ELSE CASE p_partkey % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS place, CASE WHEN p_partkey % 50 = 0 THEN '—' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS took, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN a >= 100 THEN format('{:,.0f}', a) ELSE format('{:,.2f}', a) END AS amount FROM (SELECT p_partkey, p_partkey * 7 AS s, p_partkey::DOUBLE * 25 / 4 AS a FROM part)",
    "c19_json": "SELECT o_orderstatus AS status, o_orderkey AS k, o_custkey AS first_key FROM orders",
    "c21_token_costs": sql("o_orderkey cost:f", "SELECT o_orderkey, (r.i * (o_custkey * 100 + 1.25 * (o_orderkey % 10 * 50) + 0.1 * (o_orderkey % 7 * 90)) + r.o * o_custkey) * CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1 END / 1e6 AS cost FROM orders ASOF JOIN (VALUES (0, DATE '1990-01-01', 3.0::DOUBLE, 15.0::DOUBLE), (0, DATE '1995-06-01', 2.0, 10.0), (1, DATE '1994-01-01', 0.5, 4.0)) r(m, since, i, o) ON o_custkey % 2 = r.m AND o_orderdate::DATE >= r.since"),
    "c22_local_names": "SELECT p_partkey, p_brand AS name FROM part",
    "x14_factor_rows": sql("as_of:d isin family factor z:f share:f", "SELECT as_of, isin, 'momentum' AS family, factor, z, share FROM mshare"),
    "x14_drivers": sql("as_of:d isin strengths weaknesses", "SELECT as_of, isin, coalesce(array_to_string((list(factor ORDER BY -z, factor) FILTER (z > 0))[:3], ','), '') AS strengths, coalesce(array_to_string((list(factor ORDER BY z, factor) FILTER (z < 0))[:3], ','), '') AS weaknesses FROM mfz WHERE z IS NOT NULL GROUP BY ALL"),
    "x15_stale": sql("as_of:d isin version stale", "SELECT as_of, isin, CASE WHEN as_of < DATE '2000-01-01' THEN 'v1' ELSE 'v2' END AS version, as_of < DATE '2000-01-01' AS stale FROM grid"),
    "x16_dataset_status": sql("as_of:d isin dataset n last:d status", "SELECT * FROM statuses"),
    "x17_diagnosis": sql("as_of:d isin factor dataset reason", """
      SELECT r.as_of, r.isin, factor, CASE factor
        WHEN 'momentum_12_1' THEN CASE WHEN sp = 'ABSENT' THEN 'prices' END
        WHEN 'news_sentiment_30d' THEN CASE WHEN sn = 'ABSENT' OR nn < 3 THEN 'news' END
        WHEN 'interest_coverage' THEN CASE WHEN sa = 'ABSENT' OR interest_expense IS NULL OR profit_before_tax IS NULL THEN 'annual' END
        WHEN 'revenue_cagr_3y' THEN CASE WHEN sa = 'ABSENT' OR na < 2 OR revenue IS NULL THEN 'annual' END
        ELSE CASE WHEN sq = 'ABSENT' OR nq < 5 THEN 'quarterly' END END AS dataset,
      CASE factor
        WHEN 'momentum_12_1' THEN CASE WHEN sp = 'ABSENT' THEN 'no prices' ELSE u END
        WHEN 'news_sentiment_30d' THEN CASE WHEN sn = 'ABSENT' THEN 'no news' WHEN nn < 3 THEN 'fewer than 3 scored articles' ELSE u END
        WHEN 'interest_coverage' THEN CASE WHEN sa = 'ABSENT' THEN 'no annual' WHEN profit_before_tax IS NULL AND interest_expense IS NULL THEN 'not populated: profit_before_tax,interest_expense' WHEN profit_before_tax IS NULL THEN 'not populated: profit_before_tax' WHEN interest_expense IS NULL THEN 'not populated: interest_expense' ELSE u END
        WHEN 'revenue_cagr_3y' THEN CASE WHEN sa = 'ABSENT' THEN 'no annual' WHEN na < 2 THEN na || ' annual report(s), needs 2' WHEN revenue IS NULL THEN 'not populated: revenue' ELSE u END
        ELSE CASE WHEN sq = 'ABSENT' THEN 'no quarterly' WHEN nq < 5 THEN nq || ' quarter(s), needs 5' ELSE u END END AS reason
      FROM (SELECT *, 'undefined for this company' AS u FROM raws WHERE raw IS NULL AND factor IN ('momentum_12_1', 'news_sentiment_30d', 'interest_coverage', 'quarterly_pat_yoy', 'revenue_cagr_3y')) r
      JOIN has ON has.as_of = r.as_of AND has.isin = r.isin LEFT JOIN history h ON h.as_of = r.as_of AND h.isin = r.isin AND h.rn = 1"""),
    "x18_statement_items": sql("isin item fy1997:f fy1998:f fy1999:f fy2000:f", f"SELECT isin, item, max(amount) FILTER (y = 1997) AS fy1997, max(amount) FILTER (y = 1998) AS fy1998, max(amount) FILTER (y = 1999) AS fy1999, max(amount) FILTER (y = 2000) AS fy2000 FROM (UNPIVOT (SELECT isin, year(period_end_date) AS y, {_ITEMS} FROM consolidated) ON {_ITEMS} INTO NAME item VALUE amount) GROUP BY ALL"),
    "b2_rebalances": sql("as_of:d members n_scored skipped", "SELECT as_of, coalesce(m, 0) AS members, coalesce(s, 0) AS n_scored, coalesce(m, 0) < 10 OR coalesce(s, 0) < 10 AS skipped FROM dates LEFT JOIN (SELECT as_of, count(*) AS m FROM grid GROUP BY 1) USING (as_of) LEFT JOIN (SELECT as_of, count(z) AS s FROM mz GROUP BY 1) USING (as_of)"),
    "b8_comparison": sql("metric strategy:f benchmark:f excess:f", f"SELECT metric, strategy, benchmark, strategy - benchmark AS excess FROM ({_unpivoted('(SELECT date, nav FROM navs WHERE k > 0)', 'strategy')}) JOIN ({_unpivoted('ew', 'benchmark')}) USING (metric)"),
    "b10_warnings": sql("warning n:f", f"SELECT 'SURVIVORSHIP' AS warning, count(*) AS n FROM periods WHERE NOT (as_of >= (SELECT min(from_date) FROM membership) AND until <= DATE '2000-12-31') HAVING count(*) > 0 UNION ALL SELECT 'SKIPPED', count(*) FROM (SELECT as_of, count(g.isin) AS m, count(z) AS s FROM dates LEFT JOIN grid g USING (as_of) LEFT JOIN mz USING (as_of, isin) GROUP BY as_of) WHERE m < 10 OR s < 10 HAVING count(*) > 0 UNION ALL SELECT 'PARTIAL_COVERAGE', avg(s / m) * 100 FROM (SELECT as_of, count(g.isin) AS m, count(z) AS s FROM dates LEFT JOIN grid g USING (as_of) LEFT JOIN mz USING (as_of, isin) GROUP BY as_of) WHERE m >= 10 AND s >= 10 HAVING avg(s / m) < 0.8 UNION ALL SELECT 'IMPLAUSIBLE_SHARPE', sharpe FROM {_metrics('ew')} WHERE sharpe > 3"),
    "b11_shuffled_returns": sql("isin as_of:d until:d fwd:f", "SELECT a.isin, a.as_of, a.until, b.fwd FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY isin) AS k FROM returns) a JOIN (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY sha1(isin || '|' || as_of::DATE::VARCHAR || '|0'), isin) AS k FROM returns) b ON a.as_of = b.as_of AND a.k = b.k"),
    "r4_best_mentions": sql("id isin confidence:f method", "SELECT id, isin, c AS confidence, m AS method FROM (SELECT *, row_number() OVER (PARTITION BY id, isin ORDER BY c DESC, m DESC, n DESC) AS r FROM (SELECT l_orderkey AS id, l_suppkey % 20 AS isin, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN l_linenumber * 0.1::DOUBLE + 0.2 ELSE round((l_linenumber * 0.1::DOUBLE + 0.2) * 0.7, 4) END AS c, CASE WHEN l_returnflag = 'N' THEN 'HEADLINE' ELSE 'BODY' END AS m FROM lineitem)) WHERE r = 1"),
    "r6_stored_articles": f"SELECT news_id, isin, content_hash, day::VARCHAR AS day FROM (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY day) AS k FROM (SELECT *, row_number() OVER (PARTITION BY isin, content_hash, day ORDER BY news_id) AS j FROM (SELECT substr(sha1(CASE WHEN url <> '' THEN url ELSE lower(headline) || '|' || day::DATE::VARCHAR END), 1, 20) || CASE WHEN k % 4 <> 0 THEN ':' || (k % 7) ELSE '' END AS news_id, CASE WHEN k % 4 <> 0 THEN (k % 7)::INT END AS isin, substr(sha1(lower(headline)), 1, 16) AS content_hash, day::DATE AS day FROM {_ARTICLES})) WHERE j = 1) WHERE k = 1",
    "r7_reresolved": "WITH l AS (SELECT l_orderkey, l_suppkey, max(year(l_shipdate)) AS y FROM lineitem GROUP BY ALL) SELECT CASE WHEN y = 1998 THEN 'REMOVED' ELSE 'CHANGED' END AS change, count(*) AS n FROM l WHERE y >= 1996 GROUP BY 1 UNION ALL SELECT 'SCORES', count(*) FROM l WHERE y <> 1998",
    "r8_scored_once": "SELECT doc_id, length(text) AS score FROM documents WHERE text IS NOT NULL",
    "r9_signed_scores": sql("text label score:f", "SELECT event_id::VARCHAR AS text, CASE WHEN p >= g AND p >= u THEN 'positive' WHEN g >= u THEN 'negative' ELSE 'neutral' END AS label, (p - g) / 10.0::DOUBLE AS score FROM (SELECT event_id, event_id % 7 AS p, event_id % 5 AS g, event_id % 3 AS u FROM events)"),
    "r10_confirmed": sql("id isin confidence:f method", "SELECT l_orderkey AS id, l_suppkey AS isin, 0.9 AS confidence, 'BODY' AS method FROM lineitem a WHERE l_linenumber = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R')"),
}
