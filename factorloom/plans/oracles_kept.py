"""DuckDB SQL for the queries of ``kept``, written apart from their plans."""

from __future__ import annotations

from factorloom.plans import oracles_more
from factorloom.plans.oracles import _FAMILY, _WEIGHT, PARTS, run_parts, sql, z_parts

_FACTORS = ("momentum_12_1", "price_to_200dma", "relative_strength_6m")
_RUNS = [(f"{f}-{n}-{c}", f, n, 10, 1_000_000.0, c == "costs", 0.0, 0.0) for f in _FACTORS for n in (5, 20) for c in ("costs", "free")]
_RUNS += [("picky", "momentum_12_1", 20, 97, 500_000.0, True, 0.0, 0.0), ("brokered", "relative_strength_6m", 5, 10, 1_000_000.0, True, 0.001, 20.0)]
PARTS |= {"zs": "SELECT as_of, isin, factor, z FROM mzz"} | run_parts("run", _RUNS, "zs")
PARTS["dealt_returns"] = "SELECT a.isin, a.as_of, a.until, b.fwd FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY isin) AS k FROM returns) a JOIN (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY sha1(isin || '|' || as_of::DATE::VARCHAR || '|0'), isin) AS k FROM returns) b ON a.as_of = b.as_of AND a.k = b.k"
PARTS |= run_parts("dealt", [c for c in _RUNS if not c[5]], "zs", "dealt_returns")
PARTS["run_figures"] = """
    SELECT run_id, count(ret) AS periods, last(nav ORDER BY date) / first(nav ORDER BY date) - 1 AS total_return, (last(nav ORDER BY date) / first(nav ORDER BY date)) ** (12.0 / nullif(count(ret), 0)) - 1 AS cagr, stddev_samp(ret) * sqrt(12) AS volatility, stddev_samp(ret) FILTER (ret < 0) * sqrt(12) AS down,
      min(nav / peak - 1) AS max_drawdown, avg((ret > 0)::INT) AS hit_rate, max(ret) AS best_period, min(ret) AS worst_period, coalesce(avg(turnover), 0) AS avg_turnover, coalesce(sum(costs / capital), 0) AS total_costs_pct
    FROM (SELECT *, nav / lag(nav) OVER (PARTITION BY run_id ORDER BY date) - 1 AS ret, max(nav) OVER (PARTITION BY run_id ORDER BY date) AS peak FROM run_navs WHERE k > 0) JOIN run_configs USING (run_id) GROUP BY run_id"""


def _parts_of(body: str) -> list[str]:
    from factorloom.plans.oracles import _needed

    return _needed(body)


_METRICS = "run_id periods years:f total_return:f cagr:f volatility:f sharpe:f sortino:f max_drawdown:f calmar:f hit_rate:f best_period:f worst_period:f avg_turnover:f total_costs_pct:f"
PARTS["asked_windows"] = """
    SELECT *, CASE WHEN isin % 17 = 0 THEN NULL WHEN n % 3 <> 0 AND k <= half THEN 1 WHEN n % 9 <> 0 THEN 2 WHEN n % 27 <> 0 THEN 3 END AS fine, CASE WHEN isin % 17 = 0 THEN 'E' WHEN n % 27 = 0 THEN 'T' END AS wrong
    FROM (SELECT isin, w AS window_start, CASE WHEN w = DATE '1999-03-01' THEN DATE '1999-03-20' ELSE last_day(w) END AS window_end, isin + year(w) * 12 + month(w) AS n, row_number() OVER (ORDER BY isin, w) AS k, count(*) OVER () // 2 AS half
      FROM instruments, (SELECT unnest([DATE '1999-01-01', DATE '1999-02-01', DATE '1999-03-01']) AS w))"""
PARTS["window_news"] = """
    SELECT w.isin, 'http://x/' || w.isin || '/' || strftime(date, '%Y%m%d') AS url, 'S' || w.isin || ' trades on ' || strftime(date, '%Y%m%d') AS headline, CASE WHEN w.isin % 2 = 0 THEN 'x.com' ELSE 'unknown' END AS source, date + INTERVAL 1 DAY + INTERVAL 90 MINUTE AS published_at, window_start
    FROM asked_windows w JOIN prices p ON p.isin = w.isin AND date_trunc('month', date) = window_start WHERE fine IS NOT NULL AND n % 5 <> 0 AND day(date) % 7 <> 0"""
PARTS["told"] = "SELECT isin, as_of, CASE WHEN z >= 0.8 THEN 'BUY' WHEN z >= -0.8 THEN 'HOLD' ELSE 'SELL' END AS signal FROM mz WHERE z IS NOT NULL"
PARTS["told_next"] = "SELECT *, lag(signal) OVER (PARTITION BY isin ORDER BY as_of) AS was, lead(as_of) OVER (PARTITION BY isin ORDER BY as_of) AS next FROM told"
_WINDOWS = "(SELECT news_id, isin, score, published_at, unnest(generate_series(time_bucket(INTERVAL 10 DAY, published_at, TIMESTAMP '1970-01-01') - INTERVAL 20 DAY, time_bucket(INTERVAL 10 DAY, published_at, TIMESTAMP '1970-01-01'), INTERVAL 10 DAY)) AS start FROM news)"
PARTS["reports"] = """
    SELECT doc_id // 40 AS doc, doc_id % 40 AS page, doc_id // 40 % 7 <> 3 AS headed, doc_id % 16 AS k,
      CASE WHEN doc_id // 40 % 7 = 3 THEN '' WHEN doc_id % 16 = 0 THEN 'Consolidated Balance  Sheet' || chr(10) WHEN doc_id % 16 = 3 THEN 'Chairman''s Letter, with the Cash Flow Statement' || chr(10) WHEN doc_id % 16 IN (1, 9) THEN repeat('1,234.5 (67) x ', 3000) ELSE '' END || text AS text
    FROM documents WHERE text IS NOT NULL"""
PARTS["report_scores"] = f"""
    SELECT doc, page, strlen(text) AS n_bytes, CASE WHEN headed AND k IN (0, 3) THEN 10 ELSE 0 END - CASE WHEN headed AND k = 3 THEN 8 ELSE 0 END + CASE WHEN d > 0.15 THEN 4 * least(d / 0.15, 2) ELSE 0 END AS score
    FROM (SELECT *, CASE WHEN len(t) < 20 THEN 0 ELSE len(list_filter(t, lambda x: regexp_full_match(x, '\\(?-?[0-9,]+\\.?[0-9]*\\)?')))::DOUBLE / len(t) END AS d FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM reports))"""
PARTS["report_best"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS r FROM (SELECT *, max(score) OVER (PARTITION BY doc ORDER BY page RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS near FROM report_scores) WHERE score >= 4 OR near >= 8) WHERE r <= 12"
PARTS["report_fit"] = "SELECT *, sum(n_bytes) OVER (PARTITION BY doc) AS bytes, count(*) OVER (PARTITION BY doc) AS n FROM (SELECT *, sum(n_bytes) OVER w AS together, row_number() OVER w AS place FROM report_best WINDOW w AS (PARTITION BY doc ORDER BY score DESC, page DESC ROWS UNBOUNDED PRECEDING)) WHERE together <= 100000 OR place <= 10"
PARTS["report_refused"] = "SELECT doc, CASE WHEN best <= 0 THEN 'no headings of financial statements' WHEN n IS NULL THEN 'no page scores enough' WHEN bytes > 100000 THEN n || ' pages still weigh ' || bytes || ' bytes' END AS reason FROM (SELECT doc, max(score) AS best FROM report_scores GROUP BY doc) LEFT JOIN (SELECT DISTINCT doc, n, bytes FROM report_fit) USING (doc)"
PARTS["report_shown"] = """
    SELECT doc, page, chr(10) || '--- page ' || page || ' ---' || chr(10) || CASE WHEN tabled AND (len(own) = 0 OR len(list_filter(own, lambda x: contains(out, x))) / len(own) >= 0.6) THEN out ELSE text END AS shown
    FROM (SELECT *, page % 3 <> 0 AS tabled, list_distinct(list_filter(list_transform(l, lambda x: trim(x)), lambda x: length(x) > 12)) AS own, array_to_string(l[1:4], chr(10)) || chr(10) || CASE WHEN page % 3 = 1 THEN array_to_string(list_transform(l, lambda x: trim(x)), chr(10)) ELSE trim(coalesce(l[1], '')) || ' | b' END AS out
      FROM (SELECT *, CASE WHEN text = '' THEN [] WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS l FROM (SELECT *, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM reports)))"""
PARTS["signed_factors"] = f"SELECT as_of, isin, family, factor, CASE WHEN factor IN ('debt_to_equity', 'accruals') THEN -z ELSE z END AS z, {_WEIGHT} AS w FROM fz"
PARTS["present_families"] = "SELECT as_of, isin, family, fw / sum(fw) OVER (PARTITION BY as_of, isin) AS part FROM families WHERE family_z IS NOT NULL"
PARTS["factor_sizes"] = f"SELECT factor, {_FAMILY} * {_WEIGHT} / sum({_WEIGHT}) OVER (PARTITION BY family) AS part FROM (SELECT DISTINCT factor, family FROM raws)"
PARTS["quiet"] = "SELECT g.as_of, g.isin, g.sector, 'quiet' AS factor, median_traded AS raw FROM grid g LEFT JOIN medians_traded t ON t.as_of = g.as_of AND t.isin = g.isin"
PARTS |= z_parts("quietz", "quiet", "as_of, factor")
PARTS["own_factors"] = "SELECT as_of, isin, z, 1.0::DOUBLE AS w FROM mzz UNION ALL SELECT as_of, isin, -z, 2.0 FROM quietz"
PARTS["told_quarters"] = """
    SELECT isin, period_end_date, period_end_date + 45 AS filing_date, floor(revenue) * t * 0.01::DOUBLE AS revenue, floor(pat) * t * 0.01::DOUBLE AS pat, count(*) OVER (PARTITION BY isin, period_end_date) AS c
    FROM quarterly, (SELECT unnest([1, 100]) AS t) WHERE (t = 1 OR year(period_end_date) % 3 = 0) AND floor(revenue) * t > 0"""
_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) AS y FROM orders)"
SQL = {
    "b2_runs": sql("run_id as_of:d date:d nav:f gross_nav:f costs:f turnover:f", "SELECT * FROM run_navs WHERE k > 0"),
    "b2_run_schedule": sql("run_id as_of:d until:d members n_scored skipped", "SELECT * FROM run_dates"),
    "b6_run_metrics": sql(_METRICS, "SELECT *, round(periods / 12, 2) AS years, CASE WHEN volatility > 0 THEN (cagr - 0.065) / volatility ELSE 0 END AS sharpe, CASE WHEN down > 0 THEN (cagr - 0.065) / down ELSE 0 END AS sortino, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM run_figures"),
    "b11_shuffled_runs": sql("run_id date:d nav:f", "SELECT * FROM dealt_navs WHERE k > 0"),
    "k8_stored_runs": sql("run_id kind date:d isin:BIGINT value:f", "SELECT run_id, 'nav' AS kind, date, NULL AS isin, nav AS value FROM run_navs WHERE k > 0 AND run_id <> 'momentum_12_1-5-free' UNION ALL SELECT run_id, 'position', as_of, isin, weight FROM run_held WHERE run_id <> 'momentum_12_1-5-free' UNION ALL SELECT c.run_id, 'total_return', NULL, NULL, total_return FROM run_configs c LEFT JOIN run_figures f ON f.run_id = c.run_id WHERE c.run_id <> 'momentum_12_1-5-free'"),
    "e7_sections": sql("doc page score:f n_bytes reason", "SELECT f.doc, page, score, n_bytes, NULL::VARCHAR AS reason FROM report_fit f JOIN report_refused r ON r.doc = f.doc AND r.reason IS NULL UNION ALL SELECT doc, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT, reason FROM report_refused WHERE reason IS NOT NULL"),
    "e8_rendered": sql("doc n_chars sha256 truncated", "SELECT doc, length(t) AS n_chars, sha256(t) AS sha256, truncated FROM (SELECT doc, coalesce(string_agg(CASE WHEN n <= room THEN shown WHEN room > 200 THEN substr(shown, 1, room) END, '' ORDER BY page), '') AS t, bool_or(n > room) AS truncated FROM (SELECT *, length(shown) AS n, (28000 - coalesce(sum(length(shown)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS room FROM report_shown) GROUP BY doc)"),
    "v_own_factor": sql("as_of:d isin family mean_z:f coverage:f", "SELECT as_of, isin, 'momentum' AS family, sum(z * w) / sum(CASE WHEN z IS NOT NULL THEN w END) AS mean_z, coalesce(sum(CASE WHEN z IS NOT NULL THEN w END), 0) / sum(w) AS coverage FROM own_factors GROUP BY ALL"),
    "h_sectors": "SELECT DISTINCT r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "h_scored_dates": sql("as_of:d", "SELECT DISTINCT as_of FROM mz WHERE z IS NOT NULL"),
    "h_recent_news": sql("news_id isin published_at:VARCHAR label score:f", "SELECT news_id, isin, published_at, CASE WHEN news_id % 3 <> 0 THEN label END AS label, CASE WHEN news_id % 3 <> 0 THEN score END AS score FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY published_at DESC, news_id) AS r FROM news) WHERE r <= 5"),
    "x14_all_factor_rows": sql("as_of:d isin family factor z:f share:f", "SELECT s.as_of, s.isin, s.family, s.factor, s.z, CASE WHEN s.z IS NOT NULL THEN s.w END / sum(CASE WHEN s.z IS NOT NULL THEN s.w END) OVER (PARTITION BY s.as_of, s.isin, s.family) * p.part AS share FROM signed_factors s LEFT JOIN present_families p ON p.as_of = s.as_of AND p.isin = s.isin AND p.family = s.family"),
    "x14_all_drivers": sql("as_of:d isin strengths weaknesses", "SELECT as_of, isin, coalesce(array_to_string((list(factor ORDER BY -z, factor) FILTER (z > 0))[:3], ','), '') AS strengths, coalesce(array_to_string((list(factor ORDER BY z, factor) FILTER (z < 0))[:3], ','), '') AS weaknesses FROM signed_factors WHERE z IS NOT NULL GROUP BY ALL"),
    "x16_all_datasets": sql("as_of:d isin dataset n last:d status done", "SELECT *, NULL::BIGINT AS done FROM statuses UNION ALL SELECT as_of, g.isin, 'filings', coalesce(n, 0), NULL, CASE WHEN n < 3 THEN 'PARTIAL' ELSE 'PRESENT' END, coalesce(done, 0) FROM grid g LEFT JOIN (SELECT isin, count(*) AS n, count(*) FILTER (year(period_end_date) % 10 IN (7, 8)) AS done FROM annual WHERE isin % 4 <> 0 AND basis = 'CONSOLIDATED' AND year(period_end_date) >= 1999 - isin % 4 GROUP BY isin) f ON f.isin = g.isin"),
    "x16_blocked": f"WITH told AS ({oracles_more.SQL['x17_diagnosis']}), {', '.join(f'{p} AS ({PARTS[p]})' for p in _parts_of('FROM factor_sizes'))} SELECT as_of, isin, dataset, count(*) AS n, string_agg(t.factor, ',' ORDER BY t.factor) AS factors, round(sum(part)::DOUBLE, 9)::FLOAT::DOUBLE AS share FROM (SELECT as_of, isin, factor, unnest(string_split(dataset, ',')) AS dataset FROM told) t JOIN factor_sizes USING (factor) GROUP BY ALL",
    "s6_resolved_quarters": sql("isin period_end_date:d filing_date:d revenue:f pat:f", "SELECT isin, period_end_date, filing_date, revenue, pat FROM (SELECT q.*, row_number() OVER (PARTITION BY q.isin, period_end_date ORDER BY abs(log10(revenue / coalesce(scale, revenue))), revenue) AS r FROM told_quarters q LEFT JOIN (SELECT isin, list_sort(list(revenue))[count(*) // 2 + 1] AS scale FROM told_quarters WHERE c = 1 GROUP BY isin) s ON s.isin = q.isin WHERE c = 1 OR scale IS NOT NULL) WHERE r = 1"),
    "j9_same_quarter": sql("isin period_end_date:d value:f before:f change:f", "SELECT isin, period_end_date, value, before, (value - before) / nullif(abs(before), 0) AS change FROM (SELECT a.isin, a.period_end_date, any_value(a.pat) AS value, arg_min(b.pat, (abs(b.period_end_date - (a.period_end_date::DATE - 365)), b.period_end_date)) AS before FROM quarterly a LEFT JOIN quarterly b ON b.isin = a.isin AND abs(b.period_end_date - (a.period_end_date::DATE - 365)) <= 14 GROUP BY a.isin, a.period_end_date)"),
    "s18_backfill": sql("isin window_start:d window_end:d articles:INT status detail fetched_at:d", "SELECT w.*, coalesce(c, 0) AS articles, CASE WHEN fine IS NULL THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN wrong = 'E' THEN substr(repeat('no route to host ', 20), 1, 200) WHEN wrong = 'T' THEN 'throttled' END AS detail, make_date(2024, 1, coalesce(fine, 3)) AS fetched_at FROM asked_windows w LEFT JOIN (SELECT isin, window_start, count(*) AS c FROM window_news GROUP BY ALL) n ON n.isin = w.isin AND n.window_start = w.window_start"),
    "s18_backfilled_articles": sql("isin url headline source published_at:VARCHAR window_start:d", "SELECT * FROM window_news"),
    "c11_truncated": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) ELSE text END AS detail, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS shown FROM documents",
    "st_signal_alerts": sql("isin told_on:d kind was now", "SELECT isin, as_of AS told_on, 'CHANGED' AS kind, was, signal AS now FROM told_next WHERE was <> signal UNION ALL SELECT isin, as_of + 45, 'STALE', signal, NULL FROM told_next WHERE next IS NULL OR next > as_of + 45"),
    "s3_provider_prices": sql("isin date:d adj_close:f volume", "SELECT isin, date, adj_close, volume FROM prices WHERE isin % 7 = 1 AND isin < 100 AND date >= DATE '2000-02-20' AND date < DATE '2000-06-10'"),
    "st_provider_months": sql("isin date:d adj_close:f volume", "SELECT isin, date, adj_close, volume FROM prices WHERE date BETWEEN DATE '2000-01-10' AND DATE '2000-05-31'"),
    "st_month_counts": sql("month:d isin n", "SELECT date_trunc('month', published_at) AS month, isin, count(*) AS n FROM news GROUP BY ALL"),
    "st_sentiment_windows": sql("start:d isin n mean_score:f", f"SELECT start, isin, count(*) AS n, avg(score) AS mean_score FROM {_WINDOWS} GROUP BY ALL"),
    "st_decayed_sentiment": sql("start:d isin n score:f", f"SELECT start, isin, count(*) AS n, sum(score * w) / sum(w) AS score FROM (SELECT *, 0.5::DOUBLE ** (trunc((epoch_us(start + INTERVAL 30 DAY) - epoch_us(published_at)) / 1e6) / 86400 / 7) AS w FROM {_WINDOWS}) GROUP BY ALL"),
    "st_distinct_stories": sql("isin text content_hash", "SELECT DISTINCT isin, 'Story ' || (news_id % 50) AS text, substr(sha1('story ' || (news_id % 50)), 1, 16) AS content_hash FROM news"),
    "st_stored_news": sql("news_id isin text", "SELECT news_id, isin, 'Story ' || (news_id % 50) AS text FROM news"),
    "k1_stored_upsert": f"SELECT o_orderkey, o_custkey, CASE WHEN y >= 1998 THEN 'from 1998' WHEN y >= 1996 THEN 'from 1996' ELSE o_orderstatus END AS o_orderstatus, y::INTEGER AS y FROM {_ORDERS}",
    "k5_stored_delete": "SELECT * FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL) WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "k6_stored_rebuild": f"SELECT 1 AS version, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM {_ORDERS} GROUP BY 2 UNION ALL SELECT 2, o_orderstatus, count(*), sum(o_orderkey)::BIGINT FROM {_ORDERS} WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 3, 'done', count(*), sum(o_orderkey)::BIGINT FROM {_ORDERS} WHERE o_orderstatus = 'F' GROUP BY 2",
    "r7_stored_reresolution": sql("id isin method confidence:f y score:f", "SELECT id, isin, 'HEADLINE' AS method, CASE WHEN y >= 1996 THEN 0.8 ELSE 0.9 END AS confidence, y::INTEGER AS y, CASE WHEN y >= 1993 THEN y - 1990 END AS score FROM (SELECT l_orderkey AS id, l_suppkey AS isin, max(year(l_shipdate)) AS y FROM lineitem GROUP BY ALL) WHERE y <> 1998"),
    "s20_evolved_orders": sql("k:BIGINT price:f o_orderstatus priority day:d", "SELECT o_orderkey AS k, CASE WHEN y < 1994 THEN trunc(o_totalprice) WHEN y <= 1996 THEN o_totalprice END AS price, CASE WHEN y < 1994 OR y >= 1997 THEN o_orderstatus END AS o_orderstatus, CASE WHEN y BETWEEN 1994 AND 1996 THEN o_orderpriority END AS priority, CASE WHEN y >= 1997 THEN o_orderdate END AS day FROM (SELECT *, year(o_orderdate) AS y FROM orders)"),
    "s20_schema_changes": "SELECT column_name, kind, what, (SELECT count(*) FROM orders) AS n FROM (VALUES ('day', 'ADDED', 'date'), ('k', 'WIDENED', 'int -> bigint'), ('o_orderpriority', 'MISSING', 'string'), ('o_orderstatus', 'INCOMPATIBLE', 'string -> boolean'), ('price', 'WIDENED', 'float -> double')) AS t(column_name, kind, what)",
}
