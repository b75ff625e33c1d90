"""DuckDB SQL for the registered queries, written apart from their plans."""

from __future__ import annotations

#: parts that queries name; each may use those before it
PARTS = {
    "instruments": "SELECT s_suppkey AS isin, 'S' || s_suppkey AS symbol, s_name AS name, r_name AS sector, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ln": "SELECT l_suppkey AS isin, l_shipdate::DATE AS date, l_quantity::DECIMAL(18,2) AS qty, l_extendedprice::DECIMAL(18,2) AS ext, l_discount::DECIMAL(4,2) AS disc, l_tax::DECIMAL(4,2) AS tax, l_returnflag AS flag FROM lineitem",
    "prices": "SELECT isin, date, sum(ext)::DOUBLE / sum(qty)::DOUBLE AS adj_close, sum(qty)::BIGINT AS volume, sum(ext)::DOUBLE AS traded_value FROM ln GROUP BY ALL",
}


def _statements(period_end: str) -> str:
    return f"""
    SELECT isin, period_end_date, revenue, pat, ocf, taxed * 0.5 AS capex, pat * 1.33 AS profit_before_tax, CASE WHEN isin % 10 = 0 THEN 0.0 WHEN isin % 10 = 3 THEN NULL ELSE e * 0.01 END AS interest_expense, CASE WHEN isin % 6 = 0 THEN e * 0.07 END AS ebitda, CASE WHEN isin % 8 = 0 THEN pat * 0.8 END AS fcf,
      e * 0.02 AS depreciation, total_debt, cash, e * 0.9 AS total_equity, e * 1.6 AS total_assets, pat / 1000 AS eps, contingent_liabilities,
      CASE isin % 7 WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'NOT_STATED' ELSE 'UNMODIFIED' END AS auditor_opinion
    FROM (SELECT isin, ({period_end})::DATE AS period_end_date, sum(ext)::DOUBLE AS e, round(sum(ext * (1 - disc))::DOUBLE, 4) AS revenue, round(sum(ext * (disc - 0.048::DECIMAL(4,3)))::DOUBLE, 4) AS pat,
      round(sum(ext * (disc - tax))::DOUBLE, 4) AS ocf, round(sum(ext * tax)::DOUBLE, 4) AS taxed, coalesce(sum(ext) FILTER (flag = 'R'), 0)::DOUBLE AS total_debt, coalesce(sum(ext) FILTER (flag = 'A'), 0)::DOUBLE AS cash,
      coalesce(sum(ext) FILTER (qty >= 25), 0)::DOUBLE AS contingent_liabilities FROM ln GROUP BY ALL)"""


_QUARTER_END = "last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH)"
PARTS |= {
    "yearly": _statements("make_date(year(date), 12, 31)"),
    "annual": """
    SELECT *, (period_end_date + INTERVAL 6 MONTH)::DATE AS filing_date, CASE WHEN isin % 5 = 0 THEN 'STANDALONE' ELSE 'CONSOLIDATED' END AS basis FROM yearly
    UNION ALL SELECT * REPLACE (revenue * 0.5 AS revenue), (period_end_date + INTERVAL 6 MONTH)::DATE, 'STANDALONE' FROM yearly WHERE isin % 5 = 1""",
    "quarters": _statements(_QUARTER_END),
    "quarterly": "SELECT isin, period_end_date, period_end_date + 45 AS filing_date, revenue, pat FROM quarters",
    "holding": f"""
    SELECT isin, quarter_end, quarter_end + 21 AS disclosed_date, round(100.0::DOUBLE * n / c, 4) AS promoter_pct, CASE WHEN isin % 9 <> 0 THEN round(100.0::DOUBLE * r / c, 4) END AS promoter_pledged_pct
    FROM (SELECT isin, {_QUARTER_END}::DATE AS quarter_end, count(*) FILTER (flag = 'N') AS n, count(*) FILTER (flag = 'R') AS r, count(*) AS c FROM ln GROUP BY ALL)""",
    "membership": "SELECT isin, min(date) AS from_date, CASE WHEN isin % 7 = 0 THEN max(date) END AS to_date FROM ln GROUP BY isin",
    "news": """
    SELECT event_id AS news_id, user_id AS isin, ts AS published_at, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS label,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END * least(1.0::DOUBLE, abs(value) / 100) AS score, 0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS confidence FROM events""",
    "dates": "SELECT last_day(d)::DATE AS as_of FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS d)",
    "grid": "SELECT DISTINCT isin, as_of, sector, industry FROM dates JOIN membership ON from_date <= as_of AND (to_date IS NULL OR as_of < to_date) JOIN instruments USING (isin)",
    "periods": "SELECT * FROM (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS until FROM dates) WHERE until IS NOT NULL",
    "returns": """
    SELECT isin, as_of, until, b / a - 1 AS fwd FROM (
      SELECT g.isin, g.as_of, until, first(adj_close ORDER BY date) AS a, last(adj_close ORDER BY date) AS b
      FROM grid g JOIN periods USING (as_of) JOIN prices p ON p.isin = g.isin AND p.date > g.as_of AND p.date <= until GROUP BY ALL) WHERE a > 0""",
    "visible": """
    SELECT * FROM (SELECT a.*, g.as_of, CASE WHEN bool_or(basis = 'CONSOLIDATED') OVER w THEN 'CONSOLIDATED' ELSE min(basis) OVER w END AS chosen
      FROM grid g JOIN annual a ON a.isin = g.isin AND filing_date <= as_of WINDOW w AS (PARTITION BY as_of, g.isin)) WHERE basis = chosen""",
    "history": "SELECT *, row_number() OVER (PARTITION BY as_of, isin ORDER BY period_end_date DESC, filing_date DESC)::INT AS rn FROM visible",
    "held": "SELECT * FROM (SELECT h.*, g.as_of, row_number() OVER (PARTITION BY as_of, g.isin ORDER BY quarter_end DESC)::INT AS rn FROM grid g JOIN holding h ON h.isin = g.isin AND disclosed_date <= as_of) WHERE rn <= 6",
    "recent": "SELECT * FROM (SELECT q.*, g.as_of, row_number() OVER (PARTITION BY as_of, g.isin ORDER BY period_end_date DESC)::INT AS rn FROM grid g JOIN quarterly q ON q.isin = g.isin AND filing_date <= as_of) WHERE rn <= 8",
    "priced": "SELECT g.*, CASE WHEN as_of - p.date <= 45 THEN adj_close END AS price FROM grid g ASOF LEFT JOIN prices p ON g.isin = p.isin AND g.as_of >= p.date",
    "panel": """
    SELECT *, CASE WHEN cap + total_debt - cash > 0 THEN cap + total_debt - cash END AS ev, profit_before_tax + CASE WHEN interest_expense IS NULL THEN 0 ELSE interest_expense END AS ebit FROM (
      SELECT p.*, h.* EXCLUDE (isin, as_of), CASE WHEN eps >= 0.01 AND pat > 0 AND price * (pat * 1e7 / eps) / 1e7 > 0 THEN price * (pat * 1e7 / eps) / 1e7 END AS cap
      FROM priced p LEFT JOIN history h ON h.isin = p.isin AND h.as_of = p.as_of AND rn = 1)""",
    "cagr": """
    SELECT as_of, isin, CASE WHEN ra > 0 AND rb > 0 AND (e - s) / 365.25 >= 0.5 THEN (rb / ra) ** (365.25 / (e - s)) - 1 END AS revenue_cagr_3y, CASE WHEN pa > 0 AND pb > 0 AND (e - s) / 365.25 >= 0.5 THEN (pb / pa) ** (365.25 / (e - s)) - 1 END AS pat_cagr_3y
    FROM (SELECT as_of, isin, first(revenue ORDER BY period_end_date) AS ra, last(revenue ORDER BY period_end_date) AS rb, first(pat ORDER BY period_end_date) AS pa, last(pat ORDER BY period_end_date) AS pb, min(period_end_date) AS s, max(period_end_date) AS e FROM history WHERE rn <= 4 GROUP BY ALL HAVING count(*) >= 2)""",
    "margins": "SELECT as_of, isin, b - a AS margin_trend FROM (SELECT as_of, isin, first(pat / revenue ORDER BY period_end_date) AS a, last(pat / revenue ORDER BY period_end_date) AS b FROM history WHERE rn <= 5 AND revenue > 0 GROUP BY ALL HAVING count(*) >= 2)",
}


def _yoy(column: str) -> str:
    return f"""
    SELECT as_of, isin, x0 / base - 1 AS yoy FROM (
      SELECT as_of, isin, first({column} ORDER BY abs(period_end_date - (newest - INTERVAL 1 YEAR)::DATE), period_end_date) AS base, first(x0) AS x0
      FROM (SELECT *, max(period_end_date) OVER w AS newest, last({column}) OVER (w ORDER BY period_end_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0, count(*) OVER w AS n FROM recent WHERE {column} IS NOT NULL WINDOW w AS (PARTITION BY as_of, isin))
      WHERE n >= 2 AND abs(period_end_date - (newest - INTERVAL 1 YEAR)::DATE) <= 45 GROUP BY ALL) WHERE base > 0"""


def _back(months: int, name: str) -> str:
    return f"(SELECT g.as_of, g.isin, CASE WHEN g.t - p.date <= 15 THEN adj_close END AS {name} FROM (SELECT *, (as_of - INTERVAL {months} MONTH)::DATE AS t FROM grid) g ASOF LEFT JOIN prices p ON g.isin = p.isin AND g.t >= p.date)"


_VALUE = {"earnings_yield": "CASE WHEN price > 0 THEN eps / price END", "book_to_price": "CASE WHEN cap > 0 THEN total_equity / cap END", "ebitda_to_ev": "CASE WHEN ev > 0 THEN CASE WHEN ebitda IS NOT NULL THEN ebitda ELSE ebit + depreciation END / ev END", "fcf_yield": "CASE WHEN cap > 0 THEN CASE WHEN fcf IS NOT NULL THEN fcf ELSE ocf - capex END / cap END", "peg_inverse": "CASE WHEN price > 0 AND pat_cagr_3y > 0 THEN eps / price * pat_cagr_3y END"}
_QUALITY = {
    "roe": "CASE WHEN total_equity > 0 THEN pat / total_equity END", "roce": "CASE WHEN total_equity + total_debt > 0 THEN ebit / (total_equity + total_debt) END", "debt_to_equity": "CASE WHEN total_equity > 0 THEN total_debt / total_equity END",
    "interest_coverage": "CASE WHEN interest_expense > 0 THEN CASE WHEN ebit / interest_expense > 50 THEN 50.0 ELSE ebit / interest_expense END WHEN ebit > 0 THEN 50.0 END",
    "cfo_to_pat": "CASE WHEN pat > 0 THEN ocf / pat END", "accruals": "CASE WHEN total_assets > 0 THEN (pat - ocf) / total_assets END",
}


def _long(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT as_of, isin, sector, '{n}' AS factor, {c} AS raw FROM {source}" for n, c in columns.items())


PARTS |= {
    "yoy_revenue": _yoy("revenue"),
    "yoy_pat": _yoy("pat"),
    "growth": _long({"revenue_cagr_3y": "revenue_cagr_3y", "pat_cagr_3y": "pat_cagr_3y", "quarterly_revenue_yoy": "a.yoy", "quarterly_pat_yoy": "b.yoy", "margin_trend": "margin_trend"}, "grid LEFT JOIN cagr USING (as_of, isin) LEFT JOIN margins USING (as_of, isin) LEFT JOIN yoy_revenue a USING (as_of, isin) LEFT JOIN yoy_pat b USING (as_of, isin)"),
    "value": _long(_VALUE, "panel LEFT JOIN cagr USING (as_of, isin)"),
    "quality": _long(_QUALITY, "panel"),
    "windows": "SELECT g.as_of, g.isin, count(*) FILTER (g.as_of - p.date <= 410) AS n410, count(*) FILTER (g.as_of - p.date <= 212) AS n212, list(adj_close ORDER BY date DESC) FILTER (g.as_of - p.date <= 320) AS l320 FROM grid g JOIN prices p ON p.isin = g.isin AND p.date <= g.as_of AND g.as_of - p.date <= 410 AND adj_close > 0 GROUP BY ALL",
    "px": f"SELECT g.as_of, g.isin, sector, m0, m1, m6, m12, n410, l320[:200] AS l, CASE WHEN n212 >= 20 THEN m0 / m6 - 1 END AS half FROM grid g LEFT JOIN {_back(0, 'm0')} USING (as_of, isin) LEFT JOIN {_back(1, 'm1')} USING (as_of, isin) LEFT JOIN {_back(6, 'm6')} USING (as_of, isin) LEFT JOIN {_back(12, 'm12')} USING (as_of, isin) LEFT JOIN windows USING (as_of, isin)",
    "medians": "SELECT *, median(half) OVER (PARTITION BY as_of) AS half_median FROM px",
    "momentum": _long({"momentum_12_1": "CASE WHEN n410 >= 40 THEN m1 / m12 - 1 END", "price_to_200dma": "CASE WHEN len(l) >= 30 THEN l[1] / list_avg(l) END", "relative_strength_6m": "half - half_median"}, "medians"),
}


def z_parts(name: str, source: str, keys: str) -> dict[str, str]:
    """Parts that end in ``name``: sector-relative z of raw in ``source`` within ``keys``."""
    scale = lambda p: f"CASE WHEN {p}mad > 0 THEN {p}mad * 1.4826 WHEN {p}sd0 > 0 THEN {p}sd0 END"
    clip = lambda p: f"CASE WHEN raw IS NULL THEN NULL WHEN {p}scale IS NULL THEN raw ELSE least(greatest(raw, {p}med - 3 * {p}scale), {p}med + 3 * {p}scale) END"
    u, s = f"PARTITION BY {keys}", f"PARTITION BY {keys}, sector"
    return {
        f"{name}_1": f"SELECT *, median(raw) OVER u AS umed, stddev_samp(raw) OVER u AS usd0, median(raw) OVER s AS smed, stddev_samp(raw) OVER s AS ssd0, count(raw) OVER s AS sn FROM {source} WINDOW u AS ({u}), s AS ({s})",
        f"{name}_2": f"SELECT *, median(abs(raw - umed)) OVER ({u}) AS umad, median(abs(raw - smed)) OVER ({s}) AS smad FROM {name}_1",
        f"{name}_3": f"SELECT *, {scale('u')} AS uscale, {scale('s')} AS sscale FROM {name}_2",
        f"{name}_4": f"SELECT *, {clip('u')} AS uclip, {clip('s')} AS sclip FROM {name}_3",
        f"{name}_5": f"SELECT *, avg(uclip) OVER u AS um, stddev_samp(uclip) OVER u AS us, avg(sclip) OVER s AS sm, stddev_samp(sclip) OVER s AS ss FROM {name}_4 WINDOW u AS ({u}), s AS ({s})",
        name: f"SELECT * EXCLUDE (um, us, sm, ss), CASE WHEN std > 0 THEN (raw - mean) / std WHEN raw IS NOT NULL THEN 0.0 END AS z FROM (SELECT *, CASE WHEN sn >= 5 THEN sm ELSE um END AS mean, CASE WHEN sn >= 5 THEN ss ELSE us END AS std FROM {name}_5)",
    }


def phi(z: str) -> str:
    """The normal distribution function, by the Chebyshev fit to erfc."""
    t = f"(1 / (1 + 0.5 * (abs({z}) / sqrt(2.0))))"
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({c} + {t} * {poly})"
    tail = f"({t} * exp(-({z}) * ({z}) / 2 + {poly}) / 2)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def standard(x: str, keys: str) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER (PARTITION BY {keys}) > 0 THEN ({x} - avg({x}) OVER (PARTITION BY {keys})) / stddev_samp({x}) OVER (PARTITION BY {keys}) WHEN {x} IS NOT NULL THEN 0.0 END"


_WEIGHT = "CASE factor WHEN 'roe' THEN 0.20 WHEN 'roce' THEN 0.20 WHEN 'debt_to_equity' THEN 0.10 WHEN 'interest_coverage' THEN 0.10 WHEN 'cfo_to_pat' THEN 0.25 WHEN 'accruals' THEN 0.15 ELSE 1.0 END::DOUBLE"
_FAMILY = "CASE family WHEN 'value' THEN 0.25 WHEN 'quality' THEN 0.30 WHEN 'growth' THEN 0.20 WHEN 'momentum' THEN 0.15 WHEN 'sentiment' THEN 0.10 END::DOUBLE"
PARTS |= {
    "m12": "SELECT * FROM momentum WHERE factor = 'momentum_12_1'",
    **z_parts("mz", "m12", "as_of"),
    **z_parts("mzz", "momentum", "as_of, factor"),
    "accrual": "SELECT * FROM quality WHERE factor = 'accruals'",
    **z_parts("wz", "accrual", "as_of"),
    "old_news": "SELECT * REPLACE (published_at - to_days((8766 - news_id % 20 * 30)::INT) AS published_at) FROM news",
    "sentiment": "SELECT g.as_of, g.isin, sector, 'news_sentiment_30d' AS factor, raw FROM grid g LEFT JOIN (SELECT as_of, isin, sum(score * w) / sum(w) AS raw FROM (SELECT g.as_of, g.isin, score, 0.5::DOUBLE ** (greatest(epoch_us(g.as_of::TIMESTAMP) - epoch_us(published_at), 0) / 86400e6 / 7) AS w FROM grid g JOIN old_news n ON n.isin = g.isin AND n.confidence >= 0.7 AND published_at >= g.as_of - INTERVAL 30 DAY AND published_at < g.as_of + INTERVAL 1 DAY) GROUP BY ALL HAVING count(*) >= 3) s ON s.as_of = g.as_of AND s.isin = g.isin",
    "raws": "SELECT *, 'sentiment' AS family FROM sentiment UNION ALL SELECT *, 'value' AS family FROM value UNION ALL SELECT *, 'quality' FROM quality UNION ALL SELECT *, 'growth' FROM growth UNION ALL SELECT *, 'momentum' FROM momentum",
    **z_parts("fz", "raws", "as_of, factor"),
    "signed": f"SELECT as_of, isin, family, CASE WHEN factor IN ('debt_to_equity', 'accruals') THEN -z ELSE z END AS z, {_WEIGHT} AS w FROM fz",
    "family_means": "SELECT as_of, isin, family, sum(z * w) / sum(CASE WHEN z IS NOT NULL THEN w END) AS mean_z, coalesce(sum(CASE WHEN z IS NOT NULL THEN w END), 0) / sum(w) AS coverage FROM signed GROUP BY ALL",
    "families": f"SELECT *, {_FAMILY} AS fw, {standard('mean_z', 'as_of, family')} AS family_z FROM family_means",
    "combined": "SELECT as_of, isin, sum(fw * coverage) AS coverage, CASE WHEN sum(fw * coverage) >= 0.5 THEN sum(fw * family_z) / sum(CASE WHEN family_z IS NOT NULL THEN fw END) END AS composite_z FROM families GROUP BY ALL",
    "scored": f"SELECT as_of, isin, coverage, composite_z, 100 * {phi('s')} AS factor_score FROM (SELECT *, {standard('composite_z', 'as_of')} AS s FROM combined)",
    "years": "SELECT as_of, isin, max(auditor_opinion) FILTER (rn = 1) AS opinion, max(contingent_liabilities) FILTER (rn = 1) AS contingent, max(total_equity) FILTER (rn = 1) AS equity, count(*) FILTER (pat > 0) AS n_weak, bool_and(ocf / pat < 0.5) FILTER (pat > 0) AS weak FROM history WHERE rn <= 3 GROUP BY ALL",
    "falls": "SELECT as_of, isin, count(*) AS n, max(promoter_pct) FILTER (rn = 1) AS h1, max(promoter_pct) FILTER (rn = 2) AS h2, max(promoter_pct) FILTER (rn = 3) AS h3, max(promoter_pct) FILTER (rn = 4) AS h4 FROM held WHERE rn <= 4 GROUP BY ALL",
    "flag_rows": "SELECT g.as_of, g.isin, y.*, f.* EXCLUDE (as_of, isin), h.promoter_pledged_pct AS pledged FROM grid g LEFT JOIN years y USING (as_of, isin) LEFT JOIN falls f USING (as_of, isin) LEFT JOIN held h ON h.as_of = g.as_of AND h.isin = g.isin AND h.rn = 1",
    "flags": " UNION ALL ".join(
        f"SELECT as_of, isin, '{n}' AS flag, CASE WHEN NOT coalesce({known}, false) THEN 'UNKNOWN' WHEN {test} THEN 'TRIPPED' ELSE 'CLEAR' END AS state FROM flag_rows"
        for n, test, known in (
            ("promoter_pledge", "pledged > 25", "pledged IS NOT NULL"),
            ("auditor", "opinion IN ('QUALIFIED', 'ADVERSE', 'DISCLAIMER')", "opinion IS NOT NULL AND opinion <> 'NOT_STATED'"),
            ("weak_cash_conversion", "weak", "n_weak = 3"),
            ("promoter_selling", "h1 < h2 AND h2 < h3 AND h3 < h4", "n = 4"),
            ("contingent_liabilities", "CASE WHEN equity > 0 THEN contingent > 0.5 * equity ELSE contingent > 0 END", "contingent IS NOT NULL AND equity IS NOT NULL"),
            ("rating_downgrade", "false", "false"),
        )
    ),
    "flag_sums": "SELECT as_of, isin, count(*) FILTER (state = 'TRIPPED') AS n_flags, coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (state = 'TRIPPED'), '') AS red_flags, coalesce(string_agg(flag, ',' ORDER BY flag) FILTER (state = 'UNKNOWN'), '') AS unknown_flags FROM flags GROUP BY ALL",
    "top": "SELECT as_of, isin, (1 / count(*) OVER (PARTITION BY as_of))::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY z DESC, isin) AS r FROM mz WHERE z IS NOT NULL) WHERE r <= 20",
    "ew": "SELECT until AS date, 1000000 * exp(sum(ln(1 + r)) OVER (ORDER BY until)) AS nav FROM (SELECT as_of, until, avg(fwd) AS r FROM returns GROUP BY ALL)",
    "dd": "SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret, max(nav) OVER (ORDER BY date) AS peak FROM ew",
    "medians_traded": "SELECT g.as_of, g.isin, median(traded_value) AS median_traded FROM grid g JOIN prices p ON p.isin = g.isin AND p.date <= g.as_of AND p.date >= g.as_of - 90 GROUP BY ALL",
    "prior": "SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next FROM (SELECT DISTINCT as_of FROM top)",
    "deltas": "SELECT coalesce(n.as_of, o.as_of) AS as_of, coalesce(n.weight, 0) - coalesce(o.weight, 0) AS d FROM top n FULL JOIN (SELECT next AS as_of, isin, weight FROM top JOIN prior USING (as_of) WHERE next IS NOT NULL) o ON n.as_of = o.as_of AND n.isin = o.isin",
    "traded": "SELECT as_of, coalesce(sum(d) FILTER (d > 0), 0) AS buy, coalesce(-sum(d) FILTER (d < 0), 0) AS sell, count(*) FILTER (d > 0) AS n_buy, count(*) FILTER (d < 0) AS n_sell FROM deltas GROUP BY ALL",
}


def run_parts(name: str, configs: list[tuple], z: str, returns: str = "returns") -> dict[str, str]:
    """Parts of walk-forward runs, {name}_navs at their end. configs: rows of run_id, factor, top_n, fewest, capital, costs_on, brokerage, flat; z: a part with as_of, isin, factor, z."""
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in c) + ")" for c in configs)
    turnover = "(buy + sell)"
    cost = f"CASE WHEN costs_on THEN n.nav * (buy * 0.00115 + sell * 0.001 + {turnover} * (0.0000297 + 0.000001 + brokerage) * 1.18 + {turnover} * CASE WHEN tied * n.nav > 0.01 THEN 5 * least(1 + tied * n.nav / 0.01, 10) ELSE 5 END / 10000)::DOUBLE + (n_buy + n_sell) * flat * 1.18 ELSE 0 END"
    n = name
    return {
        f"{n}_configs": f"SELECT * FROM (VALUES {rows}) AS t(run_id, factor, top_n, fewest, capital, costs_on, brokerage, flat)",
        f"{n}_dates": f"SELECT c.*, p.as_of, p.until, coalesce(members, 0) AS members, coalesce(n_scored, 0) AS n_scored, coalesce(members, 0) < fewest OR coalesce(n_scored, 0) < fewest AS skipped FROM {n}_configs c CROSS JOIN (SELECT * FROM periods) p LEFT JOIN (SELECT as_of, count(*) AS members FROM grid GROUP BY 1) m ON m.as_of = p.as_of LEFT JOIN (SELECT as_of, factor, count(z) AS n_scored FROM {z} GROUP BY ALL) s ON s.as_of = p.as_of AND s.factor = c.factor",
        f"{n}_held": f"SELECT run_id, d.as_of, until, isin, 1.0::DOUBLE / least(top_n, n_scored) AS weight FROM {n}_dates d JOIN (SELECT *, row_number() OVER (PARTITION BY factor, as_of ORDER BY z DESC, isin) AS r FROM {z} WHERE z IS NOT NULL) b ON b.factor = d.factor AND b.as_of = d.as_of WHERE NOT skipped AND r <= top_n",
        f"{n}_order": f"SELECT run_id, as_of, lead(as_of) OVER (PARTITION BY run_id ORDER BY as_of) AS next FROM {n}_dates WHERE NOT skipped",
        f"{n}_deltas": f"SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.as_of, o.as_of) AS as_of, coalesce(n.weight, 0) - coalesce(o.weight, 0) AS d FROM {n}_held n FULL JOIN (SELECT run_id, next AS as_of, isin, weight FROM {n}_held JOIN {n}_order USING (run_id, as_of) WHERE next IS NOT NULL) o ON n.run_id = o.run_id AND n.as_of = o.as_of AND n.isin = o.isin",
        f"{n}_traded": f"SELECT run_id, as_of, coalesce(sum(d) FILTER (d > 0), 0) AS buy, coalesce(-sum(d) FILTER (d < 0), 0) AS sell, count(*) FILTER (d > 0) AS n_buy, count(*) FILTER (d < 0) AS n_sell FROM {n}_deltas GROUP BY ALL",
        f"{n}_steps": f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY as_of) AS k FROM (SELECT h.run_id, h.as_of, h.until, sum(weight * coalesce(fwd, 0)) AS ret, coalesce(avg(weight / median_traded), 0) AS tied FROM {n}_held h LEFT JOIN {returns} r ON r.isin = h.isin AND r.as_of = h.as_of AND r.until = h.until LEFT JOIN medians_traded t ON t.as_of = h.as_of AND t.isin = h.isin GROUP BY ALL) JOIN {n}_traded USING (run_id, as_of) JOIN {n}_configs USING (run_id)",
        f"{n}_navs": f"SELECT run_id, 0::BIGINT AS k, NULL::DATE AS as_of, NULL::DATE AS date, capital AS nav, capital AS gross_nav, 0::DOUBLE AS costs, NULL::DOUBLE AS turnover FROM {n}_configs UNION ALL SELECT n.run_id, s.k, s.as_of, until, (n.nav - {cost}) * (1 + ret), n.gross_nav * (1 + ret), {cost}, CASE WHEN costs_on THEN {turnover}::DOUBLE END FROM {n}_navs n JOIN {n}_steps s ON s.run_id = n.run_id AND s.k = n.k + 1",
    }


#: the momentum backtest's configuration
MOMENTUM = ("momentum", "momentum_12_1", 20, 10, 1_000_000.0, True, 0.0, 0.0)
PARTS |= {"momz": "SELECT as_of, isin, 'momentum_12_1' AS factor, z FROM mz"} | run_parts("mom", [MOMENTUM], "momz")
PARTS |= {"navs": "SELECT * FROM mom_navs", "steps": "SELECT * FROM mom_steps"}


def attribution_parts(name: str, source: str) -> dict[str, str]:
    return {
        f"{name}_1": f"SELECT * FROM (SELECT s.as_of, s.isin, factor, z, fwd, count(*) OVER (PARTITION BY s.as_of, factor) AS n FROM {source} s JOIN returns r ON r.as_of = s.as_of AND r.isin = s.isin WHERE z IS NOT NULL) WHERE n >= 10",
        f"{name}_2": f"SELECT *, least(10, n // 3) AS buckets, rank() OVER (PARTITION BY as_of, factor ORDER BY z) + (count(*) OVER (PARTITION BY as_of, factor, z) - 1) / 2 AS rz, rank() OVER (PARTITION BY as_of, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY as_of, factor, fwd) - 1) / 2 AS rr, row_number() OVER (PARTITION BY as_of, factor ORDER BY z, isin) AS r FROM {name}_1",
        f"{name}_3": f"SELECT *, greatest(0, ceil((r - 1) * buckets / (n - 1)) - 1) AS bucket FROM {name}_2",
        name: f"SELECT as_of, factor, count(*) AS n, corr(rz, rr) AS ic, avg(fwd) FILTER (bucket = buckets - 1) - avg(fwd) FILTER (bucket = 0) AS spread FROM {name}_3 GROUP BY ALL",
    }


PARTS |= attribution_parts("ic", "mz") | attribution_parts("ics", "mzz")


def _needed(body: str) -> list[str]:
    """The parts that a body names, and those that they name, in order."""
    import re

    found: set[str] = set()
    work = [body]
    while work:
        for name in set(re.findall(r"(?:FROM|JOIN)\s+\(?(\w+)", work.pop())):
            if name in PARTS and name not in found:
                found.add(name)
                work.append(PARTS[name])
    return [p for p in PARTS if p in found]


def sql(columns: str, body: str) -> str:
    """columns: "name:kind ..."; kind d is a date, f a double, anything else is left."""
    shown = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        shown.append({"d": f"{name}::DATE::VARCHAR AS {name}", "f": f"CASE WHEN round({name}::DOUBLE, 9) = 0 THEN 0.0::DOUBLE ELSE round({name}::DOUBLE, 9)::FLOAT::DOUBLE END AS {name}"}.get(kind, f"{name}::{kind} AS {name}" if kind else name))
    parts = ", ".join(f"{p} AS ({PARTS[p]})" for p in _needed(body))
    return f"WITH RECURSIVE {parts + ', ' if parts else ''}answer AS ({body}) SELECT {', '.join(shown)} FROM answer"


_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LONG = "as_of:d isin factor raw:f"
SQL = {
    "s1_instruments": sql("isin symbol name sector industry", "SELECT * FROM instruments"),
    "s4_prices_daily": sql("isin date:d adj_close:f volume traded_value:f", "SELECT * FROM prices"),
    "b1_month_ends": sql("as_of:d", "SELECT last_day(d)::DATE AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', a), b::TIMESTAMP, INTERVAL 1 MONTH)) AS d, b FROM (SELECT min(date) AS a, max(date) AS b FROM prices)) WHERE last_day(d)::DATE <= b"),
    "p1_universe": sql("isin as_of:d sector industry", "SELECT * FROM grid"),
    "p2_prices_lookback": sql("as_of:d isin n mean_price:f", "SELECT g.as_of, g.isin, count(*) AS n, avg(adj_close) AS mean_price FROM grid g JOIN prices p ON p.isin = g.isin AND p.date BETWEEN g.as_of - 30 AND g.as_of GROUP BY ALL"),
    "p3_fundamentals_latest": sql("as_of:d isin period_end_date:d revenue:f pat:f ocf:f", "SELECT * FROM (SELECT a.*, g.as_of, row_number() OVER (PARTITION BY as_of, g.isin ORDER BY period_end_date DESC, filing_date DESC) AS k FROM grid g JOIN annual a ON a.isin = g.isin AND filing_date <= as_of AND basis = 'CONSOLIDATED') WHERE k = 1"),
    "p4_fundamentals_history": sql("as_of:d isin rn basis period_end_date:d revenue:f pat:f", "SELECT * FROM history WHERE rn <= 3"),
    "p5_quarterly_newest_8": sql("as_of:d isin rn period_end_date:d revenue:f pat:f", "SELECT * FROM recent"),
    "p6_sentiment_window": sql("as_of:d isin news_id label score:f", "SELECT DATE '2024-01-31' AS as_of, n.* FROM news n JOIN instruments USING (isin) WHERE confidence >= 0.7 AND published_at >= DATE '2024-01-01' AND published_at::DATE <= DATE '2024-01-31'"),
    "p7_shareholding_history": sql("as_of:d isin rn quarter_end:d promoter_pct:f promoter_pledged_pct:f", "SELECT * FROM held"),
    "p8_forward_returns": sql("isin as_of:d until:d fwd:f", "SELECT * FROM returns"),
    "p9_survivorship": sql("start:d finish:d safe", "SELECT as_of AS start, until AS finish, as_of >= (SELECT min(from_date) FROM membership) AND until <= DATE '2000-12-31' AS safe FROM periods"),
    "p11_price_as_of": sql("as_of:d isin price:f", "SELECT g.as_of, g.isin, CASE WHEN g.as_of - p.date <= 15 THEN adj_close END AS price FROM grid g ASOF LEFT JOIN prices p ON g.isin = p.isin AND g.as_of >= p.date"),
    "p12_fiscal_years": sql("isin fiscal_year:INT quarters revenue:f", "SELECT isin, year(period_end_date - INTERVAL 3 MONTH) + 1 AS fiscal_year, count(*) AS quarters, sum(revenue) AS revenue FROM quarterly GROUP BY ALL"),
    "a3_month_buckets": sql("month:d event_type n users mean_value:f", "SELECT date_trunc('month', ts) AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users, avg(value) AS mean_value FROM events GROUP BY ALL"),
    "a4_sentiment_counts": sql("isin positive negative neutral", "SELECT isin, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral FROM news GROUP BY isin"),
    "a8_median_traded_value": sql("as_of:d isin median_traded:f", "SELECT * FROM medians_traded"),
    "a9_winsorize": sql("as_of:d isin raw:f clipped:f", "SELECT as_of, isin, raw, uclip AS clipped FROM wz_4"),
    "a10_sector_zscore": sql("as_of:d isin sector raw:f z:f", "SELECT * FROM mz"),
    "a15_news_sentiment": sql("as_of:d isin raw:f", "SELECT DATE '2024-01-31' AS as_of, isin, sum(score * exp(-ln(2) * a / 7)) / sum(exp(-ln(2) * a / 7)) AS raw FROM (SELECT n.*, greatest(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(published_at), 0) / 86400e6 AS a FROM news n JOIN instruments USING (isin) WHERE confidence >= 0.7 AND published_at >= DATE '2024-01-01' AND published_at::DATE <= DATE '2024-01-31') GROUP BY isin HAVING count(*) >= 3"),
    "a21_alias_conflicts": sql("alias companies", "SELECT lower(split_part(p_name, ' ', 1)) AS alias, count(DISTINCT p_brand) AS companies FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"),
    "w4_drawdown": sql("date:d nav:f ret:f peak:f drawdown:f", "SELECT *, nav / peak - 1 AS drawdown FROM dd"),
    "w13_quantile_buckets": sql("as_of:d bucket:INT n low:f high:f", "SELECT as_of, CASE WHEN n > 1 THEN greatest(0, ceil((r - 1) * 5 / (n - 1)) - 1) ELSE 0 END AS bucket, count(*) AS n, min(z) AS low, max(z) AS high FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY z, isin) AS r, count(*) OVER (PARTITION BY as_of) AS n FROM mz WHERE z IS NOT NULL) GROUP BY 1, 2"),
    "w14_average_rank": sql("p_partkey p_brand p_size r:f", "SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS r FROM part"),
    "v_value_factors": sql(_LONG, "SELECT * FROM value"),
    "q_quality_factors": sql(_LONG, "SELECT * FROM quality"),
    "g_growth_factors": sql(_LONG, "SELECT * FROM growth"),
    "m_momentum_factors": sql(_LONG, "SELECT * FROM momentum"),
    "x1_composite": sql("as_of:d isin coverage:f composite_z:f factor_score:f", "SELECT * FROM scored"),
    "x3_signals": sql("as_of:d isin factor_score:f score:f n_flags signal", "SELECT *, CASE WHEN n_flags = 0 THEN factor_score END AS score, CASE WHEN factor_score IS NULL THEN NULL WHEN n_flags > 0 THEN 'SELL' WHEN factor_score >= 75 THEN 'BUY' WHEN factor_score >= 45 THEN 'HOLD' ELSE 'SELL' END AS signal FROM scored LEFT JOIN flag_sums USING (as_of, isin)"),
    "x5_red_flags": sql("as_of:d isin flag state", "SELECT * FROM flags"),
    "x12_flag_summary": sql("as_of:d isin n_flags red_flags unknown_flags", "SELECT * FROM flag_sums"),
    "x13_family_percentiles": sql("as_of:d isin family percentile:f", f"SELECT *, 100 * {phi('s')} AS percentile FROM (SELECT *, {standard('family_z', 'as_of, family')} AS s FROM families)"),
    "x14_contributions": sql("as_of:d isin family contribution:f verdict", "SELECT *, CASE WHEN family_z IS NOT NULL THEN fw * family_z / sum(CASE WHEN family_z IS NOT NULL THEN fw END) OVER (PARTITION BY as_of, isin) END AS contribution, CASE WHEN family_z IS NULL THEN 'MISSING' WHEN family_z >= 0.75 THEN 'STRENGTH' WHEN family_z <= -0.75 THEN 'WEAKNESS' ELSE 'NEUTRAL' END AS verdict FROM families"),
    "x16_readiness": sql("isin status", "SELECT isin, CASE WHEN DATE '2001-10-31' - max(date) > 15 OR count(*) < 180 THEN 'PARTIAL' ELSE 'PRESENT' END AS status FROM prices WHERE date <= DATE '2001-10-31' GROUP BY isin"),
    "t2_top_n": sql("as_of:d isin weight:f", "SELECT * FROM top"),
    "b2_backtest": sql("date:d nav:f gross_nav:f costs:f", "SELECT * FROM navs WHERE k > 0"),
    "b3_trades": sql("as_of:d buy:f sell:f n_buy n_sell", "SELECT * FROM traded"),
    "b6_metrics": sql("periods years:f total_return:f cagr:f volatility:f sharpe:f sortino:f max_drawdown:f calmar:f hit_rate:f best_period:f worst_period:f avg_turnover:f total_costs_pct:f", "SELECT *, CASE WHEN volatility > 0 THEN (cagr - 0.065) / volatility ELSE 0 END AS sharpe, CASE WHEN down > 0 THEN (cagr - 0.065) / down ELSE 0 END AS sortino, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar FROM (SELECT count(ret) AS periods, round(count(ret) / 12, 2) AS years, last(nav ORDER BY date) / first(nav ORDER BY date) - 1 AS total_return, (last(nav ORDER BY date) / first(nav ORDER BY date)) ** (12.0 / count(ret)) - 1 AS cagr, stddev_samp(ret) * sqrt(12) AS volatility, stddev_samp(ret) FILTER (ret < 0) * sqrt(12) AS down, min(nav / peak - 1) AS max_drawdown, avg((ret > 0)::INT) AS hit_rate, max(ret) AS best_period, min(ret) AS worst_period, (SELECT avg(buy + sell) FROM steps) AS avg_turnover, sum(costs) / 1000000 AS total_costs_pct FROM (SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret, max(nav) OVER (ORDER BY date) AS peak FROM navs WHERE k > 0))"),
    "b7_equal_weight": sql("date:d nav:f", "SELECT * FROM ew"),
    "b9_attribution": sql("as_of:d factor n ic:f spread:f", "SELECT * FROM ic"),
    "b9_attribution_summary": sql("factor periods ic_mean:f ic_t:f hit_rate:f spread_year:f coverage:f monotonic", "SELECT *, (SELECT avg(c) FROM (SELECT as_of, count(z) / count(*) AS c FROM mzz WHERE mzz.factor = s.factor AND as_of IN (SELECT as_of FROM returns GROUP BY as_of HAVING count(fwd) >= 10) GROUP BY as_of)) AS coverage, (SELECT bool_and(up) FROM (SELECT coalesce(r >= lag(r) OVER (ORDER BY bucket), true) AS up FROM (SELECT bucket, avg(r) AS r FROM (SELECT as_of, bucket, avg(fwd) AS r FROM ics_3 WHERE ics_3.factor = s.factor GROUP BY ALL) GROUP BY bucket))) AS monotonic FROM (SELECT factor, count(ic) AS periods, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS ic_t, avg((ic > 0)::INT) AS hit_rate, 12 * avg(spread) AS spread_year FROM ics GROUP BY factor) s"),
    "c3_story_dedup": sql("doc_id content_hash is_first", f"SELECT doc_id, h AS content_hash, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) = 1 AS is_first FROM (SELECT *, substr(sha1({_NORMAL.format('text')}), 1, 16) AS h FROM documents)"),
    "r3_mentions": sql("doc_id start:INT n:INT alias isin", f"SELECT doc_id, i AS start, 3 AS n, alias, isin FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM (SELECT doc_id, string_split({_NORMAL.format('text')}, ' ') AS w FROM documents)) JOIN (SELECT alias, min(item_id) AS isin FROM (SELECT item_id, array_to_string(string_split({_NORMAL.format('text')}, ' ')[:3], ' ') AS alias FROM benchmark) GROUP BY alias HAVING count(DISTINCT item_id) = 1) ON alias = w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]"),
    "r5_roundups": sql("l_orderkey isin confidence:f method", "SELECT l_orderkey, isin, CASE WHEN c > 3 THEN 0.5 ELSE 0.95 END AS confidence, CASE WHEN c > 3 THEN 'ROUNDUP' ELSE 'HEADLINE' END AS method FROM (SELECT l_orderkey, l_suppkey AS isin, count(*) OVER (PARTITION BY l_orderkey) AS c FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))"),
    "e1_validation": sql("isin period_end_date:d basis failed confidence:f", "SELECT *, CASE WHEN failed LIKE '%pbt_tax_pat%' THEN 0.0 WHEN failed LIKE '%,%' THEN 0.3 WHEN failed <> '' THEN 0.6 ELSE 1.0 END AS confidence FROM (SELECT isin, period_end_date, basis, concat_ws(',', CASE WHEN abs(pbt - tax - pat) > 0.02 * greatest(abs(pbt - tax), abs(pat)) THEN 'pbt_tax_pat' END, CASE WHEN isin % 4 = 0 THEN 'revenue_vs_total_income' END, CASE WHEN abs(ocf - capex - fcf) > 0.01 * greatest(abs(ocf - capex), abs(fcf)) THEN 'fcf_identity' END) AS failed FROM (SELECT isin, period_end_date, basis, pat, ocf, capex, fcf, profit_before_tax AS pbt, profit_before_tax - pat + CASE WHEN isin % 11 = 0 THEN 10000.0 ELSE 0.0 END AS tax FROM annual))"),
    "e2_quarters_against_year": sql("isin period_end_date:d yearly:f quarters:f passed", "SELECT a.isin, a.period_end_date, a.revenue AS yearly, q.quarters, CASE WHEN n = 4 THEN abs(a.revenue - quarters) / greatest(abs(a.revenue), abs(quarters)) <= 0.1 END AS passed FROM annual a LEFT JOIN (SELECT isin, year(period_end_date) AS y, count(*) AS n, sum(revenue) AS quarters FROM quarterly GROUP BY ALL) q ON q.isin = a.isin AND y = year(a.period_end_date) WHERE basis = 'CONSOLIDATED'"),
    "k1_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN year(o_orderdate) = 1998 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "k3_fill_from_index": sql("k known:d", "SELECT o_orderkey AS k, min(l_shipdate) FILTER (l_returnflag = 'R') AS known FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "k7_unpivot": sql("isin period_end_date:d item amount:f", "UNPIVOT (SELECT isin, period_end_date, revenue, pat, ocf, capex FROM annual WHERE basis = 'CONSOLIDATED') ON revenue, pat, ocf, capex INTO NAME item VALUE amount"),
    "x18_statement_pivot": sql("isin fy1998:f fy1999:f fy2000:f", "SELECT isin, max(revenue) FILTER (year(period_end_date) = 1998) AS fy1998, max(revenue) FILTER (year(period_end_date) = 1999) AS fy1999, max(revenue) FILTER (year(period_end_date) = 2000) AS fy2000 FROM annual WHERE basis = 'CONSOLIDATED' GROUP BY isin"),
    "j3_pending": "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' OR year(l_shipdate) >= 1998))",
    "c15_page_ranges": "WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N'), s AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM p) GROUP BY l_orderkey, g) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM s GROUP BY 1",
    "t1_signals_on": sql("symbol name sector score:f signal", "SELECT symbol, name, sector, factor_score AS score, CASE WHEN factor_score IS NULL THEN NULL WHEN factor_score >= 75 THEN 'BUY' WHEN factor_score >= 45 THEN 'HOLD' ELSE 'SELL' END AS signal FROM scored JOIN flag_sums USING (as_of, isin) JOIN instruments USING (isin) WHERE as_of = DATE '2000-12-31' AND n_flags = 0 ORDER BY factor_score DESC NULLS LAST, symbol LIMIT 10"),
    "w17_signal_history": sql("as_of:d isin z:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY as_of DESC) AS k FROM mz) WHERE k <= 6"),
    "a2_signal_counts": sql("as_of:d signal n", "SELECT as_of, CASE WHEN n_flags > 0 THEN 'SELL' WHEN factor_score >= 75 THEN 'BUY' WHEN factor_score >= 45 THEN 'HOLD' ELSE 'SELL' END AS signal, count(*) AS n FROM scored LEFT JOIN flag_sums USING (as_of, isin) WHERE factor_score IS NOT NULL GROUP BY 1, 2"),
    "a19_dominant_family": sql("as_of:d isin dominant", "SELECT as_of, isin, last(family ORDER BY abs(c), family) AS dominant FROM (SELECT as_of, isin, family, fw * family_z / sum(CASE WHEN family_z IS NOT NULL THEN fw END) OVER (PARTITION BY as_of, isin) AS c FROM families) WHERE c IS NOT NULL GROUP BY ALL"),
    "s18_pending_windows": sql("isin window_start:d window_end:d", "SELECT isin, d::DATE AS window_start, last_day(d)::DATE AS window_end FROM instruments, (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS d) WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.isin = instruments.isin AND date_trunc('month', p.date) = d)"),
    "x17_missing_reasons": sql("as_of:d isin reason", "SELECT as_of, isin, CASE WHEN f IS NULL THEN 'NO_PRICES' WHEN f > as_of THEN 'NOT_YET' WHEN l < as_of THEN 'ENDED' ELSE 'GAP' END AS reason FROM (SELECT g.as_of, g.isin, CASE WHEN g.as_of - p.date <= 3 THEN adj_close END AS raw FROM grid g ASOF LEFT JOIN prices p ON g.isin = p.isin AND g.as_of >= p.date) LEFT JOIN (SELECT isin, min(date) AS f, max(date) AS l FROM prices GROUP BY isin) USING (isin) WHERE raw IS NULL"),
    "e5_duplicate_periods": sql("l_orderkey l_linestatus l_extendedprice:f", "WITH r AS (SELECT DISTINCT l_orderkey, l_linestatus, l_extendedprice FROM lineitem), a AS (SELECT * FROM r UNION ALL SELECT l_orderkey, 'Z', l_extendedprice FROM r WHERE l_orderkey % 3 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linestatus) AS n FROM a WHERE l_extendedprice > 0), s AS (SELECT l_orderkey, v[len(v) // 2 + 1] AS scale FROM (SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM n WHERE n = 1 GROUP BY 1)) SELECT l_orderkey, l_linestatus, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY abs(log10(l_extendedprice / coalesce(scale, l_extendedprice))), l_extendedprice) AS k FROM n LEFT JOIN s USING (l_orderkey) WHERE n = 1 OR scale IS NOT NULL) WHERE k = 1"),
    "e7_page_selection": "WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS page, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey ORDER BY page RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, page) AS k FROM m WHERE score >= 30 OR near >= 45) SELECT l_orderkey, page, score FROM k WHERE k <= 3",
    "e10_disagreements": sql("isin flag y:INT low:f high:f", "SELECT isin, flag, year(date) AS y, min(ext::DOUBLE / qty::DOUBLE) AS low, max(ext::DOUBLE / qty::DOUBLE) AS high FROM ln GROUP BY ALL HAVING count(*) > 1 AND max(ext::DOUBLE / qty::DOUBLE) - min(ext::DOUBLE / qty::DOUBLE) > 0.01 * max(ext::DOUBLE / qty::DOUBLE)"),
    "r1_alias_candidates": sql("alias isin source confidence:f", f"SELECT alias, isin, arg_max(source, (c * 100)::INT || source) AS source, max(c) AS confidence FROM (SELECT p_partkey AS isin, unnest([n || CASE WHEN long THEN ' works of' ELSE '' END, 'p' || p_partkey, CASE WHEN long AND NOT (w[1] IN ('red', 'anvil') AND w[2] IN ('red', 'anvil')) THEN n END, w[1], CASE WHEN p_partkey % 10 = 0 THEN {_NORMAL.format("'Known-as ' || p_brand")} END]) AS alias, unnest(['NAME', 'SYMBOL', 'NAME_PREFIX', 'NAME_SHORT', 'CURATED']) AS source, unnest([0.95, 0.90, 0.90, 0.60, 0.95]::DOUBLE[]) AS c FROM (SELECT *, p_partkey % 3 = 0 AS long, {_NORMAL.format('p_name')} AS n, string_split({_NORMAL.format('p_name')}, ' ') AS w FROM part)) WHERE length(alias) >= 3 AND alias NOT IN ('blue', 'red', 'anvil') GROUP BY alias, isin"),
    "r6_store_new": f"WITH d AS (SELECT doc_id, source, substr(sha1({_NORMAL.format('text')}), 1, 16) AS content_hash FROM documents) SELECT doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) AS k FROM d WHERE doc_id >= 100) n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id < 100 AND d.source = n.source AND d.content_hash = n.content_hash)",
}
