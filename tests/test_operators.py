"""Semantics of the research operators on small literal frames."""

import datetime as dt
import functools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalar as C
from factorloom.operators import backtest as B
from factorloom.operators import factors as V
from factorloom.operators import news as N
from factorloom.operators import point_in_time as P
from factorloom.operators import review as W
from factorloom.operators import runs as U
from factorloom.operators import scoring as X
from factorloom.operators import statements as E
from factorloom.operators import stats as A
from factorloom.sources import parsers as R
from factorloom.sources import xbrl as H

D = dt.date


def day(text):
    return D.fromisoformat(text)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    r = one(
        spark,
        a=C.safe_divide(F.lit(1.0), F.lit(0.0)), b=C.safe_divide(F.lit(1.0), F.lit(-2.0)), c=C.safe_divide(F.lit(1.0), F.lit(-2.0), negative=True),
        p=C.normal_cdf(F.lit(1.0)), q=C.normal_cdf(F.lit(-1.96)), n=C.no_nan(F.lit(float("nan"))), s=C.strip_legal_suffix(C.normalise_text(F.lit("The Acme-Motors Co. Ltd."))),
        y=C.fiscal_year(F.lit("2024-03-31").cast("date")), z=C.fiscal_year(F.lit("2024-04-01").cast("date")), d=C.relative_difference(F.lit(0.0), F.lit(0.0)), u=C.to_crore(F.lit(5.0), F.lit("LAKH")),
    )
    assert r.a is None and r.b is None and r.c == -0.5 and r.n is None
    assert abs(r.p - 0.841344746) < 1e-7 and abs(r.q - 0.024997895) < 1e-7
    assert r.s == "acme motors" and (r.y, r.z) == (2024, 2025) and r.d == 0 and abs(r.u - 0.05) < 1e-12


def test_unknown_units_fail(spark):
    with pytest.raises(Exception, match="unknown unit: POUND"):
        one(spark, w=C.to_crore(F.lit(5.0), F.lit("POUND")))


def frame(spark, values, sector="s"):
    return spark.createDataFrame([("t", i, sector if not isinstance(sector, list) else sector[i], v) for i, v in enumerate(values)], "as_of string, isin int, sector string, raw double")


def zs(df):
    return {r.isin: r.z for r in A.sector_zscore(df, "raw", ["as_of"], "sector", "z").collect()}


def test_zscore_of_equal_values_is_zero_and_missing_stays_missing(spark):
    got = zs(frame(spark, [2.0] * 6 + [None]))
    assert [got[i] for i in range(6)] == [0.0] * 6 and got[6] is None


def test_small_sector_uses_the_universe(spark):
    got = zs(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0], ["a"] * 6 + ["b"]))
    assert got[6] is not None and got[6] > 3  # the value itself is not clipped


def test_winsorize(spark):
    rows = {r.isin: r.c for r in A.winsorize(frame(spark, [1.0, 2.0, 3.0, 4.0, 1000.0, None]), "raw", ["as_of"], "c").collect()}
    assert rows[0] == 1.0 and math.isclose(rows[4], 3 + 3 * 1.4826 * 1.0) and rows[5] is None


def test_ranks_and_buckets(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([5.0, 1.0, 1.0, 3.0, 9.0, 7.0])], "g string, i int, v double")
    rows = df.withColumn("r", A.average_rank("v", ["g"])).withColumn("b", A.quantile_bucket("v", ["g"], "i", F.lit(3))).collect()
    assert {r.i: r.r for r in rows} == {0: 4.0, 1: 1.5, 2: 1.5, 3: 3.0, 4: 6.0, 5: 5.0}
    assert [r.b for r in sorted(rows, key=lambda r: (r.v, r.i))] == [0, 0, 1, 1, 2, 2]


def grid(spark, *dates, isins=(1,)):
    return spark.createDataFrame([(day(d), i, "s") for d in dates for i in isins], "as_of date, isin int, sector string")


def test_universe_is_half_open(spark):
    dates = spark.createDataFrame([(day("2020-01-31"),), (day("2020-02-29"),)], "as_of date")
    member = spark.createDataFrame([(1, day("2020-01-31"), day("2020-02-29")), (2, day("2020-02-01"), None), (1, day("2019-01-01"), day("2020-02-10"))], "isin int, from_date date, to_date date")
    inst = spark.createDataFrame([(1, "s", "x"), (2, "s", "x")], "isin int, sector string, industry string")
    assert {(str(r.as_of), r.isin) for r in P.universe(dates, member, inst).collect()} == {("2020-01-31", 1), ("2020-02-29", 2)}


def test_facts_are_invisible_before_they_are_public(spark):
    facts = spark.createDataFrame([(1, day("2020-03-31"), day("2020-07-15"), 1.0), (1, day("2019-03-31"), day("2019-08-01"), 2.0)], "isin int, period_end_date date, filing_date date, x double")
    got = {str(r.as_of): r.x for r in P.latest_known(grid(spark, "2020-07-14", "2020-07-15"), facts, "filing_date", [P.newest("period_end_date")]).collect()}
    assert got == {"2020-07-14": 2.0, "2020-07-15": 1.0}


def test_newest_n_of_many_facts_of_one_company(spark):
    """10,000 facts of one company, restatements and ties among them, against a plain reading of the rule."""
    rng = random.Random(7)
    rows = [(1, day("1990-12-31") + dt.timedelta(365 * rng.randint(0, 40)), day("1991-01-01") + dt.timedelta(rng.randint(0, 15_000)), rng.choice(["CONSOLIDATED", "STANDALONE", "A", None]), k) for k in range(10_000)]
    rows += [(1, None, day("2000-01-01"), "STANDALONE", -1), (1, day("2001-12-31"), None, "CONSOLIDATED", -2), (2, day("2000-12-31"), day("2001-05-05"), "STANDALONE", -3)]
    facts = spark.createDataFrame(rows, "isin int, period_end_date date, filing_date date, basis string, x int")
    dates = [day("1990-01-01"), day("1991-01-20"), day("1995-06-30"), day("2001-05-04"), day("2001-05-05"), day("2035-01-01")]
    g = spark.createDataFrame([(d, i, "s") for d in dates for i in (1, 2, 3)], "as_of date, isin int, sector string")
    later = lambda d: -d.toordinal() if d else 0
    want, of_basis = {}, {}
    for d in dates:
        for i in (1, 2):
            seen = [r for r in rows if r[0] == i and r[2] and r[2] <= d]
            best = sorted(seen, key=lambda r: (later(r[1]), r[1:3], r[3] or "", r[4]))[:8]
            want |= {(d, i, k + 1): r[4] for k, r in enumerate(best)}
            named = [r for r in seen if r[3]]
            chosen = "CONSOLIDATED" if any(r[3] == "CONSOLIDATED" for r in named) else min((r[3] for r in named), default="")
            best = sorted((r for r in named if r[3] == chosen), key=lambda r: (later(r[1]), later(r[2]), r[4]))[:5]
            of_basis |= {(d, i, k + 1): r[4] for k, r in enumerate(best)}
    newest = P.latest_known(g, facts, "filing_date", [P.newest("period_end_date")], 8)
    assert {(r.as_of, r.isin, r.rn): r.x for r in newest.collect()} == want
    assert {(r.as_of, r.isin, r.rn): r.x for r in P.newest_of_basis(g, facts, 5).collect()} == of_basis
    plan = P.latest_known(g, facts, "filing_date", [P.newest("period_end_date")], 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(isin") == 1 and plan.count("Sort [") == 1, plan  # facts and dates meet in one exchange and sort


def prices(spark, rows):
    return spark.createDataFrame([(i, day(d), float(p) if p is not None else None) for i, d, p in rows], "isin int, date date, adj_close double")


def test_future_prices_change_nothing(spark):
    base = [(1, str(day("2020-01-01") + dt.timedelta(k)), 100 + k % 7) for k in range(500)]
    g = grid(spark, "2021-03-31")
    before = {r.factor: r.raw for r in V.momentum(g, prices(spark, base), 100, 100, 50).collect()}
    after = {r.factor: r.raw for r in V.momentum(g, prices(spark, base[:456] + [(1, str(day("2021-04-01") + dt.timedelta(k)), 500) for k in range(90)]), 100, 100, 50).collect()}
    assert before == after and before["momentum_12_1"] is not None


def test_price_as_of_tolerance(spark):
    p = prices(spark, [(1, "2020-01-01", 5), (1, "2020-01-20", -1)])
    got = {str(r.as_of): r.price for r in P.price_as_of(grid(spark, "2019-12-31", "2020-01-16", "2020-01-17").select("as_of", "isin"), p, "as_of", 15, "price").collect()}
    assert got == {"2019-12-31": None, "2020-01-16": 5.0, "2020-01-17": None}


def test_forward_returns(spark):
    spans = spark.createDataFrame([(i, day("2020-01-31"), day("2020-02-29")) for i in (1, 2, 3)], "isin int, as_of date, until date")
    p = prices(spark, [(1, "2020-01-31", 50), (1, "2020-02-03", 100), (1, "2020-02-10", 80), (2, "2020-02-03", 0), (2, "2020-02-04", 9), (3, "2020-03-02", 1)])
    assert [(r.isin, round(r.fwd, 9)) for r in P.forward_returns(spans, p).collect()] == [(1, -0.2)]


def test_survivorship(spark):
    w = spark.createDataFrame([(day("2020-01-01"), day("2020-06-30")), (day("2020-06-01"), day("2021-06-30"))], "start date, end date")
    c = spark.createDataFrame([(day("2019-01-01"), day("2020-12-31")), (day("2021-01-01"), day("2022-01-01"))], "verified_from date, verified_to date")
    assert sorted((str(r.start), r.safe) for r in P.survivorship_safe(w, c).collect()) == [("2020-01-01", True), ("2020-06-01", False)]


def test_quarterly_growth_takes_the_nearest_quarter(spark):
    rows = [(1, "2020-12-31", 120.0), (1, "2019-12-31", 100.0), (1, "2019-11-30", 50.0), (2, "2020-12-31", 5.0), (2, "2019-06-30", 1.0), (3, "2020-12-31", 5.0), (3, "2019-12-31", -1.0)]
    recent = spark.createDataFrame([(day("2021-03-31"), i, day(d), x) for i, d, x in rows], "as_of date, isin int, period_end_date date, revenue double")
    assert [(r.isin, round(r.yoy, 9)) for r in V.quarterly_growth(recent, "revenue").collect()] == [(1, 0.2)]


def test_debt_free_company_has_the_highest_coverage(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, 1.0), (100.0, 40.0), (-5.0, 10.0), (None, 1.0), (-5.0, 0.0), (-5.0, None), (7.0, None)], "profit_before_tax double, interest_expense double")
    columns = V.value_quality_columns()
    wide = df.select("*", *(F.lit(1.0).alias(c) for c in ("eps", "price", "total_equity", "market_cap", "depreciation", "ev", "ocf", "capex", "pat", "total_debt", "total_assets", "ebitda", "fcf")))
    assert [r[0] for r in wide.select(columns["interest_coverage"]).collect()] == [50.0, 50.0, 3.5, 0.5, None, None, None, 50.0]


def test_flags(spark):
    g = grid(spark, "2020-12-31", isins=(1, 2, 3))
    history = spark.createDataFrame(
        [(1, k, "UNMODIFIED", 60.0, 100.0, 10.0, 100.0) for k in (1, 2, 3)] + [(2, 1, "QUALIFIED", 1.0, -5.0, 90.0, 100.0), (2, 2, "UNMODIFIED", 1.0, 5.0, None, 100.0), (2, 3, "UNMODIFIED", 1.0, 5.0, 90.0, 100.0)],
        "isin int, rn int, auditor_opinion string, contingent_liabilities double, total_equity double, ocf double, pat double",
    ).withColumn("as_of", F.lit("2020-12-31").cast("date"))
    held = spark.createDataFrame([(1, k, 50.0 + k, 30.0) for k in range(1, 5)] + [(2, k, 50.0, None) for k in range(1, 5)], "isin int, rn int, promoter_pct double, promoter_pledged_pct double").withColumn("as_of", F.lit("2020-12-31").cast("date"))
    got = {(r.isin, r.flag): r.state for r in X.red_flags(g, history, held).collect()}
    assert [got[1, f] for f in X.FLAGS] == ["TRIPPED", "CLEAR", "TRIPPED", "TRIPPED", "TRIPPED", "UNKNOWN"]
    assert [got[2, f] for f in X.FLAGS] == ["UNKNOWN", "TRIPPED", "UNKNOWN", "CLEAR", "TRIPPED", "UNKNOWN"]
    assert all(got[3, f] == "UNKNOWN" for f in X.FLAGS)


def test_signals(spark):
    scores = spark.createDataFrame([(day("2020-01-31"), i, s) for i, s in ((1, 80.0), (2, 50.0), (3, 10.0), (4, None), (5, 90.0), (6, None))], "as_of date, isin int, factor_score double")
    flags = spark.createDataFrame([(day("2020-01-31"), 5, 1), (day("2020-01-31"), 6, 2)], "as_of date, isin int, n_flags long")
    assert {r.isin: (r.signal, r.score) for r in X.signals(scores, flags).collect()} == {1: ("BUY", 80.0), 2: ("HOLD", 50.0), 3: ("SELL", 10.0), 4: (None, None), 5: ("SELL", None), 6: (None, None)}


def test_contributions_add_up(spark):
    rows = [(day("2020-01-31"), i, f, z, 1.0, z) for i in range(4) for f, z in (("value", i - 1.0), ("quality", 2.0 - i), ("growth", None if i == 0 else 0.5 * i))]
    fam = spark.createDataFrame(rows, "as_of date, isin int, family string, mean_z double, coverage double, family_z double")
    total = {r.isin: r.s for r in X.contributions(fam).groupBy("isin").agg(F.sum("contribution").alias("s")).collect()}
    comp = {r.isin: r.composite_z for r in X.composite(fam).collect()}
    assert all(abs(total[i] - comp[i]) < 1e-12 for i in range(1, 4))


def test_costs_and_nav(spark):
    steps = [("r", day("2020-01-31"), day("2020-02-29"), 0.1, 1.0, 0.0, 3, 0, 0.0, 0.0), ("r", day("2020-02-29"), day("2020-03-31"), -0.05, 0.2, 0.2, 2, 1, 1e-3, 0.0)]
    steps += [("brokered", day("2020-01-31"), day("2020-02-29"), 0.1, 1.0, 0.0, 3, 1, None, 0.002)]
    frame = spark.createDataFrame(steps, "run_id string, as_of date, until date, ret double, buy double, sell double, n_buy int, n_sell int, tied double, brokerage double")
    rated = frame.select("run_id", "as_of", "until", F.lit(1e6).alias("capital"), "ret", (F.col("buy") + F.col("sell")).alias("turnover"), U.fixed_rate(F.col("buy"), F.col("sell"), F.col("brokerage")).alias("rate"), F.when(F.col("run_id") == "brokered", (F.col("n_buy") + F.col("n_sell")) * 20 * 1.18).otherwise(0.0).alias("orders"), "tied")
    got = {(r.run_id, str(r.as_of)): r for r in U.nav_curves(rated).collect()}
    c1 = 1e6 * (0.001 + 0.00015 + (0.0000297 + 0.000001) * 1.18 + 5e-4)
    nav1 = (1e6 - c1) * 1.1
    p = nav1 * 1e-3
    c2 = nav1 * (0.2 * 0.00115 + 0.2 * 0.001 + 0.4 * 0.0000307 * 1.18 + 0.4 * 5e-4 * min(1 + p / 0.01, 10))
    first, second, other = got["r", "2020-01-31"], got["r", "2020-02-29"], got["brokered", "2020-01-31"]
    assert math.isclose(first.nav, nav1) and math.isclose(second.nav, (nav1 - c2) * 0.95) and math.isclose(second.gross_nav, 1e6 * 1.1 * 0.95)
    assert math.isclose(other.costs, c1 + 1e6 * 0.002 * 1.18 + 4 * 20 * 1.18) and second.date == day("2020-03-31")


def test_a_skipped_date_is_carried_over(spark):
    """Of three dates the second has too few scored names: the third trades against the first, and the second earns nothing."""
    dates = spark.createDataFrame([(day(d),) for d in ("2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30")], "as_of date")
    g = grid(spark, "2020-01-31", "2020-02-29", "2020-03-31", isins=(1, 2, 3))
    scores = {"2020-01-31": (3.0, 2.0, 1.0), "2020-02-29": (None, None, 1.0), "2020-03-31": (1.0, 2.0, 3.0)}
    z = spark.createDataFrame([(day(d), i + 1, "f", s) for d, own in scores.items() for i, s in enumerate(own)], "as_of date, isin int, factor string, z double")
    spans = {"2020-01-31": "2020-02-29", "2020-02-29": "2020-03-31", "2020-03-31": "2020-04-30"}
    returns = spark.createDataFrame([(i, day(a), day(b), 0.1 * i) for a, b in spans.items() for i in (1, 2)], "isin int, as_of date, until date, fwd double")
    traded = spark.createDataFrame([(day(a), i, 1e6) for a in spans for i in (1, 2, 3)], "as_of date, isin int, median_traded double")
    configs = spark.createDataFrame([("a", "f", 1, 2, 100.0, False, 0.0, 0.0), ("b", "f", 2, 3, 100.0, False, 0.0, 0.0), ("none", "f", 2, 4, 100.0, True, 0.0, 0.0)], U.CONFIG)
    told = U.backtests(configs, g, z, dates, returns, traded)
    assert {(r.run_id, str(r.as_of)) for r in told["schedule"].where("skipped").collect()} == {("a", "2020-02-29"), ("b", "2020-02-29"), *(("none", d) for d in spans)}
    curve = {(r.run_id, str(r.as_of)): r for r in told["curve"].collect()}
    # the third date holds 3 alone, which has no return; two names: 2 and 3
    assert [round(curve["a", d].nav, 9) for d in ("2020-01-31", "2020-03-31")] == [110, 110]
    assert [round(curve["b", d].nav, 9) for d in ("2020-01-31", "2020-03-31")] == [115, 126.5] and len(curve) == 4
    moved = {(r.run_id, str(r.as_of)): (r.buy, r.sell, r.n_buy, r.n_sell) for r in U.trades(told["positions"], told["schedule"]).collect()}
    assert moved["a", "2020-03-31"] == (1, 1, 1, 1) and moved["b", "2020-03-31"] == (0.5, 0.5, 1, 1)
    doubled = U.backtests(configs, g, z, dates, returns, traded, transform=lambda r: r.withColumn("fwd", F.col("fwd") * 2))["curve"]
    assert {r.run_id: round(r.nav, 9) for r in doubled.where("as_of = '2020-01-31'").collect()} == {"a": 120, "b": 130}


def test_constant_return_metrics(spark):
    curve = spark.createDataFrame([(day(f"2020-{m:02d}-01"), 100 * 1.01**m) for m in range(1, 13)], "date date, nav double")
    r = B.metrics(curve).first()
    assert r.periods == 11 and math.isclose(r.cagr, 1.01**12 - 1) and r.max_drawdown == 0 and r.hit_rate == 1 and r.calmar == 0


def test_longest_mention_wins(spark):
    aliases = spark.createDataFrame([("tata motors", 1, 0.95), ("tata", 2, 0.6), ("jlr", 1, 0.9)], "alias string, isin int, confidence double")
    text = spark.createDataFrame([(1, "Tata Motors and JLR rise; Tata waits"), (2, ""), (3, None)], "id int, text string")
    assert sorted((r.id, r.start, r.alias) for r in N.mentions(text, aliases, "id", "text").collect()) == [(1, 0, "tata motors"), (1, 3, "jlr"), (1, 5, "tata")]


def test_aliases_and_conflicts(spark):
    inst = spark.createDataFrame([(1, "ACM", "Acme Motors Works Ltd"), (2, "ACS", "Acme Steel Limited")], "isin int, symbol string, name string")
    good, bad = N.split_conflicts(N.alias_candidates(inst))
    assert [r.alias for r in bad.collect()] == ["acme"]
    assert {(r.alias, r.isin, r.confidence) for r in good.collect()} >= {("acme motors works", 1, 0.95), ("acme motors", 1, 0.90), ("acs", 2, 0.90), ("acme steel", 2, 0.95)}


def test_stories_and_roundups(spark):
    a = spark.createDataFrame([(1, 7, "Big  news!"), (2, 7, "big news"), (3, 8, "Big news")], "id int, isin int, text string")
    assert {r.id: r.is_first for r in N.first_of_story(N.story_keys(a), ["isin", "content_hash"], ["id"]).collect()} == {1: True, 2: False, 3: True}
    rows = spark.createDataFrame([(1, i, 0.9, "HEADLINE") for i in range(4)] + [(2, 1, 0.9, "HEADLINE")], "id int, isin int, confidence double, method string")
    assert {(r.id, r.confidence, r.method) for r in N.demote_roundups(rows, "id").collect()} == {(1, 0.5, "ROUNDUP"), (2, 0.9, "HEADLINE")}


def test_best_mention_and_changes(spark):
    schema = "id int, isin int, n int, confidence double"
    best = N.best_mentions(spark.createDataFrame([(1, 5, 1, 0.6)], schema), spark.createDataFrame([(1, 5, 2, 0.95), (1, 6, 1, 0.9)], schema), "id")
    assert {(r.isin, r.method, r.confidence) for r in best.collect()} == {(5, "BODY", 0.665), (6, "BODY", 0.63)}
    old = best.withColumn("confidence", F.lit(0.665)).where("isin = 5").unionByName(spark.createDataFrame([(1, 9, 0.9, "BODY")], "id int, isin int, confidence double, method string"))
    assert {(r.isin, r.change) for r in N.resolution_changes(old, best, "id").collect()} == {(6, "ADDED"), (9, "REMOVED")}


def test_validation(spark):
    base = dict(revenue=1000.0, total_income=1050.0, total_expenses=850.0, profit_before_tax=200.0, tax_expense=50.0, pat=150.0, total_assets=5000.0, total_equity=2000.0, total_liabilities=3000.0, capex=80.0, eps=15.0)
    cases = [(base, 1.0), (base | {"total_assets": 6000.0}, 0.0), (base | {"eps": -1.0}, 0.6), (base | {"eps": -1.0, "capex": -1.0}, 0.3), (base | {"total_income": None}, 1.0), (base | {"revenue": None}, 0.0)]
    schema = ", ".join(f"{k} double" for k in base)
    df = spark.createDataFrame([tuple(c[k] for k in base) for c, _ in cases], schema)
    assert [r.confidence for r in E.validate(df).collect()] == [w for _, w in cases]


def test_duplicate_periods(spark):
    rows = [("a", "q1", 100.0), ("a", "q2", 110.0), ("a", "q3", 120.0), ("a", "q3", 12000.0), ("b", "q1", 1.0), ("b", "q1", 100.0)]
    got = E.resolve_duplicate_periods(spark.createDataFrame(rows, "k string, p string, v double"), "k", "p", "v").collect()
    assert sorted(map(tuple, got)) == [("a", "q1", 100.0), ("a", "q2", 110.0), ("a", "q3", 120.0)]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, E.upsert(t, s, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert E.upsert(t, s.limit(0), ["k"]).count() == 2
    with pytest.raises(Exception, match="the source repeats a key"):
        E.upsert(t, s.unionByName(s), ["k"]).collect()


def test_pages(spark):
    p = spark.createDataFrame([("d", n) for n in (12, 13, 14, 140, 13)], "doc string, page int")
    assert E.page_ranges(p, "doc", "page").first().ranges == "12-14,140"
    s = spark.createDataFrame([("d", n, float(x)) for n, x in ((1, 9), (2, 0), (8, 0), (9, 5), (20, 1))], "doc string, page int, score double")
    assert sorted(r.page for r in E.select_pages(s, "doc", "page", "score").collect()) == [1, 2, 9]


def test_quarterly_payload(spark):
    body = '{"resCmpData":[{"re_to_dt":"31-DEC-2024","re_total_inc":"1,234.5","re_net_profit":"100"},{"re_to_dt":"30-SEP-2024","re_broadcast_dt":"14-NOV-2024","re_total_inc":"","re_net_profit":"x"},{"re_to_dt":""}]}'
    rows = R.quarterly_results(spark.createDataFrame([("I", body), ("J", None), ("K", "{}")], "isin string, body string")).orderBy("period_end_date").collect()
    assert [(str(r.period_end_date), str(r.filing_date), r.revenue and round(r.revenue, 6), r.pat) for r in rows] == [("2024-09-30", "2024-11-14", None, None), ("2024-12-31", "2025-02-14", 12.345, 1.0)]


def test_filing_index_and_shareholding(spark):
    body = '[{"toDate":"31-Mar-2024","broadcastDate":"01-Jan-2020","consolidated":"Consolidated","audited":"Un-Audited","xbrl":"-"},{"toDate":"31-Mar-2024","broadcastDate":"20-May-2024","consolidated":"?","xbrl":"https://x/y.xml"}]'
    a, b = sorted(R.filing_index(spark.createDataFrame([("I", body)], "isin string, body string")).collect(), key=lambda r: r.basis)
    assert (a.basis, a.broadcast_date, a.is_audited, a.xbrl_url) == ("CONSOLIDATED", None, False, None) and (b.basis, b.xbrl_url) == ("UNKNOWN", "https://x/y.xml")
    held = '{"data":[{"date":"31-Mar-2024","pr_and_prgrp":"50.1","public_val":"49.9"},{"date":"31-MAR-2024","pr_and_prgrp":"51"}]}'
    r = R.shareholding_rows(spark.createDataFrame([("I", held)], "isin string, body string")).collect()
    assert len(r) == 1 and r[0].promoter_pct == 51.0 and r[0].promoter_pledged_pct is None and str(r[0].disclosed_date) == "2024-04-21"


def test_feeds(spark):
    rss = '<rss><item><title>A &amp; B</title><link>http://a</link><description>&lt;img src="x"/&gt; text</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0530</pubDate></item><item><title>no date</title><link>http://b</link></item></rss>'
    atom = '<feed><entry><title>C</title><link href="http://c"/><updated>2024-01-01T10:00:00Z</updated></entry></feed>'
    rows = {r.link: r for r in R.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("n", None)], "feed string, xml string")).collect()}
    assert set(rows) == {"http://a", "http://c"} and rows["http://a"].title == "A & B" and rows["http://a"].body == "text"
    assert str(rows["http://a"].published_at) == "2024-01-01 10:00:00" and str(rows["http://c"].published_at) == "2024-01-01 15:30:00"


INSTANCE = """<?xml version="1.0"?><!-- a comment --><a:xbrl xmlns:a="http://i" xmlns:x="http://x" xmlns:y="http://y" xmlns:d="http://d" xmlns:xsi="http://s">
<a:context id="Q"><a:period><a:startDate>2024-01-01</a:startDate><a:endDate>2024-03-31</a:endDate></a:period></a:context><a:context id="Y"><a:period><a:startDate>2024-01-01</a:startDate><a:endDate>2024-03-31</a:endDate></a:period></a:context><a:context id="I"><a:period><a:instant>2024-03-31</a:instant></a:period></a:context>
<a:context id="S"><a:entity><a:segment><d:explicitMember dimension="k">m</d:explicitMember></a:segment></a:entity><a:period><a:startDate>2023-04-01</a:startDate><a:endDate>2024-03-31</a:endDate></a:period></a:context><a:context id="T"><a:period><a:startDate>2023-04-01</a:startDate><a:endDate>2024-03-31</a:endDate></a:period><a:scenario><d:typedMember dimension="k"><x:m>1</x:m></d:typedMember></a:scenario></a:context>
<x:DateOfStartOfReportingPeriod contextRef="Y">2023-04-01</x:DateOfStartOfReportingPeriod><x:DateOfEndOfReportingPeriod contextRef="Y">2024-03-31</x:DateOfEndOfReportingPeriod>
<x:RevenueFromOperations contextRef="Q" decimals="0">1,00,00,000</x:RevenueFromOperations><y:RevenueFromOperations contextRef="Y" decimals="-5" unitRef="INR"><![CDATA[40000000]]></y:RevenueFromOperations><x:RevenueFromOperations contextRef="S">7</x:RevenueFromOperations><x:RevenueFromOperations contextRef="T">8</x:RevenueFromOperations>
<x:TAXEXPENSE contextRef="Y" sign="-">5</x:TAXEXPENSE><x:Assets contextRef="I">90000000</x:Assets><x:FinanceCosts contextRef="Y" xsi:nil="true"/><x:ProfitLossForPeriod contextRef="Y">20000000</x:ProfitLossForPeriod><x:BasicEarningsPerShare contextRef="Y">1.5</x:BasicEarningsPerShare><x:BorrowingsCurrent contextRef="I">10000000</x:BorrowingsCurrent><x:Other contextRef="Y">1</x:Other><x:Name contextRef="gone">n</x:Name></a:xbrl>"""


def test_xbrl(spark):
    changed = lambda *pairs: functools.reduce(lambda x, p: re.sub(*p, x, flags=re.S), pairs, INSTANCE)
    cases = {1: INSTANCE, 2: INSTANCE[:-5], 3: None, 4: "no XML", 5: changed(("2023-04-01</x", "2023-10-01</x")), 6: changed(('<a:context id="I">.*?</a:context>', "")), 7: changed(("<a:context .*</a:context>", "")), 8: changed(("ProfitLossForPeriod", "Unknown")), 9: changed(('<a:context id="[QY]">.*?</a:context>', ""))}
    documents = spark.createDataFrame(list(cases.items()), "doc_id int, xml string")
    facts = H.facts(documents.where("doc_id = 1"))
    assert {(r.context, r.value, r.unit, r.decimals, r.dimensional, str(r.start)) for r in facts.where("element = 'RevenueFromOperations'").collect()} == {("Q", 1e7, None, "0", False, "2024-01-01"), ("Y", 4e7, "INR", "-5", False, "2023-04-01"), ("S", 7.0, None, None, True, "2023-04-01"), ("T", 8.0, None, None, True, "2023-04-01")}
    told = H.annual_statements(documents)
    (r,) = told.where("reason IS NULL").collect()
    refused = told.where("reason IS NOT NULL")
    assert (r.doc_id, str(r.period_start), str(r.period_end), r.revenue, r.pat, r.tax_expense, r.interest_expense, r.eps_basic, r.total_assets, r.total_debt) == (1, "2023-04-01", "2024-03-31", 4.0, 2.0, -5e-7, None, 1.5, 9.0, 1.0)
    assert {r.doc_id: r.reason for r in refused.collect()} == {2: "not well-formed XML", 3: "not well-formed XML", 4: "not well-formed XML", 5: "longest period ending 2024-03-31 spans 182 days, short of 300", 6: "no instant context", 7: "no XBRL contexts", 8: "missing pat", 9: "no duration context"}
    assert {r.field: r.value for r in H.quarter_values(facts).collect()} == {"revenue": 1e7, "total_assets": 9e7, "borrowings_current": 1e7}
    assert {r.element for r in H.unmapped(facts).collect()} == {"Other"}


def test_filings_of_an_unknown_basis(spark):
    """One counts as standalone; it neither takes a company's other filings with it nor gets lost."""
    rows = [(1, 2001, None, "a"), (2, 2001, False, "b"), (2, 2002, None, "c"), (3, 2001, True, "d"), (3, 2002, None, "e")]
    refs = spark.createDataFrame([(i, y, c, day(f"{y}-03-31"), None, n) for i, y, c, n in rows], "isin int, fiscal_year int, is_consolidated boolean, period_end date, broadcast_date date, n string")
    none = refs.select("isin", "fiscal_year", F.lit("").alias("basis")).limit(0)
    pending = H.pending_annual(refs, none, none)
    assert {(r.n, r.basis, str(r.broadcast_date)) for r in pending.collect()} == {("a", "STANDALONE", "2001-05-30"), ("b", "STANDALONE", "2001-05-30"), ("c", "STANDALONE", "2002-05-30"), ("d", "CONSOLIDATED", "2001-05-30")}
    assert {r.n for r in W.annual_filings(refs).collect()} == {"a", "b", "c", "d"}
    stored, refused = pending.where("n = 'a'"), pending.where("n = 'c'")
    assert {r.n for r in H.pending_annual(refs, stored, refused).collect()} == {"b", "d"}


def test_normalise_prices(spark):
    raw = spark.createDataFrame([("I", "2020-01-01", 5.0), ("I", "2020-01-02", None)], "isin string, Date string, Close double")
    assert [tuple(r) for r in R.normalise_prices(raw).select("isin", "close", "adj_close", "open").collect()] == [("I", 5.0, 5.0, None)]


def test_stream(spark, tmp_path):
    from factorloom.streaming.news_stream import distinct_stories, into_store, sentiment_windows

    rows = [(1, 7, "Big news", 0.5, "2024-01-01 10:00:00"), (2, 7, "big  news!", 0.5, "2024-01-01 11:00:00"), (3, 8, "Big news", -0.5, "2024-01-02 10:00:00")]
    batch = spark.createDataFrame(rows, "id int, isin int, text string, score double, t string").withColumn("published_at", F.col("t").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    into_store(distinct_stories(stream), str(tmp_path / "store"), str(tmp_path / "c1"), ["isin", "content_hash"]).awaitTermination()
    assert sorted(r.isin for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [7, 8]
    q = sentiment_windows(stream, length="1 day", slide="1 day").writeStream.format("memory").queryName("s").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.isin, r.n) for r in spark.table("s").collect()} == {(7, 2), (8, 1)}


def test_stream_of_days(spark, tmp_path):
    from factorloom.streaming.news_stream import decayed_sentiment, into_store, month_counts

    rows = [(7, 1.0, "2024-01-01 00:00:00"), (7, -1.0, "2024-01-08 00:00:00"), (8, 0.5, "2024-02-02 10:00:00")]
    batch = spark.createDataFrame(rows, "isin int, score double, t string").withColumn("published_at", F.col("t").cast("timestamp")).withColumn("day", F.to_date("published_at"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def table(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert {(str(r.month), r.isin, r.n) for r in table(month_counts(stream), "months").collect()} == {("2024-01-01", 7, 2), ("2024-02-01", 8, 1)}
    got = table(decayed_sentiment(stream, length="14 days", slide="14 days"), "decayed").where("isin = 7").agg(F.sum("n"), F.min("score")).first()
    assert got[0] == 2 and -1 <= got[1] < 0  # the later article weighs more
    for k in range(2):  # the second run finds all of it stored
        into_store(stream.select("isin", "day"), str(tmp_path / "store"), str(tmp_path / f"c{k}"), ["isin", "day"], day="day").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_serving(spark):
    from factorloom.operators import serving as S

    inst = spark.createDataFrame([(1, "ABC", "Alpha", "x"), (2, "bcd", "Beta abc", None), (3, "C", "Gamma", "")], "isin int, symbol string, name string, sector string")
    assert [r.isin for r in S.by_symbol(inst, "abc").collect()] == [1] and {r.isin for r in S.search(inst, "ABC").collect()} == {1, 2}
    assert [r.sector for r in S.sectors(inst).collect()] == ["x"]
    rows = spark.createDataFrame([(day("2020-01-31"), 1, 10.0, 0, "SELL"), (day("2020-01-31"), 2, None, 0, None), (day("2020-01-31"), 3, 90.0, 0, "BUY")], "as_of date, isin int, score double, n_flags int, signal string")
    assert [r.isin for r in S.signals_on(rows, inst, F.lit("2020-01-31").cast("date")).collect()] == [3, 1, 2]
    assert [r.isin for r in S.signals_on(rows, inst, F.lit("2020-01-31").cast("date"), signal="BUY", limit=1).collect()] == [3]


def test_month_windows(spark):
    from factorloom.operators import serving as S

    done = spark.createDataFrame([(1, day("2017-02-01"))], "isin int, window_start date")
    got = S.month_windows(spark.createDataFrame([(1,)], "isin int"), F.lit("2016-05-01").cast("date"), F.lit("2017-03-10").cast("date"), done).orderBy("window_start").collect()
    assert [(str(r.window_start), str(r.window_end)) for r in got] == [("2017-01-01", "2017-01-31"), ("2017-03-01", "2017-03-10")]


def test_token_costs(spark):
    from factorloom.operators import serving as S

    usage = spark.createDataFrame([("m", day("2024-06-01"), 1_000_000, 0, 0, 0, True), ("m", day("2025-06-01"), 0, 1_000_000, 1_000_000, 1_000_000, False)], "model string, day date, input long, output long, cache_write long, cache_read long, batch boolean")
    rates = spark.createDataFrame([("m", day("2024-01-01"), 4.0, 8.0), ("m", day("2025-01-01"), 2.0, 6.0)], "model string, since date, input_rate double, output_rate double")
    assert sorted(round(r.cost, 6) for r in S.token_costs(usage, rates).collect()) == [2.0, 8.7]


def test_jobs():
    from factorloom.plans.jobs import Skip, Step, execute, select

    def skip(_):
        raise Skip("nothing")

    def fail(_):
        raise RuntimeError("no")

    steps = [Step("a", lambda c: "ok"), Step("b", skip), Step("c", fail), Step("d", lambda c: "ok", default=False)]
    report = execute(select(steps, "company", only=["d", "a", "b", "c"]), {})
    assert [(n, s) for n, s, _ in report.events] == [("a", "DONE"), ("b", "SKIPPED"), ("c", "FAILED"), ("d", "NOT_RUN")] and not report.ok
    assert [s.name for s in select(steps, "universe", skip=["b"])] == ["a", "c"]
    with pytest.raises(ValueError):
        select(steps, "company", only=["x"])
