"""What is there, what is missing and why, and what explains a score: for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.factors import FACTORS
from factorloom.operators.scoring import FAMILY_WEIGHTS

#: days after which prices and periods are stale, and the least rows of each dataset
PRICE_STALE_DAYS, STALE_PERIOD_DAYS = 45, 270
MIN_PRICES, MIN_QUARTERS, MIN_HOLDINGS, MIN_YEARS, MIN_ARTICLES = 180, 5, 4, 3, 3
#: fixed values: what each factor needs: datasets, annual columns of the newest year, and least years, quarters and articles
NEEDS = {
    "earnings_yield": ("annual,prices", "eps", 0, 0, 0),
    "book_to_price": ("annual,prices", "total_equity,pat,eps", 0, 0, 0),
    "ebitda_to_ev": ("annual,prices", "profit_before_tax,depreciation,pat,eps", 0, 0, 0),
    "fcf_yield": ("annual,prices", "ocf,capex,pat,eps", 0, 0, 0),
    "peg_inverse": ("annual,prices", "eps,pat", 2, 0, 0),
    "roe": ("annual", "pat,total_equity", 0, 0, 0),
    "roce": ("annual", "profit_before_tax,total_equity", 0, 0, 0),
    "debt_to_equity": ("annual", "total_debt,total_equity", 0, 0, 0),
    "interest_coverage": ("annual", "profit_before_tax,interest_expense", 0, 0, 0),
    "cfo_to_pat": ("annual", "ocf,pat", 0, 0, 0),
    "accruals": ("annual", "pat,ocf,total_assets", 0, 0, 0),
    "revenue_cagr_3y": ("annual", "revenue", 2, 0, 0),
    "pat_cagr_3y": ("annual", "pat", 2, 0, 0),
    "margin_trend": ("annual", "pat,revenue", 2, 0, 0),
    "quarterly_revenue_yoy": ("quarterly", "", 0, 5, 0),
    "quarterly_pat_yoy": ("quarterly", "", 0, 5, 0),
    "momentum_12_1": ("prices", "", 0, 0, 0),
    "price_to_200dma": ("prices", "", 0, 0, 0),
    "relative_strength_6m": ("prices", "", 0, 0, 0),
    "news_sentiment_30d": ("news", "", 0, 0, 3),
}


def status(n: Column, least: int, last: Column | None = None, as_of: Column | None = None, stale: int | None = None) -> Column:
    """ABSENT without rows, PARTIAL with too few or stale ones, else PRESENT."""
    n = F.coalesce(n, F.lit(0))
    old = (F.datediff(as_of, last) > stale) if last is not None else F.lit(False)
    return F.when(n == 0, "ABSENT").when((n < least) | F.coalesce(old, F.lit(False)), "PARTIAL").otherwise("PRESENT")


def dataset_status(grid: DataFrame, prices: DataFrame, annual: DataFrame, quarterly: DataFrame, holding: DataFrame, news: DataFrame) -> DataFrame:
    """as_of, isin, dataset, n, last, status of five datasets as they are known on each date.

    grid: as_of, isin; prices, annual, quarterly, holding: as_of, isin, n and last (the newest
    day) of what is visible; news: as_of, isin, n (scored articles) and total (stored ones).
    """
    t = F.col("as_of")
    parts = [
        (prices, "prices", lambda: status(F.col("n"), MIN_PRICES, F.col("last"), t, PRICE_STALE_DAYS)),
        (annual, "annual", lambda: status(F.col("n"), MIN_YEARS)),
        (quarterly, "quarterly", lambda: status(F.col("n"), MIN_QUARTERS, F.col("last"), t, STALE_PERIOD_DAYS)),
        (holding, "shareholding", lambda: status(F.col("n"), MIN_HOLDINGS, F.col("last"), t, STALE_PERIOD_DAYS)),
        (news, "news", lambda: F.when(F.coalesce("total", F.lit(0)) == 0, "ABSENT").when(F.col("n") < MIN_ARTICLES, "PARTIAL").otherwise("PRESENT")),
    ]
    out = None
    for rows, name, told in parts:
        joined = grid.select("as_of", "isin").join(rows, ["as_of", "isin"], "left")
        last = F.col("last") if "last" in rows.columns else F.lit(None).cast("date")
        one = joined.select("as_of", "isin", F.lit(name).alias("dataset"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), last.alias("last"), told().alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def filings_status(grid: DataFrame, filings: DataFrame, extracted: DataFrame, least: int = 3) -> DataFrame:
    """as_of, isin, dataset, n, last, status of the reports that are held, as the rows of ``dataset_status``, with done (how many have been extracted).

    filings: isin, filing_id; extracted: filing_id. A report on disk is there whatever the
    date. None at all is no gap, as statements come from tagged filings; a few are one.
    """
    held = filings.join(extracted.select("filing_id", F.lit(1).alias("_done")).distinct(), "filing_id", "left")
    counts = held.groupBy("isin").agg(F.count("*").alias("n"), F.count("_done").alias("done"))
    rows = grid.select("as_of", "isin").join(counts, "isin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status_ = F.when((F.col("n") > 0) & (F.col("n") < least), "PARTIAL").otherwise("PRESENT")
    return rows.select("as_of", "isin", F.lit("filings").alias("dataset"), "n", F.lit(None).cast("date").alias("last"), status_.alias("status"), F.coalesce("done", F.lit(0)).alias("done"))


def blocked(diagnosed: DataFrame) -> DataFrame:
    """as_of, isin, dataset, n, factors, share: which missing factors each dataset blocks, and what part of a full score these are."""
    sizes: dict[str, float] = {}
    for family, _, weight in FACTORS.values():
        sizes[family] = sizes.get(family, 0.0) + weight
    parts = F.create_map(*[F.lit(x) for f, (family, _, weight) in FACTORS.items() for x in (f, FAMILY_WEIGHTS[family] * weight / sizes[family])])
    rows = diagnosed.where("dataset IS NOT NULL").withColumn("dataset", F.explode(F.split("dataset", ",")))
    return rows.groupBy("as_of", "isin", "dataset").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("factor")), ",").alias("factors"), F.sum(parts[F.col("factor")]).alias("share"))


def diagnosis(raw: DataFrame, statuses: DataFrame, newest: DataFrame) -> DataFrame:
    """as_of, isin, factor, dataset, reason for every missing factor, the cheapest cause first.

    raw: as_of, isin, factor, raw; statuses: ``dataset_status``; newest: as_of, isin and the
    newest visible annual row's columns. A missing dataset explains all behind it; then too
    few years, columns that are not populated, too few quarters or articles. Where all is
    there, the ratio is undefined for the company.
    """
    wide = statuses.groupBy("as_of", "isin").pivot("dataset", ["annual", "prices", "quarterly", "news"]).agg(F.first("status").alias("s"), F.first("n").alias("n"))
    rows = raw.where("raw is null").join(wide, ["as_of", "isin"], "left").join(newest, ["as_of", "isin"], "left")
    none = F.lit(None).cast("string")

    def absent(datasets: list[str]) -> Column:
        return F.array_join(F.filter(F.array(*(F.when(F.coalesce(F.col(f"{d}_s"), F.lit("ABSENT")) == "ABSENT", F.lit(d)) for d in datasets)), lambda x: x.isNotNull()), ",")

    def told(need: tuple[str, str, int, int, int]) -> tuple[Column, Column]:
        datasets, fields, years, quarters, articles = need[0].split(","), [f for f in need[1].split(",") if f], *need[2:]
        gone = absent(datasets)
        empty = F.array_join(F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",") if fields else F.lit("")
        cases = [(gone != "", gone, F.concat(F.lit("no "), gone))]
        if years > 1:
            cases.append((F.col("annual_n") < years, F.lit("annual"), F.concat(F.col("annual_n").cast("string"), F.lit(f" annual report(s), needs {years}"))))
        cases.append((empty != "", F.lit("annual"), F.concat(F.lit("not populated: "), empty)))
        if quarters:
            cases.append((F.col("quarterly_n") < quarters, F.lit("quarterly"), F.concat(F.col("quarterly_n").cast("string"), F.lit(f" quarter(s), needs {quarters}"))))
        if articles:
            cases.append((F.col("news_n") < articles, F.lit("news"), F.lit(f"fewer than {articles} scored articles")))
        dataset, reason = none, F.lit("undefined for this company")
        for test, d, r in reversed(cases):
            dataset, reason = F.when(test, d).otherwise(dataset), F.when(test, r).otherwise(reason)
        return dataset, reason

    dataset, reason = none, none
    for factor, need in NEEDS.items():
        d, r = told(need)
        dataset, reason = F.when(F.col("factor") == factor, d).otherwise(dataset), F.when(F.col("factor") == factor, r).otherwise(reason)
    return rows.select("as_of", "isin", "factor", dataset.alias("dataset"), reason.alias("reason"))


def factor_rows(z: DataFrame, families: DataFrame) -> DataFrame:
    """as_of, isin, family, factor, raw, z, share: each present factor's share of its family's mean, times the family's weight among those present."""
    names = F.create_map(*[F.lit(x) for pair in FAMILY_WEIGHTS.items() for x in pair])
    w = Window.partitionBy("as_of", "isin")
    present = families.where("family_z is not null").select("as_of", "isin", "family", (names[F.col("family")] / F.sum(names[F.col("family")]).over(w)).alias("of_all"))
    own = F.when(F.col("z").isNotNull(), F.col("weight"))
    rows = z.withColumn("of_family", own / F.sum(own).over(Window.partitionBy("as_of", "isin", "family"))).join(present, ["as_of", "isin", "family"], "left")
    return rows.select("as_of", "isin", "family", "factor", "raw", "z", (F.col("of_family") * F.col("of_all")).alias("share"))


def drivers(rows: DataFrame, n: int = 3) -> DataFrame:
    """as_of, isin, strengths, weaknesses: the n factors with the greatest and the least z on either side of zero, joined by commas."""
    pick = lambda order: F.array_join(F.transform(F.slice(F.array_sort(F.filter(F.collect_list(F.struct(order.alias("o"), "factor")), lambda x: x["o"] < 0)), 1, n), lambda x: x["factor"]), ",")
    return rows.where("z is not null").groupBy("as_of", "isin").agg(pick(-F.col("z")).alias("strengths"), pick(F.col("z")).alias("weaknesses"))


def stale(scores: DataFrame, version: str) -> DataFrame:
    """Adds stale: whether a score was made by another configuration than ``version``."""
    return scores.withColumn("stale", F.col("version") != version)


def top_and_bottom(scores: DataFrame, score: str, n: int) -> DataFrame:
    """as_of, end (TOP, BOTTOM), rank, isin and score of the n best and worst of each date."""
    rows = scores.where(F.col(score).isNotNull())
    ends = []
    for end, order in (("TOP", F.desc(score)), ("BOTTOM", F.asc(score))):
        rank = F.row_number().over(Window.partitionBy("as_of").orderBy(order, "isin"))
        ends.append(rows.withColumn("rank", rank).where(F.col("rank") <= n).select("as_of", F.lit(end).alias("end"), "rank", "isin", score))
    return ends[0].unionByName(ends[1])


def comparison(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """metric, strategy, benchmark, excess: two rows of metrics side by side."""
    names = [c for c in strategy.columns if c in benchmark.columns]
    long = lambda df, out: df.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "metric", out)
    return long(strategy, "strategy").join(long(benchmark, "benchmark"), "metric").withColumn("excess", F.col("strategy") - F.col("benchmark"))


def rebalances(grid: DataFrame, scored: DataFrame, dates: DataFrame, least: int = 10) -> DataFrame:
    """as_of, members, n_scored, skipped of all dates: one with too few members or scored companies is left out of a backtest."""
    members = grid.groupBy("as_of").agg(F.count("*").alias("members"))
    counted = scored.groupBy("as_of").agg(F.count("*").alias("n_scored"))
    rows = dates.select("as_of").join(members, "as_of", "left").join(counted, "as_of", "left").select("as_of", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
    return rows.withColumn("skipped", (F.col("members") < least) | (F.col("n_scored") < least))


def run_warnings(steps: DataFrame, safe: DataFrame, metrics: DataFrame, least_scored: float = 0.8, most_sharpe: float = 3.0) -> DataFrame:
    """warning, n of a backtest: survivorship (periods that no coverage holds), skipped rebalances, partial coverage (percent scored), an implausible Sharpe ratio."""
    unsafe = safe.where("not safe").agg(F.count("*").cast("double").alias("n")).select(F.lit("SURVIVORSHIP").alias("warning"), "n")
    skipped = steps.where("skipped").agg(F.count("*").cast("double").alias("n")).select(F.lit("SKIPPED").alias("warning"), "n")
    share = steps.where("not skipped").agg(F.avg(F.col("n_scored") / F.col("members")).alias("s")).where(F.col("s") < least_scored).select(F.lit("PARTIAL_COVERAGE").alias("warning"), (F.col("s") * 100).alias("n"))
    high = metrics.where(F.col("sharpe") > most_sharpe).select(F.lit("IMPLAUSIBLE_SHARPE").alias("warning"), F.col("sharpe").alias("n"))
    return unsafe.unionByName(skipped).where("n > 0").unionByName(share).unionByName(high)


def shuffled_returns(returns: DataFrame, seed: int = 0) -> DataFrame:
    """The returns of each date dealt anew among its companies: a control that no factor can foresee."""
    own = Window.partitionBy("as_of")
    mark = F.sha1(F.concat_ws("|", F.col("isin").cast("string"), F.col("as_of").cast("string"), F.lit(str(seed))))
    rows = returns.withColumn("_k", F.row_number().over(own.orderBy("isin"))).withColumn("_j", F.row_number().over(own.orderBy(mark, "isin")))
    dealt = rows.select("as_of", F.col("_j").alias("_k"), F.col("fwd").alias("_fwd"))
    return rows.join(dealt, ["as_of", "_k"]).select(*[F.col("_fwd").alias("fwd") if c == "fwd" else F.col(c) for c in returns.columns])


def store_status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, n, first, last of each table by a date column."""
    out = None
    for name, (df, day) in tables.items():
        row = df.agg(F.count("*").alias("n"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last")).select(F.lit(name).alias("table"), "n", "first", "last")
        out = row if out is None else out.unionByName(row)
    return out
