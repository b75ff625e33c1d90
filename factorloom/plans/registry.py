"""Registered queries: each applies operators of this package to the driver's tables.

Dates are returned as text and doubles rounded as ``shown`` says, as in the SQL of ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import scalar as C
from factorloom.operators import backtest as B
from factorloom.operators import factors as V
from factorloom.operators import news as N
from factorloom.operators import point_in_time as P
from factorloom.operators import runs as U
from factorloom.operators import scoring as X
from factorloom.operators import serving as R
from factorloom.operators import statements as E
from factorloom.operators import stats as A
from factorloom.plans import oracles
from factorloom.sources import adapters as S

FIRST, LAST = "1999-01-01", "2001-10-31"
#: observations that the price windows need on these tables
MINIMA = {"min_year": 40, "min_average": 30, "min_half": 20}
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir))
    return f


def shown(df: DataFrame) -> DataFrame:
    """Doubles in single precision and to nine places (no negative zero), dates and times as text: what no order of summing changes."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.when(F.round(c, 9) == 0, 0.0).otherwise(F.round(c, 9).cast("float").cast("double"))
        elif kind in ("date", "timestamp_ntz"):
            c = c.cast("string")
        columns.append(c.alias(name))
    return df.select(*columns)


class Model:
    """The adapters' tables of one directory, and what most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.instruments = S.instruments(spark, sf_dir)
        self.dates = S.month_ends(spark, FIRST, LAST)
        self.membership = S.index_membership(spark, sf_dir)

    @property
    def prices(self) -> DataFrame:
        return S.prices_daily(self.spark, self.dir)

    @property
    def annual(self) -> DataFrame:
        return S.fundamentals_annual(self.spark, self.dir)

    @property
    def quarterly(self) -> DataFrame:
        return S.fundamentals_quarterly(self.spark, self.dir)

    @property
    def holding(self) -> DataFrame:
        return S.shareholding(self.spark, self.dir)

    def grid(self) -> DataFrame:
        return P.universe(self.dates, self.membership, self.instruments)

    def raw(self) -> DataFrame:
        return V.all_factors(self.grid(), self.prices, self.annual, self.quarterly, S.news_history(self.spark, self.dir), **MINIMA)

    def families(self) -> DataFrame:
        return X.family_scores(X.factor_z(self.raw()))

    def history(self) -> DataFrame:
        # as many rows as the factors ask for, so that Spark finds one exchange for both
        return P.newest_of_basis(self.grid(), self.annual, V.YEARS).where("rn <= 3")

    def flags(self) -> DataFrame:
        grid = self.grid()
        held = P.latest_known(grid, self.holding, "disclosed_date", [P.newest("quarter_end")], 6)
        return X.red_flags(grid, self.history(), held)

    def returns(self) -> DataFrame:
        spans = self.grid().join(F.broadcast(B.periods(self.dates)), "as_of").select("isin", "as_of", "until")  # one row a month
        return P.forward_returns(spans, self.prices)

    def momentum_z(self) -> DataFrame:
        raw = V.momentum(self.grid(), self.prices, **MINIMA).where("factor = 'momentum_12_1'")
        return A.sector_zscore(raw, "raw", ["as_of", "factor"], "sector", "z")


@query
def s1_instruments(spark, sf_dir):
    return S.instruments(spark, sf_dir)


@query
def s4_prices_daily(spark, sf_dir):
    return S.prices_daily(spark, sf_dir)


@query
def b1_month_ends(spark, sf_dir):
    """Month ends from the first to the last price."""
    return S.month_ends_of(S.prices_daily(spark, sf_dir), "date")


@query
def p1_universe(spark, sf_dir):
    return Model(spark, sf_dir).grid()


@query
def p2_prices_lookback(spark, sf_dir):
    """Prices of the 30 days up to each date, both ends included: counts and means."""
    m = Model(spark, sf_dir)
    months = F.sequence(F.trunc(F.date_sub("as_of", 30), "month"), F.trunc("as_of", "month"), F.expr("interval 1 month"))
    met = m.grid().select("as_of", "isin").withColumn("month", F.explode(months)).join(m.prices.withColumn("month", F.trunc("date", "month")), ["isin", "month"])
    return met.where(F.col("date").between(F.date_sub("as_of", 30), F.col("as_of"))).groupBy("as_of", "isin").agg(F.count("*").alias("n"), F.avg("adj_close").alias("mean_price"))


@query
def p3_fundamentals_latest(spark, sf_dir):
    m = Model(spark, sf_dir)
    rows = P.latest_known(m.grid(), m.annual.where("basis = 'CONSOLIDATED'"), "filing_date", [P.newest("period_end_date"), P.newest("filing_date")])
    return rows.select("as_of", "isin", "period_end_date", "revenue", "pat", "ocf")


@query
def p4_fundamentals_history(spark, sf_dir):
    return Model(spark, sf_dir).history().select("as_of", "isin", "rn", "basis", "period_end_date", "revenue", "pat")


@query
def p5_quarterly_newest_8(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.latest_known(m.grid(), m.quarterly, "filing_date", [P.newest("period_end_date")], 8).select("as_of", "isin", "rn", "period_end_date", "revenue", "pat")


@query
def p6_sentiment_window(spark, sf_dir):
    grid = Model(spark, sf_dir).instruments.select("isin").crossJoin(F.broadcast(S.month_ends(spark, "2024-01-01", "2024-01-31")))  # one date
    return P.sentiment_window(grid, S.news(spark, sf_dir)).select("as_of", "isin", "news_id", "label", "score")


@query
def p7_shareholding_history(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.latest_known(m.grid(), m.holding, "disclosed_date", [P.newest("quarter_end")], 6).select("as_of", "isin", "rn", "quarter_end", "promoter_pct", "promoter_pledged_pct")


@query
def p8_forward_returns(spark, sf_dir):
    return Model(spark, sf_dir).returns()


@query
def p9_survivorship(spark, sf_dir):
    """Whether the months of each year lie in the span that membership covers."""
    m = Model(spark, sf_dir)
    coverage = m.membership.agg(F.min("from_date").alias("verified_from"), F.lit("2000-12-31").cast("date").alias("verified_to"))
    return P.survivorship_safe(B.periods(m.dates).select(F.col("as_of").alias("start"), F.col("until").alias("end")), coverage).withColumnRenamed("end", "finish")


@query
def p11_price_as_of(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.price_as_of(m.grid().select("as_of", "isin"), m.prices, "as_of", 15, "price").select("as_of", "isin", "price")


@query
def p12_fiscal_years(spark, sf_dir):
    q = S.fundamentals_quarterly(spark, sf_dir)
    return q.groupBy("isin", C.fiscal_year(F.col("period_end_date")).alias("fiscal_year")).agg(F.count("*").alias("quarters"), F.sum("revenue").alias("revenue"))


@query
def a3_month_buckets(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.avg("value").alias("mean_value"))


@query
def a4_sentiment_counts(spark, sf_dir):
    n = S.news(spark, sf_dir)
    return n.groupBy("isin").agg(*(F.count_if(F.col("label") == x).alias(x) for x in ("positive", "negative", "neutral")))


@query
def a8_median_traded_value(spark, sf_dir):
    m = Model(spark, sf_dir)
    return B.median_traded(m.grid(), m.prices)


@query
def a9_winsorize(spark, sf_dir):
    raw = V.long_form(V.panel(Model(spark, sf_dir).grid(), S.prices_daily(spark, sf_dir), S.fundamentals_annual(spark, sf_dir)), {"accruals": V.value_quality_columns()["accruals"]})
    return A.winsorize(raw, "raw", ["as_of"], "clipped").select("as_of", "isin", "raw", "clipped")


@query
def a10_sector_zscore(spark, sf_dir):
    return Model(spark, sf_dir).momentum_z().select("as_of", "isin", "sector", "raw", "z")


@query
def a15_news_sentiment(spark, sf_dir):
    grid = Model(spark, sf_dir).instruments.select("isin").crossJoin(F.broadcast(S.month_ends(spark, "2024-01-01", "2024-01-31")))  # one date
    return V.news_sentiment(P.sentiment_window(grid, S.news(spark, sf_dir)))


@query
def a21_alias_conflicts(spark, sf_dir):
    """First words of parts' names that several brands claim."""
    p = S.read(spark, sf_dir, "part").select(F.col("p_brand").alias("isin"), F.lower(F.split("p_name", " ")[0]).alias("alias"))
    return N.split_conflicts(p.distinct())[1]


@query
def w4_drawdown(spark, sf_dir):
    m = Model(spark, sf_dir)
    return B.drawdowns(B.equal_weight(m.returns()))


@query
def w13_quantile_buckets(spark, sf_dir):
    z = Model(spark, sf_dir).momentum_z().where("z is not null")
    return z.withColumn("bucket", A.quantile_bucket("z", ["as_of"], "isin", F.lit(5))).groupBy("as_of", "bucket").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


@query
def w14_average_rank(spark, sf_dir):
    s = S.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return s.withColumn("r", A.average_rank("p_size", ["p_brand"]))


@query
def v_value_factors(spark, sf_dir):
    return Model(spark, sf_dir).raw().where(F.col("factor").isin("earnings_yield", "book_to_price", "ebitda_to_ev", "fcf_yield", "peg_inverse")).select("as_of", "isin", "factor", "raw")


@query
def q_quality_factors(spark, sf_dir):
    m = Model(spark, sf_dir)
    names = ("roe", "roce", "debt_to_equity", "interest_coverage", "cfo_to_pat", "accruals")
    return V.long_form(V.panel(m.grid(), m.prices, m.annual), {n: c for n, c in V.value_quality_columns().items() if n in names}).select("as_of", "isin", "factor", "raw")


@query
def g_growth_factors(spark, sf_dir):
    m = Model(spark, sf_dir)
    return V.growth(m.grid(), m.annual, m.quarterly).select("as_of", "isin", "factor", "raw")


@query
def m_momentum_factors(spark, sf_dir):
    m = Model(spark, sf_dir)
    return V.momentum(m.grid(), m.prices, **MINIMA).select("as_of", "isin", "factor", "raw")


@query
def x1_composite(spark, sf_dir):
    return X.composite(Model(spark, sf_dir).families())


@query
def x3_signals(spark, sf_dir):
    m = Model(spark, sf_dir)
    return X.signals(X.composite(m.families()), X.flag_summary(m.flags()).select("as_of", "isin", "n_flags")).select("as_of", "isin", "factor_score", "score", "n_flags", "signal")


@query
def x5_red_flags(spark, sf_dir):
    return Model(spark, sf_dir).flags()


@query
def x12_flag_summary(spark, sf_dir):
    return X.flag_summary(Model(spark, sf_dir).flags())


@query
def x13_family_percentiles(spark, sf_dir):
    return X.percentiles(Model(spark, sf_dir).families())


@query
def x14_contributions(spark, sf_dir):
    return X.contributions(Model(spark, sf_dir).families())


@query
def x16_readiness(spark, sf_dir):
    m = Model(spark, sf_dir)
    p = m.prices.where(F.col("date") <= F.lit(LAST).cast("date"))
    return E.readiness(p.groupBy("isin").agg(F.max("date").alias("last")), p.groupBy("isin").agg(F.count("*").alias("n")), F.lit(LAST).cast("date"), 15, 180)


@query
def t2_top_n(spark, sf_dir):
    return B.top_n(Model(spark, sf_dir).momentum_z(), "z", 20)


@query
def b2_backtest(spark, sf_dir):
    """Walk-forward 12-1 momentum: top 20, equal weights, costs on."""
    return backtest_curve(Model(spark, sf_dir)).drop("turnover")


#: the momentum backtest's configuration, as ``runs`` reads it
MOMENTUM = ("momentum", "momentum_12_1", 20, 10, 1_000_000.0, True, 0.0, 0.0)


def backtest_curve(m: Model) -> DataFrame:
    """date, nav, gross_nav, costs, turnover of the momentum backtest."""
    z = m.momentum_z().select("as_of", "isin", "factor", "z")
    configs = m.spark.createDataFrame([MOMENTUM], U.CONFIG)
    return U.backtests(configs, m.grid(), z, m.dates, m.returns(), B.median_traded(m.grid(), m.prices))["curve"].drop("run_id", "as_of")


@query
def b3_trades(spark, sf_dir):
    m = Model(spark, sf_dir)
    weights = B.top_n(m.momentum_z(), "z", 20)
    return B.trades(weights, weights.select("as_of").distinct())


@query
def b6_metrics(spark, sf_dir):
    """Of the momentum backtest, costs on."""
    m = Model(spark, sf_dir)
    curve = backtest_curve(m)
    return B.metrics(curve, turnover=curve.select("turnover", "costs"))


@query
def b7_equal_weight(spark, sf_dir):
    return B.equal_weight(Model(spark, sf_dir).returns())


@query
def b9_attribution(spark, sf_dir):
    m = Model(spark, sf_dir)
    return B.attribution(m.momentum_z(), m.returns())[0]


@query
def b9_attribution_summary(spark, sf_dir):
    m = Model(spark, sf_dir)
    return B.attribution(X.factor_z(V.momentum(m.grid(), m.prices, **MINIMA)), m.returns())[1]


@query
def c3_story_dedup(spark, sf_dir):
    d = N.story_keys(S.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return N.first_of_story(d, ["source", "content_hash"], ["doc_id"]).select("doc_id", "content_hash", "is_first")


@query
def r3_mentions(spark, sf_dir):
    """Three-word openings of benchmark items, found in the documents."""
    b = S.read(spark, sf_dir, "benchmark")
    words = F.split(C.normalise_text(F.col("text")), " ")
    aliases = b.select(F.array_join(F.slice(words, 1, 3), " ").alias("alias"), F.col("item_id").alias("isin"), F.lit(0.9).alias("confidence"))
    return N.mentions(S.read(spark, sf_dir, "documents"), N.split_conflicts(aliases)[0], "doc_id", "text").select("doc_id", "start", "n", "alias", "isin")


@query
def r5_roundups(spark, sf_dir):
    """Orders as articles, suppliers as companies: those on many say little of each."""
    rows = S.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("isin"), F.lit(0.95).alias("confidence"), F.lit("HEADLINE").alias("method")).distinct()
    return N.demote_roundups(rows, "l_orderkey")


@query
def e1_validation(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir)
    rows = a.withColumn("total_liabilities", F.col("total_assets") - F.col("total_equity")).withColumn("tax_expense", F.col("profit_before_tax") - F.col("pat") + F.when(F.col("isin") % 11 == 0, 10000.0).otherwise(0.0)).withColumn("total_income", F.col("revenue") * F.when(F.col("isin") % 4 == 0, 0.9).otherwise(1.0)).withColumn("total_expenses", F.lit(None).cast("double"))
    return E.validate(rows).select("isin", "period_end_date", "basis", F.array_join(E.failures(), ",").alias("failed"), "confidence")


@query
def e2_quarters_against_year(spark, sf_dir):
    m = Model(spark, sf_dir)
    return E.quarters_against_year(m.annual.where("basis = 'CONSOLIDATED'"), m.quarterly, "revenue", 0.10)


@query
def k1_upsert(spark, sf_dir):
    """Orders with the 1998 ones replaced."""
    o = S.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = S.read(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1998).select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"))
    return E.upsert(o, new, ["o_orderkey"])


@query
def k3_fill_from_index(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(None).cast("date").alias("known"))
    index = S.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("known"), "l_linenumber")
    return E.fill_from_index(o, index, ["k"], ["known"], [F.col("known"), F.col("l_linenumber")])


@query
def k7_unpivot(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir).where("basis = 'CONSOLIDATED'")
    return a.unpivot(["isin", "period_end_date"], ["revenue", "pat", "ocf", "capex"], "item", "amount").where("amount is not null")


@query
def x18_statement_pivot(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir).where("basis = 'CONSOLIDATED'")
    return a.withColumn("y", F.year("period_end_date")).groupBy("isin").pivot("y", [1998, 1999, 2000]).agg(F.first("revenue")).select("isin", *(F.col(str(y)).alias(f"fy{y}") for y in (1998, 1999, 2000)))


@query
def j3_pending(spark, sf_dir):
    """Orders without a returned line or a late one: two anti joins."""
    o = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    line = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_shipdate")
    return E.pending(o, line.where("l_returnflag = 'R'"), line.where(F.year("l_shipdate") >= 1998), ["k"])


@query
def c15_page_ranges(spark, sf_dir):
    return E.page_ranges(S.read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'"), "l_orderkey", "l_linenumber")


@query
def t1_signals_on(spark, sf_dir):
    """The best ten BUY and HOLD names of the last date of 2000 (a report of ten)."""
    m = Model(spark, sf_dir)
    rows = X.signals(X.composite(m.families()), X.flag_summary(m.flags()).select("as_of", "isin", "n_flags"))
    return R.signals_on(rows, m.instruments, F.lit("2000-12-31").cast("date"), flagged=False, limit=10).select("symbol", "name", "sector", "score", "signal")


@query
def w17_signal_history(spark, sf_dir):
    """The six newest momentum values of each company."""
    return R.signal_history(Model(spark, sf_dir).momentum_z().select("as_of", "isin", "z"), 6)


@query
def a2_signal_counts(spark, sf_dir):
    m = Model(spark, sf_dir)
    return R.signal_counts(X.signals(X.composite(m.families()), X.flag_summary(m.flags()).select("as_of", "isin", "n_flags")))


@query
def a19_dominant_family(spark, sf_dir):
    return X.dominant_family(X.contributions(Model(spark, sf_dir).families()))


@query
def s18_pending_windows(spark, sf_dir):
    """Months since 1999 in which a company has no price."""
    m = Model(spark, sf_dir)
    done = m.prices.select("isin", F.trunc("date", "month").alias("window_start")).distinct()
    return R.month_windows(m.instruments.select("isin"), F.lit("1999-01-15").cast("date"), F.lit("2001-12-31").cast("date"), done, epoch="1999-01-01")


@query
def x17_missing_reasons(spark, sf_dir):
    """Why companies have no price within 15 days of a date."""
    m = Model(spark, sf_dir)
    p = m.prices.groupBy("isin").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    rows = P.price_as_of(m.grid().select("as_of", "isin"), m.prices, "as_of", 3, "raw").join(p, "isin", "left")
    told = R.missing_reason(rows, [("NO_PRICES", F.col("first").isNull()), ("NOT_YET", F.col("first") > F.col("as_of")), ("ENDED", F.col("last") < F.col("as_of")), ("GAP", F.lit(True))])
    return told.where("raw is null").select("as_of", "isin", "reason")


@query
def e5_duplicate_periods(spark, sf_dir):
    """Lines as filings: of several on one day, the one on the order's scale."""
    rows = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_extendedprice").groupBy("l_orderkey", "l_linestatus", "l_extendedprice").count().drop("count")
    return E.resolve_duplicate_periods(rows.unionByName(rows.where("l_orderkey % 3 = 0").withColumn("l_linestatus", F.lit("Z"))), "l_orderkey", "l_linestatus", "l_extendedprice")


@query
def e7_page_selection(spark, sf_dir):
    """Lines of an order as pages, quantities as scores."""
    rows = S.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("page")).agg(F.max("l_quantity").alias("score"))
    return E.select_pages(rows, "l_orderkey", "page", "score", strong=45, weak=30, after=1, budget=3)


@query
def e10_disagreements(spark, sf_dir):
    """Parts whose suppliers' unit prices differ by more than 1 %."""
    unit = S.lines(spark, sf_dir).select("isin", "flag", F.year("date").alias("y"), (F.col("ext").cast("double") / F.col("qty").cast("double")).alias("v"))
    return E.disagreements(unit, ["isin", "flag", "y"], "v", 0.01)


@query
def r1_alias_candidates(spark, sf_dir):
    """Aliases of parts' names; blue is a group's name, red and anvil are common words."""
    p = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("isin"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Works of"), F.lit("Ltd")).alias("name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    curated = S.read(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol"), F.concat(F.lit("Known-as "), F.col("p_brand")).alias("alias"))
    return N.alias_candidates(p, ["blue"], ["red", "anvil"], curated)


@query
def r6_store_new(spark, sf_dir):
    """Documents from 100 on that are no story of the first hundred or of each other."""
    d = N.story_keys(S.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return N.store_new(d.where("doc_id >= 100"), d.where("doc_id < 100"), ["source", "content_hash"], ["doc_id"]).select("doc_id", "content_hash")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-1 momentum, sector-relative: the 20 best of every month."""
    return queries()["t2_top_n"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from factorloom.plans import kept, more, streams  # noqa: F401 - they register their queries

    return dict(_found)


def oracle_sql() -> dict[str, str]:
    from factorloom.plans import oracles_kept, oracles_more

    return {k: v for k, v in (oracles.SQL | oracles_more.SQL | oracles_kept.SQL).items() if k in queries()}
