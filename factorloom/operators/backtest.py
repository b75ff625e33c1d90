"""Walk-forward portfolios and factor attribution over all rebalance dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.stats import average_rank, quantile_bucket

#: fractions of turnover; slippage in basis points
COSTS = {"stt_buy": 0.001, "stt_sell": 0.001, "exchange": 0.0000297, "sebi": 0.000001, "stamp": 0.00015, "gst": 0.18, "slippage_bps": 5.0, "participation": 0.01}
RISK_FREE = 0.065


def periods(dates: DataFrame) -> DataFrame:
    """as_of, until: each date with the next."""
    return dates.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("until")).where("until is not null")  # one row a month


def top_n(scores: DataFrame, score: str, n: int, higher: bool = True) -> DataFrame:
    """as_of, isin, weight of the n best (the highest, or the lowest where less is better), equally weighted; equal scores by isin."""
    order = F.desc(score) if higher else F.asc(score)
    ranked = scores.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("as_of").orderBy(order, "isin"))).where(F.col("_r") <= n)
    return ranked.select("as_of", "isin", (1 / F.count("*").over(Window.partitionBy("as_of"))).alias("weight"))


def trades(weights: DataFrame, executed: DataFrame) -> DataFrame:
    """as_of, buy, sell (weights bought and sold), n_buy, n_sell: against the previous executed date's weights. executed: as_of."""
    ordered = executed.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("next"))  # one row a month
    old = weights.join(ordered, "as_of").where("next is not null").select(F.col("next").alias("as_of"), "isin", F.col("weight").alias("old"))
    both = weights.join(old, ["as_of", "isin"], "full_outer")
    delta = F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return both.withColumn("d", delta).groupBy("as_of").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("buy"), F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0.0)).alias("sell"), F.count_if(F.col("d") > 0).alias("n_buy"), F.count_if(F.col("d") < 0).alias("n_sell"))


def median_traded(grid: DataFrame, prices: DataFrame, days: int = 90) -> DataFrame:
    """as_of, isin, median traded value of the last ``days`` days."""
    months = F.sequence(F.trunc(F.date_sub("as_of", days), "month"), F.trunc("as_of", "month"), F.expr("interval 1 month"))
    met = grid.select("as_of", "isin").withColumn("month", F.explode(months)).join(prices.withColumn("month", F.trunc("date", "month")), ["isin", "month"])
    return met.where((F.col("date") <= F.col("as_of")) & (F.col("date") >= F.date_sub("as_of", days))).groupBy("as_of", "isin").agg(F.median("traded_value").alias("median_traded"))


def drawdowns(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ret, peak and drawdown to date, nav, of each ``by``."""
    w = Window.partitionBy(*by or []).orderBy("date")  # one row a month
    rows = curve.withColumn("ret", F.col("nav") / F.lag("nav").over(w) - 1).withColumn("peak", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def metrics(curve: DataFrame, per_year: int = 12, turnover: DataFrame | None = None, capital: float = 1_000_000.0, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each ``by``: periods, years, total_return, cagr, volatility, sharpe, sortino, max_drawdown, calmar, hit_rate, best_period, worst_period, avg_turnover, total_costs_pct.

    turnover: turnover (fractions of the portfolio traded) and costs, a row a period; without
    it both figures are 0. The curve's first value starts it and has no return.
    """
    by = by or []
    traded = turnover.groupBy(*by).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"), (F.coalesce(F.sum("costs"), F.lit(0.0)) / capital).alias("total_costs_pct")) if turnover is not None else curve.sparkSession.range(1).select(F.lit(0.0).alias("avg_turnover"), F.lit(0.0).alias("total_costs_pct"))
    d = drawdowns(curve, by).groupBy(*by).agg(
        F.count("ret").alias("periods"), F.max_by("nav", "date").alias("b"), F.min_by("nav", "date").alias("a"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("int"))).alias("hit_rate"), F.max("ret").alias("best_period"), F.min("ret").alias("worst_period"),
    )
    root = float(per_year) ** 0.5
    d = d.withColumn("total_return", F.col("b") / F.col("a") - 1).withColumn("cagr", F.pow(F.col("b") / F.col("a"), F.lit(float(per_year)) / F.nullif("periods", F.lit(0))) - 1)
    ratio = lambda den: F.when(den > 0, (F.col("cagr") - RISK_FREE) / den).otherwise(0.0)
    d = d.join(traded, by, "left") if by and turnover is not None else d.crossJoin(F.broadcast(traded))  # one row
    return d.select(*by, "periods", F.round(F.col("periods") / per_year, 2).alias("years"), "total_return", "cagr", (F.col("sd") * root).alias("volatility"), ratio(F.col("sd") * root).alias("sharpe"), ratio(F.col("down") * root).alias("sortino"), "max_drawdown", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"), "hit_rate", "best_period", "worst_period", "avg_turnover", "total_costs_pct")


def equal_weight(returns: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """date, nav of holding every company equally, without costs."""
    mean = returns.groupBy("as_of", "until").agg(F.avg("fwd").alias("r"))
    w = Window.orderBy("until").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    return mean.select(F.col("until").alias("date"), (capital * F.exp(F.sum(F.ln(1 + F.col("r"))).over(w))).alias("nav"))


def attribution(z: DataFrame, returns: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per factor and date (n, ic, spread), and per factor the mean, t statistic, hit rate, mean spread, coverage and monotony.

    IC is the correlation of average ranks; the spread is the mean return of the top
    bucket less that of the bottom one, of min(10, n / 3) buckets. Coverage is the mean
    share of a date's companies that have a z, over dates with enough returns. A factor is
    monotonic if its buckets' mean returns, averaged over dates, never fall.
    """
    enough = returns.groupBy("as_of").agg(F.count("fwd").alias("m")).where(F.col("m") >= least).select("as_of")
    covered = z.join(enough, "as_of", "left_semi").groupBy("as_of", "factor").agg((F.count("z") / F.count("*")).alias("c")).groupBy("factor").agg(F.avg("c").alias("coverage"))
    rows = z.where("z is not null").join(returns.select("as_of", "isin", "fwd"), ["as_of", "isin"])
    keys = ["as_of", "factor"]
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumn("n", n).where(F.col("n") >= least).withColumn("rz", average_rank("z", keys)).withColumn("rr", average_rank("fwd", keys))
    rows = rows.withColumn("buckets", F.least(F.lit(10), F.floor(F.col("n") / 3))).withColumn("bucket", quantile_bucket("z", keys, "isin", F.col("buckets")))
    dated = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rz", "rr").alias("ic"), (F.avg(F.when(F.col("bucket") == F.col("buckets") - 1, F.col("fwd"))) - F.avg(F.when(F.col("bucket") == 0, F.col("fwd")))).alias("spread"))
    summary = dated.groupBy("factor").agg(F.count("ic").alias("periods"), F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0)) * F.sqrt(F.count("ic"))).alias("ic_t"), F.avg((F.col("ic") > 0).cast("int")).alias("hit_rate"), (12 * F.avg("spread")).alias("spread_year"))
    means = rows.groupBy(*keys, "bucket").agg(F.avg("fwd").alias("r")).groupBy("factor", "bucket").agg(F.avg("r").alias("r"))
    before = F.lag("r").over(Window.partitionBy("factor").orderBy("bucket"))
    rising = means.withColumn("up", F.coalesce(F.col("r") >= before, F.lit(True))).groupBy("factor").agg(F.bool_and("up").alias("monotonic"))
    return dated, summary.join(covered, "factor", "left").join(rising, "factor", "left")
