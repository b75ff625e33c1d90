"""Many walk-forward backtests in one plan: configurations, dates and companies are columns.

A configuration is a row: run_id, factor, top_n, least (fewest members and scored companies
that a date needs), capital, costs (whether they are taken), brokerage (a share of turnover)
and flat (an amount an order). Prices, scores and forward returns are worked out once for
all runs. A date that a run skips is not a rebalance of it: the portfolio before it is what
the next executed date trades against, and nothing is earned from it to the next date.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import safe_divide
from factorloom.operators import backtest as B
from factorloom.shipping import ship

CONFIG = "run_id string, factor string, top_n int, least int, capital double, costs boolean, brokerage double, flat double"
_CURVE = "run_id string, as_of date, date date, nav double, gross_nav double, costs double, turnover double"


def schedule(configs: DataFrame, grid: DataFrame, z: DataFrame, dates: DataFrame) -> DataFrame:
    """run_id, as_of, until, members, n_scored, skipped of every run and date but the last. z: as_of, isin, factor, z."""
    members = grid.groupBy("as_of").agg(F.count("*").alias("members"))
    scored = z.where("z IS NOT NULL").groupBy("as_of", "factor").agg(F.count("*").alias("n_scored"))
    rows = configs.select("run_id", "factor", "least").join(F.broadcast(B.periods(dates)))  # dates: one row a month
    rows = rows.join(members, "as_of", "left").join(scored, ["as_of", "factor"], "left").withColumn("members", F.coalesce("members", F.lit(0))).withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    return rows.select("run_id", "as_of", "until", "members", "n_scored", ((F.col("members") < F.col("least")) | (F.col("n_scored") < F.col("least"))).alias("skipped"))


def positions(configs: DataFrame, scheduled: DataFrame, z: DataFrame) -> DataFrame:
    """run_id, as_of, until, isin, weight: the top_n highest z of each executed date, equally weighted; equal scores by isin."""
    best = z.where("z IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("factor", "as_of").orderBy(F.desc("z"), "isin")))
    wanted = scheduled.where("NOT skipped").join(configs.select("run_id", "factor", "top_n"), "run_id")
    held = wanted.join(best.select("factor", "as_of", "isin", "_r"), ["factor", "as_of"]).where("_r <= top_n")
    return held.select("run_id", "as_of", "until", "isin", (1 / F.least("top_n", "n_scored")).alias("weight"))


def trades(held: DataFrame, scheduled: DataFrame) -> DataFrame:
    """run_id, as_of, buy, sell, n_buy, n_sell: against the weights of the run's executed date before."""
    executed = scheduled.where("NOT skipped").select("run_id", "as_of", F.lead("as_of").over(Window.partitionBy("run_id").orderBy("as_of")).alias("next"))
    old = held.join(executed, ["run_id", "as_of"]).where("next IS NOT NULL").select("run_id", F.col("next").alias("as_of"), "isin", F.col("weight").alias("old"))
    both = held.select("run_id", "as_of", "isin", "weight").join(old, ["run_id", "as_of", "isin"], "full_outer")
    d = F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    zero = F.lit(0.0)
    return both.withColumn("d", d).groupBy("run_id", "as_of").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), zero).alias("buy"), F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), zero).alias("sell"), F.count_if(F.col("d") > 0).alias("n_buy"), F.count_if(F.col("d") < 0).alias("n_sell"))


def fixed_rate(buy: Column, sell: Column, brokerage: Column) -> Column:
    """Costs that are a share of what is traded, but for slippage; brokerage and exchange fees bear GST, taxes do not."""
    c = B.COSTS
    turnover = buy + sell
    return buy * (c["stt_buy"] + c["stamp"]) + sell * c["stt_sell"] + turnover * (c["exchange"] + c["sebi"] + brokerage) * (1 + c["gst"])


def nav_curves(steps: DataFrame) -> DataFrame:
    """run_id, as_of, date, nav, gross_nav, costs, turnover (traded shares of the value), a row for each executed date.

    steps: run_id, as_of, until, capital, ret, turnover, rate (costs as a share), orders
    (costs as an amount) and tied (mean of weight over median traded value; NULL or zero:
    no impact). Slippage depends on the value and so on all costs before, so the dates of
    one run - one row a rebalance - are gone through in order; runs are spread over tasks.
    """
    ship(steps.sparkSession)
    base, threshold = B.COSTS["slippage_bps"] / 10_000, B.COSTS["participation"]

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("as_of").reset_index(drop=True)
        nav = gross = float(run["capital"].iloc[0])
        out = []
        for ret, turnover, rate, orders, tied in run[["ret", "turnover", "rate", "orders", "tied"]].fillna({"tied": 0.0}).itertuples(index=False):
            share = tied * nav / threshold
            slippage = turnover * base * (min(1 + share, 10.0) if share > 1 else 1.0)
            costs = 0.0 if pd.isna(rate) else nav * (rate + slippage) + orders
            nav, gross = (nav - costs) * (1 + ret), gross * (1 + ret)
            out.append((nav, gross, costs))
        curve = pd.DataFrame(out, columns=["nav", "gross_nav", "costs"])
        return pd.concat([run[["run_id", "as_of", "until"]], curve, run[["turnover"]]], axis=1).rename(columns={"until": "date"})

    return steps.select("run_id", "as_of", "until", "capital", "ret", "turnover", "rate", "orders", "tied").groupBy("run_id").applyInPandas(fold, _CURVE)


def backtests(configs: DataFrame, grid: DataFrame, z: DataFrame, dates: DataFrame, returns: DataFrame, traded: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """schedule, positions and curve of all runs.

    returns: isin, as_of, until, fwd of the universe; ``transform`` maps that frame to
    another of its kind before portfolios meet it (a control that deals returns anew, say).
    traded: as_of, isin, median_traded. A company without a return is held flat.
    """
    if transform is not None:
        returns = transform(returns)
    scheduled = schedule(configs, grid, z, dates)
    held = positions(configs, scheduled, z)
    met = held.join(returns.select("isin", "as_of", "until", "fwd"), ["isin", "as_of", "until"], "left").join(traded, ["as_of", "isin"], "left")
    steps = met.groupBy("run_id", "as_of", "until").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("ret"), F.avg(safe_divide(F.col("weight"), F.col("median_traded"))).alias("tied"))
    costed = steps.join(trades(held, scheduled), ["run_id", "as_of"]).join(configs.select("run_id", "capital", F.col("costs").alias("_on"), "brokerage", "flat"), "run_id")
    on = lambda c: F.when(F.col("_on"), c)
    rows = costed.select(
        "run_id", "as_of", "until", "capital", "ret", on(F.col("buy") + F.col("sell")).alias("turnover"),
        on(fixed_rate(F.col("buy"), F.col("sell"), F.col("brokerage"))).alias("rate"),
        on((F.col("n_buy") + F.col("n_sell")) * F.col("flat") * (1 + B.COSTS["gst"])).alias("orders"), on(F.col("tied")).alias("tied"),
    )
    return {"schedule": scheduled, "positions": held.drop("until"), "curve": nav_curves(rows)}


def run_metrics(curves: DataFrame, configs: DataFrame, per_year: int = 12) -> DataFrame:
    """run_id and what ``backtest.metrics`` tells of a curve."""
    costs = curves.join(configs.select("run_id", "capital"), "run_id").withColumn("costs", F.col("costs") / F.col("capital"))
    return B.metrics(curves.select("run_id", "date", "nav"), per_year, turnover=costs.select("run_id", "turnover", "costs"), capital=1.0, by=["run_id"])
