"""Read helpers over stored results: each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_as_of(signals: DataFrame) -> DataFrame:
    return signals.agg(F.max("as_of").alias("as_of"))


def scored_dates(signals: DataFrame) -> DataFrame:
    return signals.where("factor_score is not null").select("as_of").distinct()


def sectors(instruments: DataFrame) -> DataFrame:
    return instruments.where("sector is not null and sector <> ''").select("sector").distinct()


def by_symbol(instruments: DataFrame, symbol: str) -> DataFrame:
    """Instruments with the symbol, in either case."""
    return instruments.where(F.upper("symbol") == F.upper(F.lit(symbol)))


def search(instruments: DataFrame, text: str) -> DataFrame:
    """Instruments whose symbol or name has the text, in either case."""
    return instruments.where(F.contains(F.lower("symbol"), F.lower(F.lit(text))) | F.contains(F.lower("name"), F.lower(F.lit(text))))


def signals_on(signals: DataFrame, instruments: DataFrame, as_of: Column, signal: str | None = None, sector: str | None = None, flagged: bool | None = None, limit: int | None = None) -> DataFrame:
    """One date's signals with names, the best first; unscored ones last, equal ones by symbol."""
    rows = signals.where(F.col("as_of") == as_of).join(instruments.select("isin", "symbol", "name", "sector"), "isin")
    if signal is not None:
        rows = rows.where(F.col("signal") == signal)
    if sector is not None:
        rows = rows.where(F.col("sector") == sector)
    if flagged is not None:
        rows = rows.where((F.col("n_flags") > 0) == flagged)
    rows = rows.orderBy(F.desc_nulls_last("score"), "symbol")
    return rows.limit(limit) if limit is not None else rows


def signal_history(signals: DataFrame, n: int) -> DataFrame:
    """The n newest signals of each company, oldest first."""
    newest = Window.partitionBy("isin").orderBy(F.desc("as_of"))
    return signals.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r").orderBy("isin", "as_of")


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.where("signal is not null").groupBy("as_of", "signal").agg(F.count("*").alias("n"))


def recent_news(news: DataFrame, sentiment: DataFrame, n: int) -> DataFrame:
    """The n newest articles of each company, scored or not."""
    rows = news.withColumn("_r", F.row_number().over(Window.partitionBy("isin").orderBy(F.desc("published_at"), "news_id"))).where(F.col("_r") <= n).drop("_r")
    return rows.join(sentiment, "news_id", "left")


def missing_reason(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first that holds, the cheapest to check first; NULL where the factor is present."""
    told = F.coalesce(*(F.when(test, F.lit(name)) for name, test in reasons), F.lit("UNEXPLAINED"))
    return rows.withColumn("reason", F.when(F.col("raw").isNull(), told))


def month_windows(companies: DataFrame, first: Column, last: Column, done: DataFrame, epoch: str = "2017-01-01") -> DataFrame:
    """isin, window_start, window_end for every month that is not done; none before the epoch."""
    start = F.greatest(F.trunc(first, "month"), F.lit(epoch).cast("date"))
    rows = companies.select("isin", F.explode(F.when(start <= last, F.sequence(start, last, F.expr("interval 1 month")))).alias("window_start"))
    rows = rows.withColumn("window_end", F.least(F.last_day("window_start"), last))
    return rows.join(done.select("isin", "window_start"), ["isin", "window_start"], "left_anti")


def token_costs(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage (model, day, input, output, cache_write, cache_read, batch) with cost by the rate in force that day (model, since, input_rate, output_rate a million)."""
    met = usage.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(rates), "model").where(F.col("since") <= F.col("day"))  # rates: a short price list
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("since")))).where("_r = 1")
    cost = F.col("input_rate") * (F.col("input") + 1.25 * F.col("cache_write") + 0.10 * F.col("cache_read")) + F.col("output_rate") * F.col("output")
    return best.select(*usage.columns, (cost * F.when(F.col("batch"), 0.5).otherwise(1.0) / 1e6).alias("cost"))


def counted(rows: DataFrame, parts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rows with how many ``parts`` share their keys, 0 where none."""
    counts = parts.groupBy(*keys).agg(F.count("*").alias(out))
    return rows.join(counts, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def at_latest(rows: DataFrame, day: str) -> DataFrame:
    """The rows of the newest day."""
    return rows.join(F.broadcast(rows.agg(F.max(day).alias(day))), day, "left_semi")  # one row
