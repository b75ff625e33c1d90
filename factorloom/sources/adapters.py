"""The research model's tables, read from the driver's tables.

Money is summed as decimals and turned into doubles once, so results do not depend on
the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, symbol, name, sector, industry. Nations and regions are fixed small tables."""
    place = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("isin"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c, p: F.col(c).cast(f"decimal({p},2)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("isin"), F.to_date("l_shipdate").alias("date"), money("l_quantity", 18).alias("qty"), money("l_extendedprice", 18).alias("ext"), money("l_discount", 4).alias("disc"), money("l_tax", 4).alias("tax"), F.col("l_returnflag").alias("flag")
    )


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with quantities and amounts in hundredths, as whole numbers: sums of these, and of products of two, are exact and take no decimals. A sum beyond a long fails."""
    hundredths = lambda c: F.rint(F.col(c) * 100).cast("bigint")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("isin"), F.to_date("l_shipdate").alias("date"), hundredths("l_quantity").alias("qty"), hundredths("l_extendedprice").alias("ext"), hundredths("l_discount").alias("disc"), hundredths("l_tax").alias("tax"), F.col("l_returnflag").alias("flag")
    )


def _scaled(total: Column, places: int) -> Column:
    """The double next to a whole number over 10 ** places."""
    return (total.cast("decimal(19,0)") * F.lit(f"1e-{places}").cast(f"decimal({places},{places})")).cast("double")


def _double(x: Column, digits: int = 4) -> Column:
    return F.round(x.cast("double"), digits)


def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, date, adj_close, volume, traded_value."""
    rows = _whole(spark, sf_dir).groupBy("isin", "date").agg(F.sum("ext").alias("value"), F.sum("qty").alias("qty"))
    value, qty = (_scaled(F.col(c), 2) for c in ("value", "qty"))
    return rows.select("isin", "date", (value / qty).alias("adj_close"), qty.cast("bigint").alias("volume"), value.alias("traded_value"))


def _statements(spark: SparkSession, sf_dir: str, period_end: Column) -> DataFrame:
    ext, disc, tax = F.col("ext"), F.col("disc"), F.col("tax")
    held = lambda test: F.coalesce(_scaled(F.sum(F.when(test, ext)), 2), F.lit(0.0))
    # profit is what the discount leaves over 4.8 %
    sums = _whole(spark, sf_dir).groupBy("isin", period_end.alias("period_end_date")).agg(
        _scaled(F.sum("ext"), 2).alias("e"),
        _double(_scaled(F.sum(ext * (100 - disc)), 4)).alias("revenue"),
        _double(_scaled(F.sum(ext * (disc * 10 - 48)), 5)).alias("pat"),
        _double(_scaled(F.sum(ext * (disc - tax)), 4)).alias("ocf"),
        _double(_scaled(F.sum(ext * tax), 4)).alias("taxed"),
        held(F.col("flag") == "R").alias("total_debt"),
        held(F.col("flag") == "A").alias("cash"),
        held(F.col("qty") >= 2500).alias("contingent_liabilities"),
    )
    e, isin = F.col("e"), F.col("isin")
    return sums.select(
        "isin", "period_end_date", "revenue", "pat", "ocf",
        (F.col("taxed") * 0.5).alias("capex"),
        (F.col("pat") * 1.33).alias("profit_before_tax"),
        F.when(isin % 10 == 0, 0.0).when(isin % 10 != 3, e * 0.01).alias("interest_expense"),
        F.when(isin % 6 == 0, e * 0.07).alias("ebitda"), F.when(isin % 8 == 0, F.col("pat") * 0.8).alias("fcf"),
        (e * 0.02).alias("depreciation"), "total_debt", "cash",
        (e * 0.9).alias("total_equity"), (e * 1.6).alias("total_assets"), (F.col("pat") / 1000).alias("eps"), "contingent_liabilities",
        F.when(isin % 7 == 0, "QUALIFIED").when(isin % 7 == 1, "NOT_STATED").otherwise("UNMODIFIED").alias("auditor_opinion"),
    )


def fundamentals_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (isin, year, basis); public six months after the year's end."""
    rows = _statements(spark, sf_dir, F.make_date(F.year("date"), F.lit(12), F.lit(31))).withColumn("filing_date", F.add_months("period_end_date", 6))
    named = lambda basis, share: F.struct(F.lit(basis).alias("basis"), F.lit(share).alias("share"))
    # some companies file on both bases; the lines are summed once
    bases = F.when(F.col("isin") % 5 == 0, F.array(named("STANDALONE", 1.0))).when(F.col("isin") % 5 == 1, F.array(named("CONSOLIDATED", 1.0), named("STANDALONE", 0.5))).otherwise(F.array(named("CONSOLIDATED", 1.0)))
    return rows.withColumn("_b", F.explode(bases)).withColumn("revenue", F.col("revenue") * F.col("_b.share")).withColumn("basis", F.col("_b.basis")).drop("_b")


def fundamentals_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, period_end_date, filing_date (45 days later), revenue, pat."""
    rows = _statements(spark, sf_dir, F.last_day(F.add_months(F.trunc("date", "quarter"), 2)))
    return rows.select("isin", "period_end_date", F.date_add("period_end_date", 45).alias("filing_date"), "revenue", "pat")


def shareholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, quarter_end, disclosed_date (21 days later), promoter_pct, promoter_pledged_pct (unknown for some)."""
    rows = lines(spark, sf_dir).groupBy("isin", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("quarter_end")).agg(F.count_if(F.col("flag") == "N").alias("n"), F.count_if(F.col("flag") == "R").alias("r"), F.count("*").alias("c"))
    return rows.select("isin", "quarter_end", F.date_add("quarter_end", 21).alias("disclosed_date"), F.round(100.0 * F.col("n") / F.col("c"), 4).alias("promoter_pct"), F.when(F.col("isin") % 9 != 0, F.round(100.0 * F.col("r") / F.col("c"), 4)).alias("promoter_pledged_pct"))


def index_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isin, from_date, to_date (open for most)."""
    rows = lines(spark, sf_dir).groupBy("isin").agg(F.min("date").alias("from_date"), F.max("date").alias("last"))
    return rows.select("isin", "from_date", F.when(F.col("isin") % 7 == 0, F.col("last")).alias("to_date"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, isin, published_at, label, score (signed), confidence."""
    sign = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("news_id"), F.col("user_id").alias("isin"), F.col("ts").alias("published_at"),
        F.when(sign > 0, "positive").when(sign < 0, "negative").otherwise("neutral").alias("label"),
        (sign * F.least(F.lit(1.0), F.abs("value") / 100)).alias("score"),
        (0.5 + (F.col("event_id") % 50) / 100).alias("confidence"),
    )


def news_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``news`` moved into the years that prices cover: an article's number tells how many months back."""
    back = F.col("news_id") % 20 * 30 - 8766
    return news(spark, sf_dir).withColumn("published_at", F.col("published_at") + F.make_dt_interval(days=back.cast("int")))


def month_ends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """as_of: the month ends from first to last."""
    months = F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(F.transform(months, F.last_day)).alias("as_of")).where(F.col("as_of").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def month_ends_of(rows: DataFrame, day: str) -> DataFrame:
    """as_of: the month ends from the first to the last day of ``rows``."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"))  # one row
    months = F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("interval 1 month"))
    return span.select("b", F.explode(F.transform(months, F.last_day)).alias("as_of")).where("as_of <= b").select("as_of")
