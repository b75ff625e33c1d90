"""Readers of raw payloads: filings, shareholding, feeds and statements in XML. Columns in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: date formats that payloads use
DATE_FORMATS = ("dd-MMM-yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")


def any_date(x: Column) -> Column:
    """The first format that reads the text, else NULL."""
    text = F.initcap(F.trim(x))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS))


def first_present(record: Column, names: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.trim(record[n]), F.lit("")) for n in names))


def number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double")


def truth(x: Column) -> Column:
    """True, False or unknown of a word."""
    word = F.lower(F.trim(x))
    return F.when(word.isin("y", "yes", "true", "1", "audited", "consolidated"), True).when(word.isin("n", "no", "false", "0", "un-audited", "unaudited", "non-consolidated", "standalone"), False)


def normalise_prices(raw: DataFrame) -> DataFrame:
    """isin, date, open, high, low, close, adj_close, volume from headers in any case; missing columns are NULL, adj_close falls back to close, rows without a close go."""
    named = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    columns = {"isin": "string", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "adj_close": "double", "volume": "bigint"}
    rows = named.select(*((F.col(c).try_cast(t) if c in named.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))
    return rows.where(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("adj_close", F.coalesce("adj_close", "close"))


def quarterly_results(payloads: DataFrame) -> DataFrame:
    """isin, period_end_date, filing_date, revenue, pat (crore). payloads: isin, body; amounts come in lakh; an impossible broadcast date gives way to 45 days after the period."""
    records = payloads.select("isin", F.explode(F.from_json(F.get_json_object("body", "$.resCmpData"), "array<map<string,string>>")).alias("r"))
    period, told = any_date(first_present(F.col("r"), ["re_to_dt"])), any_date(first_present(F.col("r"), ["re_broadcast_dt", "broadcastDate"]))
    rows = records.select("isin", period.alias("period_end_date"), F.when(told > period, told).otherwise(F.date_add(period, 45)).alias("filing_date"), (number(first_present(F.col("r"), ["re_total_inc", "re_net_sale"])) * 0.01).alias("revenue"), (number(first_present(F.col("r"), ["re_net_profit", "re_con_pro_loss"])) * 0.01).alias("pat"))
    return rows.where("period_end_date is not null")


def filing_index(payloads: DataFrame) -> DataFrame:
    """isin, period_end_date, broadcast_date, relating_to, is_consolidated, is_audited, basis, xbrl_url. payloads: isin, body (a JSON array)."""
    r = F.col("r")
    rows = payloads.select("isin", F.explode(F.from_json("body", "array<map<string,string>>")).alias("r"))
    period, told = any_date(r["toDate"]), any_date(r["broadcastDate"])
    consolidated = truth(r["consolidated"])
    return rows.select(
        "isin", period.alias("period_end_date"), F.when(told > period, told).alias("broadcast_date"), r["relatingTo"].alias("relating_to"), consolidated.alias("is_consolidated"), truth(r["audited"]).alias("is_audited"),
        F.when(consolidated, "CONSOLIDATED").when(~consolidated, "STANDALONE").otherwise("UNKNOWN").alias("basis"), F.when(F.lower(r["xbrl"]).startswith("http"), r["xbrl"]).alias("xbrl_url"),
    ).where("period_end_date is not null")


def shareholding_rows(payloads: DataFrame) -> DataFrame:
    """isin, quarter_end, disclosed_date, promoter_pct, promoter_pledged_pct, public_pct. payloads: isin, body (a list, or an object with one under data); the last of a repeated quarter counts."""
    body = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.get_json_object("body", "$.data"))
    rows = payloads.select("isin", F.posexplode(F.from_json(body, "array<map<string,string>>")).alias("at", "r"))
    r = F.col("r")
    rows = rows.select("isin", "at", any_date(r["date"]).alias("quarter_end"), number(r["pr_and_prgrp"]).alias("promoter_pct"), number(first_present(r, ["pledged"])).alias("promoter_pledged_pct"), number(r["public_val"]).alias("public_pct")).where("quarter_end is not null")
    last = F.row_number().over(Window.partitionBy("isin", "quarter_end").orderBy(F.desc("at")))
    return rows.withColumn("_r", last).where("_r = 1").select("isin", "quarter_end", F.date_add("quarter_end", 21).alias("disclosed_date"), "promoter_pct", "promoter_pledged_pct", "public_pct")


def feed_items(feeds: DataFrame) -> DataFrame:
    """feed, title, link, body, published_at (Indian time) of RSS items and Atom entries with a link and a date. feeds: feed, xml."""
    strip = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    unescape = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^<!\\[CDATA\\[|\\]\\]>$", ""), "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&#39;", "'"), "&amp;", "&")
    field = lambda name: F.nullif(unescape(F.trim(F.regexp_extract("item", f"(?s)<(?:\\w+:)?{name}(?:\\s[^>]*)?>(.*?)</(?:\\w+:)?{name}>", 1))), F.lit(""))
    rows = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit("(?s)<(item|entry)(?:\\s[^>]*)?>.*?</\\1>"), F.lit(0))).alias("item"))
    link = F.coalesce(field("link"), F.nullif(F.regexp_extract("item", '<(?:\\w+:)?link[^>]*href="([^"]+)"', 1), F.lit("")))
    told = F.coalesce(field("pubDate"), field("published"), field("updated"))
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace(told, "^\\w+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(told, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz"))
    return rows.select("feed", strip(field("title")).alias("title"), link.alias("link"), strip(F.coalesce(field("description"), field("summary"), F.lit(""))).alias("body"), local.alias("published_at")).where("link is not null and published_at is not null")
