"""Sources beside parsers: constituent lists, report listings, crawl windows, cached prices, feeds, tagged news, files, catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.sources.parsers import any_date, feed_items, first_present, normalise_prices

#: columns that a constituent list must have, and their names here
CONSTITUENT_COLUMNS = {"ISIN Code": "isin", "Symbol": "nse_symbol", "Company Name": "name"}
#: fixed values: names under which listings give a report's address, years and date
URL_KEYS, TO_YEAR_KEYS, FROM_YEAR_KEYS = ["fileName", "file_name", "attchmntFile", "url"], ["toYr", "to_yr", "toYear", "to_year"], ["fromYr", "from_yr", "fromYear", "from_year"]
DATE_KEYS = ["submissionDate", "broadcastDate", "sm_dt", "dt", "an_dt"]
#: scores beyond which tagged news is positive or negative
LABEL_LIMIT = 0.15


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    return constituents(spark.read.csv(path, header=True))


def constituents(raw: DataFrame) -> DataFrame:
    """isin, nse_symbol, name, industry of companies whose ISIN begins with INE. Headers may have spaces around them; a missing required one fails."""
    named = raw.toDF(*(c.strip() for c in raw.columns))
    missing = [c for c in CONSTITUENT_COLUMNS if c not in named.columns]
    if missing:
        raise ValueError(f"the list lacks {missing}; it has {named.columns}")
    industry = F.col("Industry") if "Industry" in named.columns else F.lit(None).cast("string")
    rows = named.select(*(F.trim(F.col(f"`{c}`").cast("string")).alias(n) for c, n in CONSTITUENT_COLUMNS.items()), industry.alias("industry"))
    return rows.where(F.col("isin").startswith("INE"))


def through_cache(targets: DataFrame, landed: DataFrame, stored: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Prices of targets (isin, start, end): from ``stored`` where the range has landed, else by ``fetch`` (targets -> raw prices with any headers); cached tells which.

    Ranges that landed without a price are not fetched again. A provider's rows must have an
    adjusted close; one without that column fails.
    """
    keys = ["isin", "start", "end"]
    inside = lambda prices, spans: prices.join(spans, "isin").where(F.col("date").between(F.col("start"), F.col("end"))).drop("start", "end")
    known, missing = targets.join(landed.select(*keys), keys, "left_semi"), targets.join(landed.select(*keys), keys, "left_anti")
    fetched = fetch(missing)
    if "adj_close" not in [c.strip().lower().replace(" ", "_") for c in fetched.columns]:
        raise ValueError("the provider gives no adjusted close")
    rows = normalise_prices(fetched)
    return inside(stored, known).select(*rows.columns, F.lit(True).alias("cached")).unionByName(rows.withColumn("cached", F.lit(False)))


def crawl_windows(companies: DataFrame, first: Column, last: Column, days: int = 90) -> DataFrame:
    """isin, window_start, window_end: spans of ``days`` from first to last, the last one cut there."""
    starts = F.when(first <= last, F.sequence(first, last, F.expr(f"interval {days} days")))
    return companies.select("isin", last.alias("_last"), F.explode(starts).alias("window_start")).select("isin", "window_start", F.least(F.date_add("window_start", days - 1), "_last").alias("window_end"))


def annual_reports(listing: DataFrame) -> DataFrame:
    """isin, fiscal_year, period_end, source_url, broadcast_date, broadcast_date_source of reports with an address. listing: isin, r (a map of texts).

    The year is that of the period's end, else the one after its start, else the last number
    in the address that is a year, as a company's number before it may look like one (of an
    address without such, the greatest year inside a number). A date up to the period's end is
    impossible and gives way to six months after it; of several listings of a year the first
    with a date of its own counts.
    """
    year = lambda x: F.nullif(F.regexp_extract(x, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    r, url = F.col("r"), F.col("source_url")
    rows = listing.withColumn("at", F.monotonically_increasing_id()).withColumn("source_url", first_present(r, URL_KEYS)).where(F.lower("source_url").startswith("http"))
    in_url = F.coalesce(F.try_element_at(F.regexp_extract_all(url, F.lit("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), F.lit(0)), F.lit(-1)), F.array_max(F.regexp_extract_all(url, F.lit("(?:19|20)[0-9]{2}"), F.lit(0)))).cast("int")
    rows = rows.withColumn("fiscal_year", F.coalesce(year(first_present(r, TO_YEAR_KEYS)), year(first_present(r, FROM_YEAR_KEYS)) + 1, in_url)).where("fiscal_year is not null")
    rows = rows.withColumn("period_end", F.make_date("fiscal_year", F.lit(3), F.lit(31))).withColumn("told", F.coalesce(*(any_date(r[k]) for k in DATE_KEYS)))
    own = F.col("told") > F.col("period_end")
    rows = rows.withColumn("broadcast_date", F.when(own, F.col("told")).otherwise(F.add_months("period_end", 6))).withColumn("broadcast_date_source", F.when(own, "NSE").otherwise("ASSUMED"))
    best = Window.partitionBy("isin", "fiscal_year").orderBy(F.col("broadcast_date_source") != "NSE", "at")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("isin", "fiscal_year", "period_end", "source_url", "broadcast_date", "broadcast_date_source")


def register_files(files: DataFrame) -> DataFrame:
    """path, sha256, n_bytes, n_pages of files (path, content as Spark's binaryFile source gives them). Pages are a PDF's page objects."""
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("n_bytes"), F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])")).alias("n_pages"))


def ingest_feeds(feeds: DataFrame, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of all feeds, and feed, n: how many each gave, -1 for one that could not be read (xml NULL). feeds: feed, xml."""
    items = feed_items(feeds.where("xml is not null"))
    if since is not None:
        items = items.where(F.col("published_at") >= since)
    counted = items.groupBy("feed").agg(F.count("*").alias("k"))
    status = feeds.select("feed", F.col("xml").isNull().alias("failed")).join(counted, "feed", "left")
    return items, status.select("feed", F.when(F.col("failed"), -1).otherwise(F.coalesce("k", F.lit(0))).cast("long").alias("n"))


def sentiment_label(score: Column) -> Column:
    return F.when(score > LABEL_LIMIT, "positive").when(score < -LABEL_LIMIT, "negative").when(score.isNotNull(), "neutral")


def tagged_news(payloads: DataFrame, instruments: DataFrame) -> DataFrame:
    """url, headline, published_at, isin, score, label of articles whose provider names companies. payloads: body (JSON); instruments: symbol, isin.

    Exchange suffixes are dropped; a company that is not in ``instruments`` is ignored; of
    several mentions of one the first counts. Articles without a headline or time are none.
    """
    entity = "array<struct<symbol:string,sentiment_score:double>>"
    kind = f"array<struct<url:string,title:string,published_at:string,entities:{entity}>>"
    items = payloads.select(F.explode(F.from_json(F.get_json_object("body", "$.data"), kind)).alias("d")).select("d.*")
    items = items.withColumn("headline", F.trim("title")).withColumn("published_at", F.try_to_timestamp("published_at").cast("timestamp_ntz")).where("headline <> '' and published_at is not null")
    named = items.select("url", "headline", "published_at", F.posexplode("entities").alias("at", "e"))
    named = named.withColumn("symbol", F.regexp_replace(F.upper("e.symbol"), r"\.NSE|\.BSE|\.NS|\.BO", "")).join(instruments.select("symbol", "isin"), "symbol")
    first = Window.partitionBy("url", "headline", "published_at", "isin").orderBy("at")
    score = F.col("e.sentiment_score")
    return named.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("url", "headline", "published_at", "isin", score.alias("score"), sentiment_label(score).alias("label"))


def schema_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """table, column, change (MISSING, EXTRA) between two lists of table, column."""
    keys = ["table", "column"]
    return expected.join(found, keys, "left_anti").select(*keys, F.lit("MISSING").alias("change")).unionByName(found.join(expected, keys, "left_anti").select(*keys, F.lit("EXTRA").alias("change")))


def catalog_columns(spark: SparkSession) -> DataFrame:
    """table, column of the session's tables and views."""
    rows = [(t.name, c.name) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string")


def derived(rows: DataFrame) -> DataFrame:
    """A statement's rows with profit from the group's where no other is told, debt as the sum of its two parts (an untold part is 0), and liabilities as what equity leaves."""
    c = F.col
    debt = F.when(c("borrowings_current").isNotNull() | c("borrowings_noncurrent").isNotNull(), F.coalesce("borrowings_current", F.lit(0.0)) + F.coalesce("borrowings_noncurrent", F.lit(0.0)))
    return rows.withColumn("pat", F.coalesce("pat", "profit_for_period")).withColumn("total_debt", debt).withColumn("total_liabilities", c("equity_and_liabilities") - c("total_equity"))
