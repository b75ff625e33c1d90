"""Registered queries for sources, sinks, reviews, reports and texts. Payloads are made from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import scalar as C
from factorloom.operators import backtest as B
from factorloom.operators import factors as V
from factorloom.operators import news as N
from factorloom.operators import point_in_time as P
from factorloom.operators import reports as O
from factorloom.operators import review as W
from factorloom.operators import scoring as X
from factorloom.operators import serving as R
from factorloom.operators import statements as E
from factorloom.plans.registry import LAST, MINIMA, Model, backtest_curve, query
from factorloom.sources import adapters as S
from factorloom.sources import listings as L
from factorloom.sources import parsers as Z
from factorloom.sources import sinks as K
from factorloom.sources import xbrl as H
from factorloom.sources.store import KeyedTable, work_folder, written

text = lambda c: F.col(c).cast("string")
key = lambda n: F.col("isin") % n
date = lambda x: F.lit(x).cast("date")


@query
def s2_constituents(spark, sf_dir):
    s = S.read(spark, sf_dir, "supplier")
    isin = F.concat(F.when(F.col("s_suppkey") % 4 == 0, " IN0").otherwise(" INE"), F.lpad(text("s_suppkey"), 9, "0"), F.lit(" "))
    return L.constituents(s.select(isin.alias(" ISIN Code "), F.concat(F.lit("S"), text("s_suppkey"), F.lit(" ")).alias("Symbol"), F.col("s_name").alias("Company Name "), text("s_nationkey").alias("Industry")))


@query
def s4_normalise_ohlcv(spark, sf_dir):
    p = S.prices_daily(spark, sf_dir)
    raw = p.select(text("isin").alias("ISIN"), F.col("date").alias("Date"), F.when(key(7) != 0, F.col("adj_close") * 2).alias("Close "), F.when(key(3) != 0, F.col("adj_close")).alias("Adj Close"), F.col("volume").alias("VOLUME"))
    return Z.normalise_prices(raw).select("isin", "date", "open", "close", "adj_close", "volume")


@query
def s5_cached_prices(spark, sf_dir):
    """All prices: even companies' have landed, the others' are fetched."""
    p = S.prices_daily(spark, sf_dir).select(text("isin").alias("isin"), "date", F.col("adj_close").alias("close"), "adj_close", "volume")
    targets = S.instruments(spark, sf_dir).select(F.col("isin").alias("k"), text("isin").alias("isin"), date("1990-01-01").alias("start"), date("2009-12-31").alias("end"))
    stored = p.where("cast(isin AS bigint) % 2 = 0").select("isin", "date", F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"), "close", "adj_close", "volume")
    fetch = lambda missing: p.join(missing, "isin").where(F.col("date").between(F.col("start"), F.col("end"))).select(p.columns)
    got = L.through_cache(targets.drop("k"), targets.where("k % 2 = 0"), stored, fetch)
    return got.groupBy("isin", "cached").agg(F.count("*").alias("n"), F.avg("adj_close").alias("mean_close"))


@query
def s6_quarterly_json(spark, sf_dir):
    q = S.fundamentals_quarterly(spark, sf_dir).where("isin % 5 <> 0")
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    told = F.when(key(4) == 0, day(F.date_sub("period_end_date", 3))).otherwise(day(F.date_add("period_end_date", 20)))
    money = lambda c: F.format_number(F.floor(F.col(c)), 0)
    body = F.concat(F.lit('{"resCmpData":['), F.to_json(F.struct(day(F.col("period_end_date")).alias("re_to_dt"), told.alias("re_broadcast_dt"), money("revenue").alias("re_total_inc"), money("pat").alias("re_net_profit"))), F.lit("]}"))
    return Z.quarterly_results(q.select("isin", body.alias("body")))


@query
def s7_filing_index(spark, sf_dir):
    q = S.fundamentals_quarterly(spark, sf_dir)
    day = lambda c: F.date_format(c, "dd-MMM-yyyy")
    record = F.struct(
        day(F.col("period_end_date")).alias("toDate"), F.when(key(4) == 0, day(F.date_sub("period_end_date", 1))).otherwise(day(F.date_add("period_end_date", 30))).alias("broadcastDate"), F.lit("Quarterly").alias("relatingTo"),
        F.when(key(3) == 0, "Consolidated").when(key(3) == 1, "Non-Consolidated").otherwise("-").alias("consolidated"), F.when(key(2) == 0, "Audited").otherwise("Un-Audited").alias("audited"), F.when(key(6) != 0, F.concat(F.lit("https://x/"), text("isin"), F.lit(".xml"))).otherwise("-").alias("xbrl"),
    )
    return Z.filing_index(q.select("isin", F.to_json(F.array(record)).alias("body")))


@query
def s8_crawl_windows(spark, sf_dir):
    p = S.prices_daily(spark, sf_dir).groupBy("isin").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return L.crawl_windows(p, F.col("a"), F.col("b"))


@query
def s9_shareholding_json(spark, sf_dir):
    h = S.shareholding(spark, sf_dir)
    record = F.to_json(F.array(F.struct(F.date_format("quarter_end", "dd-MMM-yyyy").alias("date"), text("promoter_pct").alias("pr_and_prgrp"), text("promoter_pledged_pct").alias("pledged"))))
    return Z.shareholding_rows(h.select("isin", F.when(key(2) == 0, record).otherwise(F.concat(F.lit('{"data":'), record, F.lit("}"))).alias("body"))).select("isin", "quarter_end", "disclosed_date", "promoter_pct", "promoter_pledged_pct")


@query
def s10_annual_reports(spark, sf_dir):
    i = S.instruments(spark, sf_dir)
    y = (2001 + key(5)).cast("string")
    before = (2000 + key(5)).cast("string")
    url = F.concat(F.when(key(11) == 0, "ftp").otherwise("https"), F.lit("://x/AR_"), text("isin"), F.lit("_"), before, F.lit("_"), y, F.lit("_.pdf"))
    none = F.lit(None).cast("string")
    r = lambda told: F.create_map(F.lit("fileName"), url, F.lit("toYr"), F.when(key(3) == 0, y), F.lit("fromYr"), F.when(key(3) == 1, before), F.lit("broadcastDate"), told)
    told = F.when(key(4) == 0, F.concat(F.lit("15-Jul-"), y)).when(key(4) == 1, F.concat(F.lit("01-Jan-"), y))
    return L.annual_reports(i.select("isin", r(none).alias("r")).unionByName(i.select("isin", r(told).alias("r")))).drop("source_url")


@query
def s11_registered_files(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents")
    content = F.encode(F.concat("text", F.expr("repeat('/Type /Page ', cast(doc_id % 3 AS int))")), "UTF-8")
    return L.register_files(d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


def _instances(a):
    """Annual statements as XBRL: several prefixes, comments, CDATA, nil and dimensional facts. Companies with even numbers declare a quarter for their year, and state the year.

    a: doc_id, isin, period_end_date, starts (of the year), revenue, pat, total_assets, ocf, capex.
    """
    end, c, day = F.col("period_end_date"), F.col, lambda x: x.cast("string")
    prefix = F.when(key(3) == 0, "in:").when(key(3) == 1, "ind-as:").otherwise("")
    context = lambda name, start, end, inside="": F.concat(F.lit(f'<xbrli:context id="{name}"><xbrli:entity><xbrli:identifier scheme="x">E</xbrli:identifier>{inside}</xbrli:entity><xbrli:period><xbrli:startDate>'), day(start), F.lit("</xbrli:startDate><xbrli:endDate>"), day(end), F.lit("</xbrli:endDate></xbrli:period></xbrli:context>"))

    def fact(element, where, value, body=None):
        shown = F.abs(value).cast("string") if body is None else body
        return F.concat(F.lit("<"), prefix, F.lit(f'{element} contextRef="{where}" unitRef="INR" decimals="-5"'), F.when(value < 0, ' sign="-"').otherwise(""), F.lit(">"), shown, F.lit("</"), prefix, F.lit(f"{element}>"))

    quarter = F.add_months(F.date_add(end, 1), -3)
    stated = lambda where, start: F.concat(*(F.concat(F.lit("<"), prefix, F.lit(f'{e} contextRef="{where}">'), day(d), F.lit("</"), prefix, F.lit(f"{e}>")) for e, d in (("DateOfStartOfReportingPeriod", start), ("DateOfEndOfReportingPeriod", end))))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><!-- results --><xbrli:xbrl xmlns:xbrli="http://i" xmlns:in="http://a" xmlns:ind-as="http://b" xmlns:xbrldi="http://d" xmlns:xsi="http://s">'),
        context("FourD", F.when(key(2) == 0, quarter).otherwise(c("starts")), end), context("OneD", quarter, end),
        context("D", c("starts"), end, '<xbrli:segment><xbrldi:explicitMember dimension="a">m</xbrldi:explicitMember></xbrli:segment>'),
        F.lit('<xbrli:context id="OneI"><xbrli:period><xbrli:instant> '), day(end), F.lit(" </xbrli:instant></xbrli:period></xbrli:context>"),
        F.when(key(2) == 0, F.concat(stated("FourD", c("starts")), stated("OneD", quarter))).otherwise(""),
        fact("RevenueFromOperations", "FourD", c("revenue")), fact("RevenueFromOperations", "OneD", c("revenue") / 4), fact("RevenueFromOperations", "D", c("revenue") * 9),
        fact("ProfitLossForPeriod", "FourD", c("pat"), F.concat(F.lit("<![CDATA["), F.abs("pat").cast("string"), F.lit("]]>"))), fact("Assets", "OneI", c("total_assets")),
        fact("CashFlowsFromUsedInOperatingActivities", "FourD", c("ocf")), fact("OtherThing", "FourD", c("capex")),
        F.lit('<in:TaxExpense contextRef="FourD" xsi:nil="true"/><!-- the end --><in:DeclarationOfUnmodifiedOpinionOrStatementOnImpactOfAuditQualification contextRef="OneD">'),
        F.when(key(4) == 0, "Statement on audit qualification").otherwise("Unmodified opinion"), F.lit("</in:DeclarationOfUnmodifiedOpinionOrStatementOnImpactOfAuditQualification></xbrli:xbrl>"),
    )
    return a.withColumn("xml", xml)


def _consolidated(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir).where("basis = 'CONSOLIDATED'")
    return _instances(a.withColumn("doc_id", F.col("isin") * 10_000 + F.year("period_end_date")).withColumn("starts", F.trunc("period_end_date", "year"))).select("doc_id", "xml")


@query
def s12_quarterly_xbrl(spark, sf_dir):
    return H.quarter_values(H.facts(_consolidated(spark, sf_dir))).select("doc_id", "field", "value", "start", F.col("end").alias("finish"))


@query
def s13_annual_xbrl(spark, sf_dir):
    documents = written(_consolidated(spark, sf_dir))
    return H.annual_statements(documents, written(H.facts(documents))).where("reason IS NULL").select("doc_id", "period_start", "period_end", "revenue", "pat", "total_assets", "tax_expense", "opinion_note")


@query
def s14_derivations(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir)
    raw = a.select("isin", "period_end_date", "basis", F.when(key(5) != 2, F.col("pat")).alias("pat"), (F.col("pat") * 1.1).alias("profit_for_period"), F.when(key(3) != 0, F.col("total_debt") * 0.4).alias("borrowings_current"), F.when(key(2) != 0, F.col("total_debt") * 0.6).alias("borrowings_noncurrent"), F.col("total_assets").alias("equity_and_liabilities"), "total_equity")
    return L.derived(raw).select("isin", "period_end_date", "basis", "pat", "total_debt", "total_liabilities")


@query
def s15_unmapped_elements(spark, sf_dir):
    return H.unmapped(H.facts(_consolidated(spark, sf_dir)))


@query
def e6_xbrl_ingest(spark, sf_dir):
    """Filings of every company, read in two runs: what was stored or refused is not read again.

    By (company + year) % 7, an instance is cut short (1), spans half a year (2), has no
    instant (3), no revenue (4) or no contexts (5). The basis of every fifth company is not told.
    """
    a = S.fundamentals_annual(spark, sf_dir).withColumn("fiscal_year", F.year("period_end_date")).withColumn("doc_id", F.concat_ws("-", "isin", "fiscal_year", "basis"))
    kind = (F.col("isin") + F.col("fiscal_year")) % 7
    whole = _instances(a.withColumn("starts", F.when(kind == 2, F.add_months(F.date_add("period_end_date", 1), -6)).otherwise(F.trunc("period_end_date", "year"))))
    without = lambda pattern: F.regexp_replace("xml", pattern, "")
    xml = F.when(kind == 1, F.col("xml").substr(F.lit(1), F.length("xml") - 30)).when(kind == 3, without('<xbrli:context id="OneI">.*?</xbrli:context>')).when(kind == 4, without("<[a-z:-]*RevenueFromOperations[^>]*>[^<]*</[^>]*>")).when(kind == 5, without("<xbrli:context .*</xbrli:context>")).otherwise(F.col("xml"))
    documents = written(whole.select("doc_id", xml.alias("xml")))
    refs = a.select("doc_id", "isin", "fiscal_year", F.when(key(5) != 0, F.col("basis") == "CONSOLIDATED").alias("is_consolidated"), F.col("period_end_date").alias("period_end"), F.when(key(3) != 0, F.col("filing_date")).alias("broadcast_date"))
    keys, folder = ["isin", "fiscal_year", "basis"], work_folder(spark)
    stored, refused = KeyedTable(spark, f"{folder}/annual", keys), KeyedTable(spark, f"{folder}/attempts", keys)
    none = spark.createDataFrame([], "isin bigint, fiscal_year int, basis string")
    for run, until in ((1, 1997), (2, 9999)):
        pending = H.pending_annual(refs.where(F.col("fiscal_year") <= until), stored.read() if run > 1 else none, refused.read() if run > 1 else none).withColumn("run", F.lit(run))
        taken = documents.join(pending.select("doc_id"), "doc_id")
        H.facts(taken).write.parquet(f"{folder}/facts-{run}")  # read once
        H.annual_statements(taken, spark.read.parquet(f"{folder}/facts-{run}")).write.parquet(f"{folder}/judged-{run}")
        judged = pending.join(spark.read.parquet(f"{folder}/judged-{run}"), "doc_id")
        told = ["period_start", "revenue", "pat", "total_assets", W.audit_opinion(F.col("opinion_note")).alias("auditor_opinion")]
        stored.upsert(judged.where("reason IS NULL").select(*keys, F.col("broadcast_date").alias("filing_date"), *told, "run"))
        refused.upsert(judged.where("reason IS NOT NULL").select(*keys, "reason", "run"))
    return stored.read().unionByName(refused.read(), allowMissingColumns=True)


def _feeds(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("feed-"), (F.col("doc_id") % 97).cast("string")).alias("feed"))
    n = (F.col("doc_id") % 28 + 1).cast("string")
    item = F.concat(F.lit("<item><title>Story &amp; "), text("doc_id"), F.lit("</title><link>http://x/"), text("doc_id"), F.lit("</link><description>&lt;b&gt;body&lt;/b&gt; of it</description><pubDate>Mon, "), n, F.lit(" Jan 2024 20:30:00 +0000</pubDate></item>"))
    feeds = d.groupBy("feed").agg(F.array_join(F.collect_list(item), "").alias("x"))
    return feeds.select("feed", F.when(~F.col("feed").endswith("7"), F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>"))).alias("xml"))


@query
def s16_feed_items(spark, sf_dir):
    return Z.feed_items(_feeds(spark, sf_dir).where("xml is not null"))


@query
def s17_feed_status(spark, sf_dir):
    return L.ingest_feeds(_feeds(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz"))[1]


@query
def s19_tagged_news(spark, sf_dir):
    """Orders as articles, their lines' suppliers as companies that a provider tags."""
    line = S.read(spark, sf_dir, "lineitem")
    entity = F.struct(F.concat(F.lit("s"), text("l_suppkey"), F.when(F.col("l_linenumber") % 2 == 0, ".NSE").otherwise(".bo")).alias("symbol"), F.round(F.col("l_discount") * 10 - 0.5, 2).alias("sentiment_score"), F.col("l_linenumber").alias("n"))
    orders = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", entity.alias("e")))).alias("es"))
    item = F.struct(F.concat(F.lit("http://x/"), text("l_orderkey")).alias("url"), F.when(F.col("l_orderkey") % 10 != 0, F.concat(F.lit("Order "), text("l_orderkey"))).otherwise(" ").alias("title"), F.lit("2024-01-05T10:00:00").alias("published_at"), F.transform("es", lambda x: x["e"]).alias("entities"))
    known = S.instruments(spark, sf_dir).where("isin % 5 <> 0")
    return L.tagged_news(orders.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("body")), known).select("url", "headline", "isin", "score", "label")


@query
def k2_backfilled_membership(spark, sf_dir):
    m = S.index_membership(spark, sf_dir).withColumn("index_name", F.when(key(2) == 0, "A").otherwise("B"))
    return K.backfill_start(m, "a", date("1992-01-15"))


@query
def k4_last_record(spark, sf_dir):
    line = S.read(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc(F.to_date("l_shipdate"), "month").alias("period"), "l_returnflag", "l_orderkey", "l_linenumber")
    return K.last_of_each(line, ["l_suppkey", "period", "l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query
def k8_positions(spark, sf_dir):
    m = Model(spark, sf_dir)
    weights = B.top_n(m.momentum_z(), "z", 20)
    empty = spark.range(0).select(F.lit(0.0).alias("cagr"))
    curve = spark.range(0).select(date("2000-01-31").alias("date"), F.lit(1.0).alias("nav"), F.lit(1.0).alias("gross_nav"), F.lit(0.0).alias("costs"))
    return K.backtest_tables({"top": 20, "factor": "momentum_12_1"}, curve, weights, empty)["positions"]


@query
def k9_export(spark, sf_dir):
    return K.export_rows(X.flag_summary(Model(spark, sf_dir).flags())).select("as_of", "isin", "red_flags")


@query
def k10_loaded_history(spark, sf_dir):
    m = S.index_membership(spark, sf_dir).select(F.lit("X").alias("index_name"), "isin", "from_date", F.lit(None).cast("date").alias("to_date"))
    history = S.index_membership(spark, sf_dir).where("isin % 3 = 0").select("isin", "from_date", F.date_add("from_date", 100).alias("to_date"))
    coverage = spark.createDataFrame([], "index_name string, verified_from date, verified_to date, source string")
    rows, covered = K.load_history(m, coverage, "x", history, date("1992-01-01"), date("2000-12-31"), "list")
    return rows.join(covered, "index_name")


def _reviews(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_custkey") % 150).alias("isin"), F.when(F.col("o_orderstatus") == "F", "PENDING").when(F.col("o_orderstatus") == "O", "ACCEPTED").otherwise("REJECTED").alias("status"), (F.col("o_orderkey") % 4 * 0.3).alias("confidence"), F.to_date("o_orderdate").alias("queued_at"), F.lit(None).cast("string").alias("notes"))


@query
def k11_decided_reviews(spark, sf_dir):
    reviews = _reviews(spark, sf_dir)
    stored = reviews.where("confidence >= 0.6").select("attempt_id", (F.col("attempt_id") * 2).alias("fy"), F.lit(1.0).alias("revenue"))
    attempts = reviews.select("attempt_id", (F.col("attempt_id") * 2).alias("fy"), F.lit(2.0).alias("revenue"))
    decisions = reviews.where("status = 'PENDING'").select("attempt_id", F.when(F.col("attempt_id") % 3 == 0, "rejected").otherwise("Accepted").alias("status"), F.lit("seen").alias("notes"), (F.col("attempt_id") % 2 == 0).alias("force"))
    after, kept = K.decide(reviews, stored, decisions, attempts, ["fy"])
    return after.select("attempt_id", "status", "notes").join(kept.select("attempt_id", "revenue"), "attempt_id", "left")


@query
def k12_json_safe(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    ratio = F.log(F.col("p_size").cast("double") - 25) / 0.5
    return p.select("p_partkey", C.no_nan(F.when(F.col("p_size") % 7 == 0, float("nan")).when(F.col("p_size") % 5 == 0, float("inf")).otherwise(F.when(F.col("p_size") > 25, ratio))).alias("x"))


@query
def p13_promoter_trend(spark, sf_dir):
    m = Model(spark, sf_dir)
    grid = m.instruments.select("isin", date(LAST).alias("as_of"))
    return P.latest_known(grid, m.holding, "disclosed_date", [P.newest("quarter_end")], 8).select("isin", "quarter_end", "promoter_pct")


@query
def f2_names_ignoring_case(spark, sf_dir):
    return R.by_symbol(S.instruments(spark, sf_dir), "s7").unionByName(R.by_symbol(S.instruments(spark, sf_dir), "S8")).select("isin", "symbol")


@query
def f3_predicates(spark, sf_dir):
    """Pages' addresses: LIKE, IN, not empty, not NULL."""
    p = S.read(spark, sf_dir, "pages")
    last = F.element_at(F.split("url", "/"), 4)
    return p.where(F.col("url").like("https://%.com/%") & F.col("url").isNotNull() & (F.col("url") != "") & last.isin("en", "fr")).select("page_id", "url")


@query
def f4_search(spark, sf_dir):
    return R.search(S.instruments(spark, sf_dir), "ER#00000000").select("isin", "symbol", "name")


@query
def j10_rows_of_each(spark, sf_dir):
    """How many returned lines each order has, 0 where none."""
    o, line = S.read(spark, sf_dir, "orders").select("o_orderkey"), S.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return R.counted(o, line.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "n")


@query
def j11_at_the_latest(spark, sf_dir):
    m = Model(spark, sf_dir)
    return R.at_latest(m.momentum_z(), "as_of").select("as_of", "isin", "z")


@query
def a1_store_status(spark, sf_dir):
    m = Model(spark, sf_dir)
    return O.store_status({"prices": (m.prices, "date"), "annual": (m.annual, "filing_date"), "quarterly": (m.quarterly, "filing_date"), "holding": (m.holding, "disclosed_date")})


@query
def a5_any_value(spark, sf_dir):
    """Any customer of an order's lines is the same one; the least, so that it is always the same."""
    o = S.read(spark, sf_dir, "orders").join(S.read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy("o_orderkey").agg(F.min("o_custkey").alias("custkey"), F.count("*").alias("n"))


@query
def a20_median_ratio(spark, sf_dir):
    """The median month's share of named news among all."""
    n = S.news(spark, sf_dir)
    months = n.groupBy(F.trunc(F.to_date("published_at"), "month").alias("m"), (F.col("isin") % 10).alias("k")).agg((F.count_if(F.col("confidence") >= 0.7) / F.count("*")).alias("r"))
    return months.groupBy("k").agg(F.median("r").alias("median_ratio"))


@query
def t2_lowest_n(spark, sf_dir):
    """The ten least indebted companies of each date: less is better."""
    m = Model(spark, sf_dir)
    raw = V.long_form(V.panel(m.grid(), m.prices, m.annual), {"debt_to_equity": V.value_quality_columns()["debt_to_equity"]})
    return B.top_n(raw, "raw", 10, higher=False)


@query
def t3_top_and_bottom(spark, sf_dir):
    return O.top_and_bottom(Model(spark, sf_dir).momentum_z(), "z", 5)


@query
def t5_stored_signal(spark, sf_dir):
    m = Model(spark, sf_dir)
    asked = m.instruments.select("isin", date("2000-07-15").alias("as_of"))
    stored = m.momentum_z().select("isin", F.col("as_of").alias("made"), "z")
    return P.latest_known(asked, stored, "made", [P.newest("made")]).select("isin", "made", "z")


@query
def e11_review_queue(spark, sf_dir):
    """The first fifty extractions that wait (a queue of fifty)."""
    return W.review_queue(_reviews(spark, sf_dir), S.instruments(spark, sf_dir)).select("attempt_id", "isin", "symbol", "confidence", "queued_at")


@query
def e11_review_summary(spark, sf_dir):
    return W.review_summary(_reviews(spark, sf_dir))


@query
def e11_review_detail(spark, sf_dir):
    a = S.fundamentals_annual(spark, sf_dir).where("basis = 'CONSOLIDATED'")
    attempts = a.select("isin", (F.col("isin") * 10 + F.year("period_end_date") % 10).alias("filing_id"), F.to_json(F.struct(F.floor("revenue").alias("revenue"), F.lit("CRORE").alias("unit"))).alias("payload_json"))
    filings = a.select((F.col("isin") * 10 + F.year("period_end_date") % 10).alias("filing_id"), "filing_date")
    return W.review_detail(attempts, filings, S.instruments(spark, sf_dir), "revenue bigint, unit string").select("filing_id", "symbol", "filing_date", "payload.revenue", "payload.unit")


@query
def e4_routing(spark, sf_dir):
    rows = _reviews(spark, sf_dir).withColumn("confidence", F.round("confidence", 1))
    every, stored, review = E.route(rows)
    where = lambda rows, name: rows.select("attempt_id", F.lit(True).alias(name))
    told = every.select("attempt_id", "status").join(where(stored, "stored"), "attempt_id", "left").join(where(review, "review"), "attempt_id", "left")
    return told.select("attempt_id", "status", F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("review", F.lit(False)).alias("review"))


@query
def e6_annual_filings(spark, sf_dir):
    """One filing of each company-year, with the rows to store and what is refused."""
    a = S.fundamentals_annual(spark, sf_dir)
    refs = a.select("isin", F.year("period_end_date").alias("fiscal_year"), (F.col("basis") == "CONSOLIDATED").alias("is_consolidated"), "period_end_date", F.col("period_end_date").alias("period_end"), F.col("filing_date").alias("broadcast_date"), "basis", F.concat_ws("-", "isin", "period_end_date", "basis").alias("filing_id"))
    facts = a.select(F.concat_ws("-", "isin", "period_end_date", "basis").alias("filing_id"), "revenue", F.when(key(6) != 0, F.col("pat")).alias("pat"), "ocf", F.when(key(4) != 0, F.col("capex")).alias("capex"), F.when(key(3) == 0, "Unmodified opinion").when(key(3) == 1, "Qualified ").alias("opinion_note"))
    rows, refused = W.annual_rows(W.annual_filings(refs).drop("period_end"), facts, ["revenue", "pat"])
    got = rows.select("isin", "fiscal_year", "basis", "fcf", "auditor_opinion", F.lit(None).cast("string").alias("reason"))
    return got.unionByName(refused.select("isin", "fiscal_year", "reason"), allowMissingColumns=True)


@query
def e8_page_budget(spark, sf_dir):
    """Documents of a source and language as pages of one text, 20,000 characters together; the page that passes them is cut there, however little of it is left."""
    d = S.read(spark, sf_dir, "documents").where("text is not null").select(F.concat_ws("-", "source", "lang").alias("doc"), F.col("doc_id").alias("page"), "text")
    return W.within_budget(d, "doc", "page", "text", 20_000, least=0).select("doc", "page", F.length("text").cast("long").alias("n_chars"))


@query
def e10_model_rates(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    check = lambda name, passed, skipped: F.struct(F.lit(name).alias("name"), passed.alias("passed"), skipped.alias("skipped"))
    k = F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), (k % 7 != 0).alias("ok"), F.when(k % 5 != 0, F.round(k % 4 * 0.35, 2)).alias("confidence"), F.array(check("nse_cross_check_revenue", k % 2 == 0, k % 3 == 0), check("eps_sign", k % 2 == 1, F.lit(False))).alias("checks"), F.lit(0.5).alias("cost"), (k % 9).cast("double").alias("seconds"))
    return W.bakeoff_rates(rows)


@query
def e12_narrative_inputs(spark, sf_dir):
    m = Model(spark, sf_dir)
    z, flags = written(X.factor_z(m.raw())), written(X.flag_summary(m.flags()))
    scores = X.signals(X.composite(X.family_scores(z)), flags.select("as_of", "isin", "n_flags"))
    return W.narrative_inputs(scores, O.drivers(z), flags)


@query
def c16_page_scores(spark, sf_dir):
    """Documents as pages, with headings of statements put on some."""
    d = S.read(spark, sf_dir, "documents").where("text is not null")
    head = F.when(F.col("doc_id") % 5 == 0, "Consolidated Balance  Sheet ").when(F.col("doc_id") % 5 == 1, "Chairman's Letter, with the Cash Flow Statement ").when(F.col("doc_id") % 5 == 2, F.expr("repeat('1,234.5 (67) x ', 400)")).otherwise("")
    return W.score_pages(d.select("doc_id", F.concat(head, "text").alias("text"))).select("doc_id", "score", F.array_join("anchors", ";").alias("anchors"))


@query
def c4_legal_names(spark, sf_dir):
    s = S.read(spark, sf_dir, "supplier")
    end = F.element_at(F.array(*map(F.lit, (" Ltd.", " Company Limited", " Corporation", " Pvt. Ltd", " & Co. Inc", ""))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select("s_suppkey", C.strip_legal_suffix(C.normalise_text(F.concat(F.lit("The "), F.col("s_name"), end))).alias("name"))


@query
def c5_article_ids(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").where("text is not null")
    at = F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" http://x/"), text("doc_id"))).otherwise(" ")
    article = C.article_id(url, F.col("text"), at)
    return d.select("doc_id", article.alias("article_id"), C.news_id(article, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("news_id"))


@query
def c6_indian_time(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", C.ist_from_utc(F.col("ts")).alias("local"))


@query
def c13_amounts_in_crore(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, C.UNITS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", C.to_crore(F.col("o_totalprice").cast("double"), unit).alias("crore"))


@query
def c14_config_version(spark, sf_dir):
    """The version of each order's settings, as ``run_id`` names a configuration."""
    o = S.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 5).alias("top_n"))
    return K.run_ids(o, ["priority", "status", "top_n"], "version").select("o_orderkey", "version")


@query
def c17_scoring_text(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").where("text is not null")
    head = F.concat(F.lit(" "), "source", F.lit(" in "), "lang")
    body = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, F.lit("  ")).when(F.col("doc_id") % 4 == 2, head).otherwise(F.col("text"))
    return d.select("doc_id", N.scoring_text(head, body).alias("said"))


@query
def c18_shown(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("double")
    return p.select("p_partkey", C.ordinal(n).alias("place"), C.duration(F.when(F.col("p_partkey") % 50 != 0, n * 7)).alias("took"), C.crore_text(F.when(F.col("p_partkey") % 9 != 0, n * 25 / 4)).alias("amount"))


@query
def c19_json(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    body = F.to_json(F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.array("o_custkey", "o_orderkey").alias("keys")).alias("inner")))
    got = lambda path: F.get_json_object("body", path)
    return o.select(body.alias("body")).select(got("$.inner.status").alias("status"), got("$.o_orderkey").cast("bigint").alias("k"), got("$.inner.keys[0]").cast("bigint").alias("first_key"))


@query
def c21_token_costs(spark, sf_dir):
    o = S.read(spark, sf_dir, "orders")
    usage = o.select("o_orderkey", F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("model"), F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") * 100).alias("input"), F.col("o_custkey").alias("output"), (F.col("o_orderkey") % 10 * 50).alias("cache_write"), (F.col("o_orderkey") % 7 * 90).alias("cache_read"), (F.col("o_orderkey") % 3 == 0).alias("batch"))
    rates = spark.createDataFrame([("m0", "1990-01-01", 3.0, 15.0), ("m0", "1995-06-01", 2.0, 10.0), ("m1", "1994-01-01", 0.5, 4.0)], "model string, since string, input_rate double, output_rate double").withColumn("since", F.to_date("since"))
    return R.token_costs(usage, rates).select("o_orderkey", "cost")


@query
def c22_local_names(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    return p.select("p_partkey", C.local_name(F.concat(F.when(F.col("p_partkey") % 2 == 0, "{http://x/y}").otherwise(""), F.col("p_brand"))).alias("name"))


@query
def x14_factor_rows(spark, sf_dir):
    m = Model(spark, sf_dir)
    return O.factor_rows(X.factor_z(V.momentum(m.grid(), m.prices, **MINIMA)), X.family_scores(X.factor_z(V.momentum(m.grid(), m.prices, **MINIMA)))).select("as_of", "isin", "family", "factor", "z", "share")


@query
def x14_drivers(spark, sf_dir):
    m = Model(spark, sf_dir)
    return O.drivers(X.factor_z(V.momentum(m.grid(), m.prices, **MINIMA)))


@query
def x15_stale(spark, sf_dir):
    m = Model(spark, sf_dir)
    scores = m.grid().select("as_of", "isin", F.when(F.col("as_of") < date("2000-01-01"), "v1").otherwise("v2").alias("version"))
    return O.stale(scores, "v2")


def _visible(m: Model, facts, known: str, last: str):
    met = m.grid().select("as_of", "isin").join(facts, "isin").where(F.col(known) <= F.col("as_of"))
    return met.groupBy("as_of", "isin").agg(F.count("*").alias("n"), F.max(last).alias("last"))


def statuses(m: Model):
    grid = m.grid()
    months = F.sequence(F.trunc(F.date_sub("as_of", 400), "month"), F.trunc("as_of", "month"), F.expr("interval 1 month"))
    met = grid.select("as_of", "isin").withColumn("month", F.explode(months)).join(m.prices.withColumn("month", F.trunc("date", "month")), ["isin", "month"]).where(F.col("date").between(F.date_sub("as_of", 400), F.col("as_of")))
    prices = met.groupBy("as_of", "isin").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    quarterly = P.latest_known(grid, m.quarterly, "filing_date", [P.newest("period_end_date")], 8).groupBy("as_of", "isin").agg(F.count("*").alias("n"), F.max("period_end_date").alias("last"))
    annual = P.newest_of_basis(grid, m.annual, 5).groupBy("as_of", "isin").agg(F.count("*").alias("n"))
    holding = P.latest_known(grid, m.holding, "disclosed_date", [P.newest("quarter_end")], 6).groupBy("as_of", "isin").agg(F.count("*").alias("n"), F.max("quarter_end").alias("last"))
    near = P.sentiment_window(grid, S.news_history(m.spark, m.dir), confidence=0.0).groupBy("as_of", "isin").agg(F.count_if(F.col("confidence") >= 0.7).alias("n"), F.count("*").alias("total"))
    return O.dataset_status(grid, prices, annual, quarterly, holding, near)


@query
def x16_dataset_status(spark, sf_dir):
    return statuses(Model(spark, sf_dir))


def diagnosed(m: Model):
    """Why momentum, sentiment, coverage and growth are missing."""
    grid = m.grid()
    newest = P.newest_of_basis(grid, m.annual, 1).select("as_of", "isin", "revenue", "pat", "ocf", "capex", "profit_before_tax", "interest_expense", "depreciation", "total_debt", "total_equity", "total_assets", "eps")
    raw = m.raw().where(F.col("factor").isin("momentum_12_1", "news_sentiment_30d", "interest_coverage", "quarterly_pat_yoy", "revenue_cagr_3y"))
    return O.diagnosis(raw, statuses(m), newest)


@query
def x17_diagnosis(spark, sf_dir):
    return diagnosed(Model(spark, sf_dir))


ITEMS = ("revenue", "pat", "ocf", "capex", "profit_before_tax", "interest_expense", "ebitda", "fcf", "depreciation", "total_debt", "cash", "total_equity", "total_assets", "eps", "contingent_liabilities")


@query
def x18_statement_items(spark, sf_dir):
    """Every item of every company by year."""
    a = S.fundamentals_annual(spark, sf_dir).where("basis = 'CONSOLIDATED'")
    return E.statement_frame(a, ["isin"], list(ITEMS), [1997, 1998, 1999, 2000])


@query
def b2_rebalances(spark, sf_dir):
    m = Model(spark, sf_dir)
    return O.rebalances(m.grid(), m.momentum_z().where("z is not null"), m.dates)


@query
def b8_comparison(spark, sf_dir):
    m = Model(spark, sf_dir)
    return O.comparison(B.metrics(backtest_curve(m)).drop("avg_turnover", "total_costs_pct"), B.metrics(B.equal_weight(m.returns())))


@query
def b10_warnings(spark, sf_dir):
    m = Model(spark, sf_dir)
    coverage = m.membership.agg(F.min("from_date").alias("verified_from"), date("2000-12-31").alias("verified_to"))
    safe = P.survivorship_safe(B.periods(m.dates).select(F.col("as_of").alias("start"), F.col("until").alias("end")), coverage)
    steps = O.rebalances(m.grid(), m.momentum_z().where("z is not null"), m.dates)
    return O.run_warnings(steps, safe, B.metrics(B.equal_weight(m.returns())))


@query
def b11_shuffled_returns(spark, sf_dir):
    return O.shuffled_returns(Model(spark, sf_dir).returns())


@query
def r4_best_mentions(spark, sf_dir):
    line = S.read(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 20).alias("isin"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_linenumber") * 0.1 + 0.2).alias("confidence"), (F.col("l_returnflag") == "N").alias("head"))
    return N.best_mentions(rows.where("head").drop("head"), rows.where("not head").drop("head"), "id").select("id", "isin", "confidence", "method")


def _articles(spark, sf_dir):
    d = S.read(spark, sf_dir, "documents").where("text is not null")
    day = F.date_add(date("2024-01-01"), (F.col("doc_id") % 5).cast("int")).cast("timestamp_ntz")
    return d.select(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("http://x/"), text("doc_id"))).otherwise("").alias("url"), F.concat(F.lit("Story "), (F.col("doc_id") % 200).cast("string")).alias("headline"), day.alias("published_at"))


@query
def r6_stored_articles(spark, sf_dir):
    a = _articles(spark, sf_dir)
    ids = a.select(C.article_id(F.col("url"), F.col("headline"), F.col("published_at")).alias("article_id"), F.regexp_extract("headline", "([0-9]+)", 1).cast("int").alias("k")).distinct()
    mentions = ids.where("k % 4 <> 0").select("article_id", (F.col("k") % 7).alias("isin"), F.lit(0.9).alias("confidence"), F.lit("HEADLINE").alias("method"))
    stored = spark.createDataFrame([], "news_id string, isin int, content_hash string, day date")
    return N.store_articles(a, mentions, stored)[0].select("news_id", "isin", "content_hash", "day")


@query
def r7_reresolved(spark, sf_dir):
    """Lines as attributions: those of 1998 are gone, later confidences have changed."""
    line = written(S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("isin")).agg(F.max(F.year("l_shipdate")).alias("y")))
    rows = lambda c: line.select("id", "isin", F.lit("HEADLINE").alias("method"), c.alias("confidence"), "y")
    old, new = rows(F.lit(0.9)), rows(F.when(F.col("y") >= 1996, 0.8).otherwise(0.9)).where("y <> 1998")
    changes, kept = N.reresolved(old, new, old.select("id", "isin", F.lit(1.0).alias("score")), "id")
    return changes.groupBy("change").agg(F.count("*").alias("n")).unionByName(kept.select(F.lit("SCORES").alias("change")).groupBy("change").agg(F.count("*").alias("n")))


@query
def r8_scored_once(spark, sf_dir):
    """Each distinct text is scored once: here by its length."""
    d = S.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return N.score_once(d, "text", lambda t: t.select("text", F.length("text").cast("long").alias("score"))).select("doc_id", "score")


@query
def r9_signed_scores(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    odds = e.select(text("event_id").alias("text"), F.array((F.col("event_id") % 7) / 10.0, (F.col("event_id") % 5) / 10.0, (F.col("event_id") % 3) / 10.0).alias("p"))
    return N.signed_scores(odds, ["positive", "negative", "neutral"])


@query
def r10_confirmed(spark, sf_dir):
    line = S.read(spark, sf_dir, "lineitem")
    best = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("isin"), F.lit(0.9).alias("confidence"), F.lit("BODY").alias("method")).distinct()
    return N.confirmed(line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("isin")), best, "id")
