"""Registered queries for runs, kept tables, work queues and what is read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import scalar as C
from factorloom.operators import backtest as B
from factorloom.operators import factors as V
from factorloom.operators import reports as O
from factorloom.operators import runs as U
from factorloom.operators import scoring as X
from factorloom.operators import sections as D
from factorloom.operators import serving as R
from factorloom.operators import statements as E
from factorloom.plans.more import diagnosed, statuses
from factorloom.plans.registry import MINIMA, Model, query
from factorloom.sources import adapters as S
from factorloom.sources import parsers as Z
from factorloom.sources import sinks as K
from factorloom.sources.backfill import ARTICLE_KEYS, LOG_KEYS, Backfill
from factorloom.sources.store import KeyedTable, work_folder, written

text = lambda c: F.col(c).cast("string")
date = lambda x: F.lit(x).cast("date")
#: factors, sizes and costs of runs; the last ones need more names than some dates have, or pay brokerage
RUNS = [(f"{factor}-{n}-{'costs' if costs else 'free'}", factor, n, 10, 1_000_000.0, costs, 0.0, 0.0) for factor in ("momentum_12_1", "price_to_200dma", "relative_strength_6m") for n in (5, 20) for costs in (True, False)]
RUNS += [("picky", "momentum_12_1", 20, 97, 500_000.0, True, 0.0, 0.0), ("brokered", "relative_strength_6m", 5, 10, 1_000_000.0, True, 0.001, 20.0)]


def all_runs(m: Model, configs: list[tuple] | None = None, transform=None):
    z = written(X.factor_z(V.momentum(m.grid(), m.prices, **MINIMA)).select("as_of", "isin", "factor", "z"))
    rows = m.spark.createDataFrame(configs or RUNS, U.CONFIG)
    return rows, U.backtests(rows, m.grid(), z, m.dates, m.returns(), B.median_traded(m.grid(), m.prices), transform)


@query
def b2_runs(spark, sf_dir):
    """Fourteen configurations in one plan."""
    return all_runs(Model(spark, sf_dir))[1]["curve"]


@query
def b2_run_schedule(spark, sf_dir):
    return all_runs(Model(spark, sf_dir))[1]["schedule"]


@query
def b6_run_metrics(spark, sf_dir):
    configs, told = all_runs(Model(spark, sf_dir))
    return U.run_metrics(written(told["curve"]), configs)


@query
def b11_shuffled_runs(spark, sf_dir):
    """The runs that pay no costs over returns dealt anew: a control that no factor can foresee."""
    free = [c for c in RUNS if not c[5]]
    return all_runs(Model(spark, sf_dir), free, O.shuffled_returns)[1]["curve"].select("run_id", "date", "nav")


@query
def k8_stored_runs(spark, sf_dir):
    """Runs, values and positions of all configurations, stored, one run stored again, one taken out, and read back."""
    configs, told = all_runs(Model(spark, sf_dir))
    folder = work_folder(spark)
    curve = written(told["curve"])
    tables = {
        "runs": (configs.join(U.run_metrics(curve, configs), "run_id", "left"), ["run_id"]),
        "nav": (curve, ["run_id", "date"]),
        "positions": (told["positions"], ["run_id", "as_of", "isin"]),
    }
    read = {}
    gone = spark.createDataFrame([("momentum_12_1-5-free",)], "run_id string")
    for name, (rows, keys) in tables.items():
        t = KeyedTable(spark, f"{folder}/{name}", keys)
        t.upsert(rows)
        t.upsert(t.read(1).where("run_id = 'picky'"))
        t.delete(gone)
        read[name] = t.read()
    nav = read["nav"].select("run_id", F.lit("nav").alias("kind"), "date", F.lit(None).cast("bigint").alias("isin"), F.col("nav").alias("value"))
    held = read["positions"].select("run_id", F.lit("position").alias("kind"), F.col("as_of").alias("date"), F.col("isin").cast("bigint"), F.col("weight").alias("value"))
    runs = read["runs"].select("run_id", F.lit("total_return").alias("kind"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("bigint").alias("isin"), F.col("total_return").alias("value"))
    return nav.unionByName(held).unionByName(runs)


def _orders(spark, sf_dir):
    return S.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))


@query
def k1_stored_upsert(spark, sf_dir):
    """Orders up to 1996, stored; those from 1996 on come as upserts, two years in a batch."""
    o = _orders(spark, sf_dir)
    t = KeyedTable(spark, work_folder(spark), ["o_orderkey"])
    t.replace(o.where("y <= 1996"))
    for a, b in ((1996, 1997), (1998, 9999)):
        t.upsert(o.where(F.col("y").between(a, b)).withColumn("o_orderstatus", F.lit(f"from {a}")))
    return t.read()


@query
def k5_stored_delete(spark, sf_dir):
    """Orders and lines by key: returned lines go one by one, lines of orders under way by their order."""
    lines = S.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    t = KeyedTable(spark, work_folder(spark), ["l_orderkey", "l_linenumber"])
    t.replace(lines)
    t.delete(lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"))
    t.delete(_orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")))
    return t.read()


@query
def k6_stored_rebuild(spark, sf_dir):
    """A table is rebuilt from its own rows; the versions before it stay readable."""
    t = KeyedTable(spark, work_folder(spark), ["o_orderkey"])
    t.replace(_orders(spark, sf_dir))
    t.replace(t.read().where("o_orderstatus = 'F'"))
    t.replace(t.read().withColumn("o_orderstatus", F.lit("done")))
    rows = [t.read(v).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("version", F.lit(v)) for v in t.versions()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def r7_stored_reresolution(spark, sf_dir):
    """Attributions and scores in store: a new resolution takes rows out, adds and changes some, and scores of removed rows go with them."""
    line = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("isin")).agg(F.max(F.year("l_shipdate")).alias("y"))
    rows = lambda c: line.select("id", "isin", F.lit("HEADLINE").alias("method"), c.alias("confidence"), "y")
    folder = work_folder(spark)
    news, scores = KeyedTable(spark, f"{folder}/news", ["id", "isin"]), KeyedTable(spark, f"{folder}/scores", ["id", "isin"])
    news.replace(rows(F.lit(0.9)).where("y >= 1993"))
    scores.replace(news.read().select("id", "isin", (F.col("y") - 1990.0).alias("score")))
    K.reresolve(news, scores, rows(F.when(F.col("y") >= 1996, 0.8).otherwise(0.9)).where("y <> 1998"), "id")
    return news.read().join(scores.read(), ["id", "isin"], "full_outer")


@query
def s20_evolved_orders(spark, sf_dir):
    """Orders written in three schemas, read together: a wider key and price, a column that came, one that later rows lack."""
    o = S.read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    t = KeyedTable(spark, work_folder(spark), ["k"])
    t.replace(o.where("y <= 1994").select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_totalprice").cast("int").alias("price"), "o_orderstatus"))
    t.upsert(o.where("y BETWEEN 1994 AND 1996").select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderpriority").alias("priority")))
    t.upsert(o.where("y >= 1997").select(F.col("o_orderkey").cast("int").alias("k"), "o_orderstatus", F.to_date("o_orderdate").alias("day")))
    return t.read()


@query
def s20_schema_changes(spark, sf_dir):
    """What changes from each kept table's schema to the one that the driver's table has, in order of column."""
    t = KeyedTable(spark, work_folder(spark), ["k"])
    o = S.read(spark, sf_dir, "orders")
    t.replace(o.select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_totalprice").cast("float").alias("price"), "o_orderstatus", "o_orderpriority"))
    t.replace(o.select(F.col("o_orderkey").cast("bigint").alias("k"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").isNotNull().alias("o_orderstatus"), F.to_date("o_orderdate").alias("day")))
    found = spark.createDataFrame(t.schema_changes(1, 2), "column_name string, kind string, what string")
    counts = t.read().agg(F.count("*").alias("n"))
    return found.join(F.broadcast(counts))  # one row


def _asked(m: Model, number: int):
    """A provider for ``Backfill`` made of prices: each is an article of its month. Some windows are throttled in the first runs, some fail each time."""
    month = F.trunc("date", "month")
    day = F.date_format("date", "yyyyMMdd")
    item = F.struct(
        F.when(F.dayofmonth("date") % 7 != 0, F.concat(F.lit("S"), text("isin"), F.lit(" trades on "), day)).otherwise(" ").alias("title"),
        F.concat(F.lit("http://x/"), text("isin"), F.lit("/"), day).alias("url"), F.when(F.col("isin") % 2 == 0, "x.com").alias("domain"), F.concat(day, F.lit("T200000Z")).alias("seendate"),
    )
    payloads = m.prices.groupBy("isin", month.alias("window_start")).agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("payload"))
    n = F.col("isin") + F.year("window_start") * 12 + F.month("window_start")
    wait = F.lit("Please limit requests to one every 5 seconds")

    def fetch(windows):
        told = windows.join(payloads, ["isin", "window_start"], "left").withColumn("n", n)
        payload = F.when(F.col("n") % 3**number == 0, wait).when(F.col("n") % 5 == 0, F.lit('{"articles":[]}')).otherwise(F.col("payload"))
        return told.select("isin", "window_start", payload.alias("payload"), F.when(F.col("isin") % 17 == 0, F.repeat(F.lit("no route to host "), 20)).alias("error"))

    return fetch


def backfilled(m: Model) -> tuple[KeyedTable, KeyedTable]:
    """Log and articles after three runs over three months of 1999, the first of which takes fewer windows than there are."""
    folder = work_folder(m.spark)
    log, articles = KeyedTable(m.spark, f"{folder}/log", LOG_KEYS), KeyedTable(m.spark, f"{folder}/articles", ARTICLE_KEYS)
    companies = m.instruments.select("isin", "name")
    half = companies.count() * 3 // 2
    for number in (1, 2, 3):
        at = F.lit(f"2024-01-0{number}").cast("date")
        Backfill(log, articles, "prices", _asked(m, number), "1999-01-01").run(companies, date("1999-01-15"), date("1999-03-20"), at, half if number == 1 else None, commit=half)
    return log, articles


@query
def s18_backfill(spark, sf_dir):
    """The log of three runs: throttled windows come again, empty ones do not, failing ones stay errors."""
    return backfilled(Model(spark, sf_dir))[0].read().drop("provider")


@query
def s18_backfilled_articles(spark, sf_dir):
    return backfilled(Model(spark, sf_dir))[1].read().select("isin", "url", "headline", "source", "published_at", "window_start")


@query
def c11_truncated(spark, sf_dir):
    """Documents' texts cut to what a table's cell shows."""
    d = S.read(spark, sf_dir, "documents")
    return d.select("doc_id", C.truncated(F.col("text"), 200).alias("detail"), C.truncated(F.col("text"), 60, "...").alias("shown"))


def _reports(spark, sf_dir):
    """Forty documents as a report's pages, with headings of statements, tables of numbers and prose among them."""
    d = S.read(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = F.col("doc_id") % 16
    head = F.when(n == 0, "Consolidated Balance  Sheet\n").when(n == 3, "Chairman's Letter, with the Cash Flow Statement\n").when(n.isin(1, 9), F.repeat(F.lit("1,234.5 (67) x "), 3000)).otherwise("")
    rows = d.select(F.floor(F.col("doc_id") / 40).alias("doc"), (F.col("doc_id") % 40).alias("page"), F.when(F.floor(F.col("doc_id") / 40) % 7 != 3, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long"))


@query
def e7_sections(spark, sf_dir):
    """Pages that stay within twelve and 100,000 bytes, and reports that are refused."""
    told = D.judged_sections(_reports(spark, sf_dir), max_pages=12, max_bytes=100_000).where("CASE WHEN reason IS NULL THEN kept ELSE first END")
    return told.select("doc", *(F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("page", "score", "n_bytes")), "reason")


@query
def e8_rendered(spark, sf_dir):
    """Reports as texts of at most 28,000 characters. Every third page's tables hold all its lines, every third's its first line alone."""
    pages = _reports(spark, sf_dir)
    cells = F.when(F.col("page") % 3 == 1, F.transform(D.lines(F.col("text")), lambda x: F.array(x))).when(F.col("page") % 3 == 2, F.array(F.array(F.get(D.lines(F.col("text")), F.lit(0)), F.lit(" b "))))
    told = D.document_text(pages.withColumn("tables", F.when(cells.isNotNull(), F.array(cells))))
    return told.select("doc", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"), "truncated")


@query
def h_sectors(spark, sf_dir):
    return R.sectors(S.instruments(spark, sf_dir))


@query
def h_scored_dates(spark, sf_dir):
    return R.scored_dates(Model(spark, sf_dir).momentum_z().withColumnRenamed("z", "factor_score"))


@query
def h_recent_news(spark, sf_dir):
    """The five newest articles of each company, scored or not."""
    n = S.news(spark, sf_dir)
    return R.recent_news(n.select("news_id", "isin", "published_at"), n.where("news_id % 3 <> 0").select("news_id", "label", "score"), 5)


@query
def x14_all_factor_rows(spark, sf_dir):
    """Shares of all twenty factors in each score."""
    z = written(X.factor_z(Model(spark, sf_dir).raw()))
    return O.factor_rows(z, X.family_scores(z)).select("as_of", "isin", "family", "factor", "z", "share")


@query
def x14_all_drivers(spark, sf_dir):
    return O.drivers(X.factor_z(Model(spark, sf_dir).raw()))


@query
def x16_all_datasets(spark, sf_dir):
    """Six datasets of each company and date; reports are held by three companies of four, some of them extracted."""
    m = Model(spark, sf_dir)
    held = m.annual.where("isin % 4 <> 0 AND basis = 'CONSOLIDATED' AND year(period_end_date) >= 1999 - isin % 4").select("isin", F.concat_ws("-", "isin", F.year("period_end_date")).alias("filing_id"))
    six = O.filings_status(m.grid(), held, held.where("substr(filing_id, -1) IN ('7', '8')"))
    return statuses(m).unionByName(six, allowMissingColumns=True)


@query
def x16_blocked(spark, sf_dir):
    """Factors that each dataset's gap blocks."""
    return O.blocked(diagnosed(Model(spark, sf_dir)))


@query
def s6_resolved_quarters(spark, sf_dir):
    """Quarterly payloads that state some quarters twice, a hundredfold apart: the one on the company's scale stays."""
    q = S.fundamentals_quarterly(spark, sf_dir)
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))
    record = lambda times: F.struct(day(F.col("period_end_date")).alias("re_to_dt"), F.format_number(F.floor("revenue") * times, 0).alias("re_total_inc"), F.format_number(F.floor("pat") * times, 0).alias("re_net_profit"))
    twice = F.year("period_end_date") % 3 == 0
    body = F.concat(F.lit('{"resCmpData":'), F.to_json(F.when(twice, F.array(record(1), record(100))).otherwise(F.array(record(1)))), F.lit("}"))
    told = Z.quarterly_results(q.select("isin", body.alias("body")))
    return E.resolve_duplicate_periods(told, "isin", "period_end_date", "revenue")


@query
def j9_same_quarter(spark, sf_dir):
    return V.same_quarter_last_year(S.fundamentals_quarterly(spark, sf_dir), "pat")


@query
def v_own_factor(spark, sf_dir):
    """A factor of one's own - trading in the last 90 days, the less the better - among the momentum family, and the composite with it."""
    m = Model(spark, sf_dir)
    own = {"quiet": B.median_traded(m.grid(), m.prices).withColumnRenamed("median_traded", "raw")}
    raw = V.with_factors(V.momentum(m.grid(), m.prices, **MINIMA), m.grid(), own)
    z = X.factor_z(raw, V.FACTORS | {"quiet": ("momentum", False, 2.0)})
    return X.family_scores(z).select("as_of", "isin", "family", "mean_z", "coverage")
