"""What queries over the driver's tables do not show: failures, files, streams of pages, empty tables."""

import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalar as C
from factorloom.operators import news as N
from factorloom.operators import reports as O
from factorloom.operators import review as W
from factorloom.sources import listings as L
from factorloom.sources import sinks as K


def test_constituents_from_a_file(spark, tmp_path):
    (tmp_path / "list.csv").write_text(" Company Name , ISIN Code,Symbol \nA Ltd , INE001 ,AAA\nB Ltd,US1,BBB\n")
    assert [tuple(r) for r in L.read_constituents(spark, str(tmp_path / "list.csv")).collect()] == [("INE001", "AAA", "A Ltd", None)]
    with pytest.raises(ValueError, match="Symbol"):
        L.constituents(spark.createDataFrame([("INE1", "x")], "`ISIN Code` string, `Company Name` string"))


def test_a_provider_must_adjust(spark):
    targets = spark.createDataFrame([("a", "2020-01-01", "2020-02-01")], "isin string, start string, end string")
    stored = spark.createDataFrame([], "isin string, date date, open double, high double, low double, close double, adj_close double, volume bigint")
    with pytest.raises(ValueError, match="adjusted close"):
        L.through_cache(targets, targets.limit(0), stored, lambda missing: missing.select("isin", F.lit(1.0).alias("Close")))


def test_a_company_number_is_no_year(spark):
    names = ["AR_2050_2003_2004_.pdf", "AR_12050_2003_2004_.pdf", "AR_X_2010_2011_04082011120000.pdf", "AR20112012.pdf", "AR_X.pdf"]
    rows = spark.createDataFrame([(k, {"fileName": f"https://x/{n}"}) for k, n in enumerate(names)], "isin int, r map<string,string>")
    assert sorted((r.isin, r.fiscal_year) for r in L.annual_reports(rows).collect()) == [(0, 2004), (1, 2004), (2, 2011), (3, 2012)]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page x /Type/Page\n\xff")
    row = L.register_files(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert row.n_pages == 2 and row.n_bytes == 48 and len(row.sha256) == 64
    K.write_csv(spark.createDataFrame([(1, "a;b")], "k int, v string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().v == "a;b"
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    K.rebuild(rows, str(tmp_path / "t"))
    K.rebuild(rows.where("k = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_schema_differences(spark):
    spark.createDataFrame([(1, 2)], "a int, b int").createOrReplaceTempView("seen_table")
    expected = spark.createDataFrame([("seen_table", "a"), ("seen_table", "c")], "table string, column string")
    found = L.catalog_columns(spark).where("table = 'seen_table'")
    assert {tuple(r) for r in L.schema_differences(expected, found).collect()} == {("seen_table", "c", "MISSING"), ("seen_table", "b", "EXTRA")}


def test_decisions_that_fail(spark):
    reviews = spark.createDataFrame([(1, "PENDING", None)], "attempt_id int, status string, notes string")
    stored = spark.createDataFrame([(1, 7)], "attempt_id int, k int")
    ask = lambda i, s: spark.createDataFrame([(i, s, "n", False)], "attempt_id int, status string, notes string, force boolean")
    with pytest.raises(Exception, match="ACCEPTED or REJECTED"):
        K.decide(reviews, stored, ask(1, "MAYBE"), stored, ["k"])[0].collect()
    with pytest.raises(Exception, match="no review"):
        K.decide(reviews, stored, ask(2, "ACCEPTED"), stored, ["k"])[0].collect()


def test_history_needs_its_columns(spark):
    with pytest.raises(ValueError, match="to_date"):
        K.load_history(None, None, "x", spark.createDataFrame([(1, 2)], "isin int, from_date int"), None, None, "s")
    assert K.run_id({"a": 1, "b": 2}) == K.run_id({"b": 2, "a": 1}) != K.run_id({"a": 1, "b": 3})


def test_extractors_plug_in(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "defgh")], "doc int, page int, text string")

    def lengths(frames):
        for f in frames:
            yield f.assign(n=f["text"].str.len())[["doc", "n"]]

    assert sorted(r.n for r in W.extract(pages, lengths, "doc int, n int").collect()) == [3, 5]
    kept = lambda **more: [(r.page, r.text) for r in W.within_budget(pages, "doc", "page", "text", 5, **more).orderBy("page").collect()]
    assert kept(least=1) == [(1, "abc"), (2, "de")]
    # with too little left a page goes whole
    assert kept() == kept(least=2) == [(1, "abc")]


def test_shown_values(spark):
    row = spark.range(1).select(C.ordinal(F.lit(112.4)), C.ordinal(F.lit(2.5)), C.duration(F.lit(3720.0)), C.crore_text(F.lit(float("nan"))), C.crore_text(F.lit(-1234.5)), C.percent_text(F.lit(0.1234))).first()
    assert tuple(row) == ("112th", "2nd", "1h 02m", "", "-1,234", "12.34%")


def test_alias_blocks(spark):
    rows = spark.createDataFrame([(1, "TATA", "Tata Motors Limited"), (2, "BOB", "Bank of Baroda"), (3, "PAGE", "Page Industries Ltd"), (4, "INFY", "Infosys Ltd")], "isin int, symbol string, name string")
    curated = spark.createDataFrame([("INFY", "Infy Tech")], "symbol string, alias string")
    got = {(r.isin, r.alias, r.source) for r in N.alias_candidates(rows, ["tata"], ["page", "bank", "industries"], curated).collect()}
    assert got == {(1, "tata motors", "NAME"), (2, "bank of baroda", "NAME"), (2, "bob", "SYMBOL"), (3, "page industries", "NAME"), (4, "infosys", "NAME"), (4, "infy", "SYMBOL"), (4, "infy tech", "CURATED")}


def test_a_story_may_come_back(spark):
    rows = [("", "Sensex ends higher", "2024-01-01"), ("", "Sensex ends higher", "2024-01-02"), ("http://y", "sensex  ends higher!", "2024-01-02")]
    articles = spark.createDataFrame(rows, "url string, headline string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    mentions = spark.createDataFrame([], "article_id string, isin int, confidence double, method string")
    stored = spark.createDataFrame([], "news_id string, isin int, content_hash string, day date")
    first, stats = N.store_articles(articles, mentions, stored)
    assert first.count() == 2 and stats.first().asDict() == {"rows": 3, "articles": 3, "unresolved": 3, "stored": 2, "duplicates": 1}
    assert N.store_articles(articles, mentions, first)[0].count() == 0


def test_diagnosis_of_an_undefined_ratio(spark):
    raw = spark.createDataFrame([("t", 1, "roe", None), ("t", 2, "roe", None), ("t", 3, "roe", 1.0)], "as_of string, isin int, factor string, raw double")
    statuses = spark.createDataFrame([("t", 1, "annual", 3, "PRESENT"), ("t", 2, "annual", 0, "ABSENT")], "as_of string, isin int, dataset string, n long, status string")
    columns = sorted({f for _, fields, *_ in O.NEEDS.values() for f in fields.split(",") if f})
    newest = spark.createDataFrame([("t", 1, *([1.0] * len(columns)))], "as_of string, isin int, " + ", ".join(f"{c} double" for c in columns))
    assert {(r.isin, r.dataset, r.reason) for r in O.diagnosis(raw, statuses, newest).collect()} == {(1, None, "undefined for this company"), (2, "annual", "no annual")}
