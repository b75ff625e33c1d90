"""Pages for an extractor: which stay, which go for size, and how they are rendered."""

import pytest
import re

from pyspark.sql import functions as F

from factorloom.operators import review as W
from factorloom.operators import sections as D

SCHEMA = "doc string, page long, text string, n_bytes long"
NUMBERS = "1,234 (56) 7.5 " * 10
PROSE = "our people and our planet " * 5


def report(*texts, doc="a", size=100):
    return [(doc, k, t, size) for k, t in enumerate(texts)]


def located(spark, rows, **limits):
    kept, refused = D.located_sections(spark.createDataFrame(rows, SCHEMA), **limits)
    return {(r.doc, r.page) for r in kept.collect()}, {r.doc: r.reason for r in refused.collect()}


def test_pages_after_a_heading_and_dense_ones_stay(spark):
    rows = report(PROSE, "Balance Sheet", *[PROSE] * 8, NUMBERS, PROSE)
    assert located(spark, rows) == ({("a", k) for k in (1, 2, 3, 4, 5, 6, 7, 10, 11)}, {})
    # a letter that names statements opens no window
    assert located(spark, report("Chairman's letter: balance sheet and cash flow statement", *[PROSE] * 3, "Balance sheet"))[0] == {("a", 4), ("a", 0), ("a", 1), ("a", 2), ("a", 3)}
    assert located(spark, report("Chairman's letter: balance sheet", *[PROSE] * 3, NUMBERS))[0] == {("a", 4)}


def test_a_limit_of_pages_keeps_the_best(spark):
    rows = report(*[NUMBERS] * 6, "balance sheet and cash flow statement", "Balance sheet")
    assert located(spark, rows, max_pages=3)[0] == {("a", 0), ("a", 6), ("a", 7)}


def test_size_sheds_the_weakest_and_keeps_ten(spark):
    rows = report(*[NUMBERS] * 12, "Balance sheet " + NUMBERS, "Balance sheet")
    # each page has 100 bytes: of equally weak ones the first go
    assert located(spark, rows, max_bytes=1200)[0] == {("a", k) for k in range(2, 14)}
    assert located(spark, rows, max_bytes=1000)[0] == {("a", k) for k in range(4, 14)}
    kept, refused = located(spark, rows + report("Balance sheet", doc="b"), max_bytes=999)
    assert kept == {("b", 0)} and refused == {"a": "10 pages still weigh 1000 bytes"}


def test_reports_that_are_refused(spark):
    rows = report(*[""] * 3, doc="scan") + report(*[PROSE] * 3, doc="prose") + report("earnings per share", doc="weak") + [("none", 0, None, 0)]
    assert located(spark, rows)[1] == {"scan": "no headings of financial statements", "prose": "no headings of financial statements", "none": "no headings of financial statements"}
    assert located(spark, report("significant accounting policies chairman's letter", doc="w") + report("Contingent liability", doc="x"))[1] == {"w": "no headings of financial statements"}
    assert located(spark, [])[0] == set()


@pytest.mark.parametrize(
    ("text", "tables", "want"),
    [
        ("Head\nRevenue from operations 5\nProfit for the year 2\n", [[["Revenue from operations 5", None], ["Profit for the year 2", " x "]]], "Head\nRevenue from operations 5\nProfit for the year 2\nRevenue from operations 5 | \nProfit for the year 2 | x"),
        ("h1\nh2\nh3\nh4\na line of the text\nanother line of it\n", [[["a line of the text"]]], None),
        ("h1\nh2\nh3\nh4\nline\n", [[["1"]], [["2", "3"]]], "h1\nh2\nh3\nh4\n1\n\n2 | 3"),
        ("text", [], None),
        ("text", None, None),
    ],
)
def test_tables_stand_for_a_page_that_they_hold(spark, text, tables, want):
    frame = spark.createDataFrame([(text, tables)], "text string, tables array<array<array<string>>>")
    assert frame.select(D.rendered_page(F.col("text"), F.col("tables"))).first()[0] == (text if want is None else want)


def test_a_text_ends_where_it_is_full(spark):
    rows = [(doc, k, "x" * n, None) for doc, sizes in {"a": (100, 300), "b": (100, 300, 5), "c": (700,), "d": (100, 200)}.items() for k, n in enumerate(sizes)] + [("e", 0, None, None)]
    frame = spark.createDataFrame(rows, "doc string, page long, text string, tables array<array<array<string>>>")
    got = {r.doc: (len(r.text), r.truncated) for r in D.document_text(frame, 400).collect()}
    # a page's own line takes 16 letters; 284 are left for the second page of a and b
    assert got == {"a": (400, True), "b": (400, True), "c": (400, True), "d": (332, False), "e": (16, False)}
    assert {r.doc: len(r.text) for r in D.document_text(frame, 316).collect()} == {"a": 116, "b": 116, "c": 316, "d": 116, "e": 16}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_split_into_lines_as_often_as_it_is_read_not_once_a_line(spark):
    frame = spark.createDataFrame([("d", 1, "t", None)], "doc string, page int, text string, tables array<array<array<string>>>")
    assert optimized(D.document_text(frame)).count("split(") <= 2


def test_pages_are_scored_in_one_pass_over_the_documents(spark):
    from factorloom.plans import registry

    told = registry.queries()["e7_sections"](spark, "/root/testdata/sf0.001")
    assert optimized(told).count("Relation [") == 1


def test_a_word_is_there_wherever_a_pattern_of_a_statement_matches(spark):
    texts = ["BALANCE  Sheet", "statement of profit and loss", "Profit and loss account", "Statement of cash flows", "CASH FLOW statement", "statement of changes in equity", "notes forming part of the consolidated financial statements", "Independent Auditor's report", "Significant accounting policies", "earnings per equity share", "contingent liability", "basis for adverse opinion", "Chairman's letter", None, ""]
    rows = W.score_pages(spark.createDataFrame(list(enumerate(texts)), "page int, text string")).orderBy("page").collect()
    assert [r.anchors == [p for p, _ in W.ANCHORS if re.search(p, t or "", re.I)] for t, r in zip(texts, rows, strict=True)] == [True] * len(texts)
    assert all(any(re.search(p, t, re.I) for t in texts if t) for p, _ in W.ANCHORS)
