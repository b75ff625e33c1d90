"""From a report's pages to what an extractor reads: pages of statements within limits of number and size, rendered with their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import once
from factorloom.operators.review import score_pages
from factorloom.operators.statements import page_order

#: pages that shedding for size leaves; share of a page's lines that its tables must hold; letters that make a line count
LEAST_PAGES, COVERAGE, LINE = 10, 0.6, 12
#: characters that must be left for a page to be cut rather than left out
LEAST_LEFT = 200
HEADING_LINES = 4
_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def judged_sections(pages: DataFrame, max_pages: int = 60, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """pages (doc, page (consecutive), text, n_bytes) with score, anchors, kept, first (the document's first page), pages (how many it has) and reason (why it is refused, if it is): one pass.

    The ``max_pages`` best pages are candidates. Of those the weakest go, one after the other,
    while all together are over ``max_bytes`` and more than ``LEAST_PAGES``: a page stays if it
    and the stronger ones fit, so sums from the strongest page on tell it without a loop. A
    document without any heading, without a page that scores enough, or that does not fit
    even so is refused.
    """
    scored = score_pages(pages)
    all_of = Window.partitionBy("doc")
    rows = scored.withColumn("pages", F.count("*").over(all_of)).withColumn("_best", F.max("score").over(all_of)).withColumn("first", F.row_number().over(all_of.orderBy("page")) == 1)
    rows = page_order(rows, "doc", "page", "score").withColumn("_r", F.when(F.col("_r") <= max_pages, F.col("_r")))
    stronger = all_of.orderBy(F.desc("_in"), F.desc("score"), F.desc("page"))  # of equal ones the first page goes first
    rows = rows.withColumn("_in", F.col("_r").isNotNull())
    rows = rows.withColumn("_sum", F.sum("n_bytes").over(stronger.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(stronger))
    rows = rows.withColumn("kept", F.col("_in") & (F.coalesce(F.col("_sum") <= max_bytes, F.lit(False)) | (F.col("_rank") <= LEAST_PAGES)))
    rows = rows.withColumn("_bytes", F.sum(F.when(F.col("kept"), F.col("n_bytes"))).over(all_of)).withColumn("_n", F.count_if("kept").over(all_of))
    reason = (
        F.when(F.coalesce("_best", F.lit(0.0)) <= 0, "no headings of financial statements")
        .when(F.col("_n") == 0, "no page scores enough")
        .when(F.col("_bytes") > max_bytes, F.concat(F.col("_n").cast("string"), F.lit(" pages still weigh "), F.col("_bytes").cast("string"), F.lit(" bytes")))
    )
    return rows.withColumn("reason", reason).select(*scored.columns, "kept", "first", "pages", "reason")


def located_sections(pages: DataFrame, max_pages: int = 60, max_bytes: int = 20 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Pages of statements (the columns of ``pages`` with score and anchors), and refusals (doc, pages, reason), as ``judged_sections`` tells them."""
    judged = judged_sections(pages, max_pages, max_bytes)
    kept = judged.where("kept AND reason IS NULL").drop("kept", "first", "pages", "reason")
    return kept, judged.where("first AND reason IS NOT NULL").select("doc", "pages", "reason")


def lines(text: Column) -> Column:
    """A text's lines; none of an empty text, nor one after the last line's end."""
    apart = once(F.split(text, _BREAK), lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(apart)


def line_coverage(raw: Column, rendered: Column) -> Column:
    """The share of a page's different lines over ``LINE`` letters that the rendering holds; 1 without such lines."""

    def share(own: Column) -> Column:
        return once(rendered, lambda shown: F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.filter(own, lambda x: F.contains(shown, x))) / F.nullif(F.size(own), F.lit(0))))

    return once(F.array_distinct(F.filter(F.transform(lines(raw), F.trim), lambda x: F.length(x) > LINE)), share)


def rendered_page(text: Column, tables: Column) -> Column:
    """A page's text: its heading and tables (tables of rows of cells) where these hold most of its lines, else the text as it is."""
    row = lambda cells: F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")

    def told(page: Column) -> Column:
        shown = F.array_join(F.transform(page["tables"], lambda t: F.array_join(F.transform(t, row), "\n")), "\n\n")
        out = F.concat(F.array_join(F.slice(lines(page["text"]), 1, HEADING_LINES), "\n"), F.lit("\n"), shown)
        best = once(out, lambda x: F.when(line_coverage(page["text"], x) >= COVERAGE, x).otherwise(page["text"]))
        return F.when(F.coalesce(F.size(page["tables"]), F.lit(0)) > 0, best).otherwise(page["text"])

    return once(F.struct(text.alias("text"), tables.alias("tables")), told)


def document_text(pages: DataFrame, max_chars: int = 28_000) -> DataFrame:
    """doc, text, truncated: a document's rendered pages in order, as far as ``max_chars`` go.

    pages: doc, page, text, tables (NULL or empty: none were found). The page that does not
    fit any more is cut if over ``LEAST_LEFT`` characters are left for it, and none follows.
    """
    shown = F.concat(F.lit("\n--- page "), F.col("page").cast("string"), F.lit(" ---\n"), rendered_page(F.coalesce("text", F.lit("")), F.col("tables")))
    rows = pages.select("doc", "page", shown.alias("shown")).withColumn("n", F.length("shown").cast("long"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.lit(max_chars) - F.coalesce(F.sum("n").over(before), F.lit(0)))
    part = F.when(F.col("n") <= F.col("left"), F.col("shown")).when(F.col("left") > LEAST_LEFT, F.substring("shown", F.lit(1), F.col("left").cast("int")))
    # no more is gathered of a document than max_chars
    told = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("page", part.alias("part"))))).alias("parts"), F.bool_or(F.col("n") > F.col("left")).alias("truncated"))
    return told.select("doc", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), "truncated")
