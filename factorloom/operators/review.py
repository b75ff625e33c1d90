"""Extractions under review, comparisons of extracting models, pages to extract from, filings to take, inputs of narratives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import once

#: fixed values: patterns of statements' pages and their points, and patterns of other pages
ANCHORS = (
    (r"balance\s+sheet", 10),
    (r"statement\s+of\s+profit\s+and\s+loss", 10),
    (r"profit\s+and\s+loss\s+(account|statement)", 10),
    (r"statement\s+of\s+cash\s*flows?", 10),
    (r"cash\s*flow\s+statement", 10),
    (r"statement\s+of\s+changes\s+in\s+equity", 8),
    (r"notes?\s+(to|forming\s+part\s+of)\s+(the\s+)?(consolidated\s+|standalone\s+)?financial\s+statements", 9),
    (r"independent\s+auditor'?s?\s+report", 8),
    (r"significant\s+accounting\s+policies", 6),
    (r"earnings?\s+per\s+(equity\s+)?share", 5),
    (r"contingent\s+liabilit", 5),
    (r"basis\s+for\s+(qualified|adverse|disclaimer)\s+opinion", 8),
)
#: fixed values: a word that a text must hold, in lower case, before a pattern can match
WORDS = ("balance", "statement", "profit", "statement", "cash", "changes", "financial", "auditor", "significant", "earning", "contingent", "opinion")
AGAINST = r"chairman'?s?\s+(letter|message|statement)|managing\s+director'?s?\s+(letter|message)|sustainability\s+report|corporate\s+social\s+responsibility|board\s+of\s+directors\s+profile"
#: share of number-like tokens from which a page gains, and tokens that a page needs for a share
DENSE, LEAST_TOKENS = 0.15, 20


def review_queue(reviews: DataFrame, instruments: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` extractions that wait for a decision: the least certain first, then the oldest."""
    rows = reviews.where("status = 'PENDING'").join(instruments.select("isin", "symbol"), "isin", "left")
    return rows.orderBy("confidence", "queued_at", "attempt_id").limit(limit)


def review_detail(attempts: DataFrame, filings: DataFrame, instruments: DataFrame, payload: str) -> DataFrame:
    """Attempts with their filing and company, and the JSON payload as columns of the schema ``payload``."""
    rows = attempts.join(filings, "filing_id").join(instruments.select("isin", "symbol", "name"), "isin", "left")
    return rows.withColumn("payload", F.from_json("payload_json", payload))


def review_summary(reviews: DataFrame) -> DataFrame:
    """status, n, avg_confidence."""
    return reviews.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))


def bakeoff_rates(attempts: DataFrame) -> DataFrame:
    """model, n, succeeded, persisted, clean, nse_checked, nse_agreed, cost, seconds and the rates of each model's attempts.

    attempts: model, ok, confidence, checks (array of name, passed, skipped), cost, seconds.
    """
    cross = F.filter("checks", lambda x: x["name"].startswith("nse_cross_check_") & ~x["skipped"])
    done = F.col("ok") & F.col("confidence").isNotNull()
    rows = attempts.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(done).alias("succeeded"), F.count_if(done & (F.col("confidence") >= 0.6)).alias("persisted"), F.count_if(done & (F.col("confidence") >= 1)).alias("clean"),
        F.coalesce(F.sum(F.when(done, F.size(cross))), F.lit(0)).alias("nse_checked"), F.coalesce(F.sum(F.when(done, F.size(F.filter(cross, lambda x: x["passed"])))), F.lit(0)).alias("nse_agreed"), F.sum("cost").alias("cost"), F.sum("seconds").alias("seconds"),
    )
    return rows.withColumn("persist_rate", F.col("persisted") / F.col("n")).withColumn("nse_rate", F.col("nse_agreed") / F.nullif(F.col("nse_checked"), F.lit(0)))


def number_density(text: Column) -> Column:
    """The share of a text's tokens that look like numbers; 0 for short texts."""

    def share(tokens: Column) -> Column:
        numbers = F.size(F.filter(tokens, lambda x: x.rlike("^\\(?-?[0-9,]+\\.?[0-9]*\\)?$")))
        return F.when(F.size(tokens) < LEAST_TOKENS, 0.0).otherwise(numbers / F.size(tokens))

    return once(F.filter(F.split(text, "\\s+"), lambda x: x != ""), share)


def score_pages(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) with score and anchors (those found). A pattern is tried where its word occurs."""

    def anchors(page: Column) -> Column:
        held = (F.when(F.contains(page["low"], F.lit(word)) & page["text"].rlike(f"(?i){p}"), F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"))) for (p, n), word in zip(ANCHORS, WORDS, strict=True))
        return F.array_compact(F.array(*held))

    found = once(F.struct(F.col("text").alias("text"), F.lower("text").alias("low")), anchors)
    points = F.aggregate(F.col("found"), F.lit(0.0), lambda acc, x: acc + x["n"])
    dense = once(number_density(F.col("text")), lambda x: F.when(x > DENSE, 4.0 * F.least(x / DENSE, F.lit(2.0))).otherwise(0.0))
    rows = pages.withColumn("found", found)
    score = points + dense - F.when(F.col("text").rlike(f"(?i){AGAINST}"), 8.0).otherwise(0.0)
    return rows.select(*pages.columns, score.alias("score"), F.transform("found", lambda x: x["p"]).alias("anchors"))


def within_budget(pages: DataFrame, key: str, page: str, text: str, budget: int, least: int = 200) -> DataFrame:
    """Pages of each document, in order, whose texts fit ``budget`` characters together; the one that passes it is cut there, or left out with ``least`` characters or less to go."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_b", before).where((F.col("_b") + F.length(text) <= budget) | (F.col("_b") < budget - least)).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_b")).cast("int"))).drop("_b")


def extract(pages: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """What a pluggable extractor (iterator of pandas frames -> iterator of pandas frames) says of each document's pages."""
    return pages.mapInPandas(extractor, schema)


def annual_filings(refs: DataFrame) -> DataFrame:
    """One filing of each company-year: consolidated ones where the company has any, else the others; of those the first broadcast. refs: isin, fiscal_year, is_consolidated, period_end, broadcast_date."""
    group = F.coalesce("is_consolidated", F.lit(False))  # an unknown basis counts as standalone
    one = Window.partitionBy("isin", "fiscal_year").orderBy("period_end", "broadcast_date")
    rows = refs.withColumn("_c", F.bool_or(group).over(Window.partitionBy("isin"))).where(group == F.col("_c"))
    return rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_c", "_r")


def audit_opinion(note: Column) -> Column:
    """The opinion that a declaration's text names, NULL where it names none."""
    text = F.lower(F.trim(note))
    return F.when(text.contains("unmodified"), "UNMODIFIED").when(text.contains("qualified") | text.contains("qualification"), "QUALIFIED")


def annual_rows(filings: DataFrame, facts: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows for the annual table, and refusals (isin, fiscal_year, reason) of filings without a fact that must be there.

    facts: filing_id and the statement's columns. The year is the filing's; free cash flow is
    what operations leave after capital spending, where both are told.
    """
    joined = filings.join(facts, "filing_id", "left")
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    judged = joined.withColumn("_missing", missing)
    rows = judged.where(F.size("_missing") == 0).withColumn("fcf", F.col("ocf") - F.col("capex")).withColumn("auditor_opinion", audit_opinion(F.col("opinion_note"))).withColumn("extraction_confidence", F.lit(1.0)).drop("_missing", "opinion_note")
    return rows, judged.where(F.size("_missing") > 0).select("isin", "fiscal_year", F.concat(F.lit("missing "), F.array_join("_missing", ",")).alias("reason"))


def narrative_inputs(scores: DataFrame, drivers: DataFrame, flags: DataFrame) -> DataFrame:
    """as_of, isin, score, signal, strengths, weaknesses, red_flags: all that a company's text may draw on."""
    return scores.select("as_of", "isin", "score", "signal").join(drivers, ["as_of", "isin"], "left").join(flags.select("as_of", "isin", "red_flags"), ["as_of", "isin"], "left")
