"""Checks of extracted statements, unit repair, readiness, and keyed stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import relative_difference, unit_rate


def _check(name: str, passed: Column, known: Column, severity: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.when(known, passed).alias("passed"), F.lit(severity).alias("severity"), (~known).alias("skipped"))


#: columns that checks read; a table without one has it unknown
CHECKED = {n: "double" for n in ("revenue", "total_income", "total_expenses", "profit_before_tax", "share_of_associates", "tax_expense", "pat", "non_controlling_interest", "total_assets", "total_equity", "total_liabilities", "ocf", "capex", "fcf", "eps")}
CHECKED |= {"reporting_unit": "string", "basis": "string", "fiscal_year": "int", "period_end_date": "date"}
REQUIRED = ("revenue", "pat", "total_assets", "total_equity")


def validate(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds checks (array of name, passed, severity, skipped) and confidence: 0 for a hard failure, 0.3 for two soft ones, 0.6 for one, 1.

    A column that the table lacks is unknown, and a check of what is unknown is skipped; but
    units and basis, where the table has them, must be stated. A row of unknown unit fails
    that check alone: nothing else can be judged.
    """
    given = set(rows.columns)
    full = rows.select("*", *(F.lit(None).cast(t).alias(n) for n, t in CHECKED.items() if n not in given))
    c = F.col
    has = lambda *names: reduce(lambda a, b: a & b, [c(n).isNotNull() for n in names])
    near = lambda a, b, limit: relative_difference(a, b) <= limit
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    sides = has("total_assets", "total_equity")
    unit_known = unit_rate(c("reporting_unit")).isNotNull() if "reporting_unit" in given else F.lit(True)
    year_end = F.make_date(c("fiscal_year"), F.lit(3), F.lit(31))
    checks = F.array(
        _check("units", unit_known, F.lit("reporting_unit" in given), "HARD"),
        _check("required_fields", has(*required), F.lit(True), "HARD"),
        _check("basis_stated", has("basis"), F.lit("basis" in given), "HARD"),
        _check("balance_sheet_identity", sides & F.coalesce(near(c("total_assets"), c("total_equity") + c("total_liabilities"), 0.005), F.lit(False)), ~sides | has("total_liabilities"), "HARD"),
        _check("pbt_tax_pat", near(c("profit_before_tax") + zero("share_of_associates") - c("tax_expense"), c("pat") + zero("non_controlling_interest"), 0.02), has("profit_before_tax", "tax_expense", "pat"), "HARD"),
        _check("income_expenses_pbt", near(c("total_income") - c("total_expenses"), c("profit_before_tax"), 0.02), has("total_income", "total_expenses", "profit_before_tax"), "SOFT"),
        _check("revenue_vs_total_income", c("revenue") <= c("total_income") * 1.02, has("revenue", "total_income"), "SOFT"),
        _check("fcf_identity", near(c("ocf") - c("capex"), c("fcf"), 0.01), has("ocf", "capex", "fcf"), "SOFT"),
        _check("capex_sign", c("capex") >= 0, has("capex"), "SOFT"),
        _check("eps_sign", (c("eps") > 0) == (c("pat") > 0), has("eps", "pat") & (c("eps") != 0) & (c("pat") != 0), "SOFT"),
        _check("period_end_matches_fy", F.abs(F.datediff("period_end_date", year_end)) <= 92, has("fiscal_year", "period_end_date"), "SOFT"),
    )
    full = full.withColumn("checks", F.when(unit_known, checks).otherwise(F.slice(checks, 1, 1)))
    failed = lambda s: F.size(F.filter("checks", lambda x: (x["severity"] == s) & ~F.coalesce(x["passed"], F.lit(True))))
    confidence = F.when(failed("HARD") > 0, 0.0).when(failed("SOFT") > 1, 0.3).when(failed("SOFT") == 1, 0.6).otherwise(1.0)
    return full.withColumn("confidence", confidence).select(*rows.columns, "checks", "confidence")


def failures() -> Column:
    """Names of the checks that failed, in order."""
    return F.transform(F.filter("checks", lambda x: ~F.coalesce(x["passed"], F.lit(True))), lambda x: x["name"])


def route(validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All attempts, those to store (0.6 and more), those for review (under 1)."""
    return validated, validated.where("confidence >= 0.6"), validated.where("confidence < 1")


def quarters_against_year(annual: DataFrame, quarterly: DataFrame, column: str, limit: float) -> DataFrame:
    """isin, period_end_date, yearly, quarters, passed: the first four quarters of a year add up to it. NULL when there are fewer."""
    q = quarterly.select("isin", F.year("period_end_date").alias("y"), F.col(column).alias("x"), "period_end_date").withColumn("k", F.row_number().over(Window.partitionBy("isin", "y").orderBy("period_end_date"))).where("k <= 4")
    q = q.groupBy("isin", "y").agg(F.count("x").alias("n"), F.sum("x").alias("quarters"))
    rows = annual.select("isin", "period_end_date", F.col(column).alias("yearly"), F.year("period_end_date").alias("y")).join(q, ["isin", "y"], "left")
    return rows.select("isin", "period_end_date", "yearly", "quarters", F.when(F.col("n") == 4, relative_difference(F.col("yearly"), F.col("quarters")) <= limit).alias("passed"))


def resolve_duplicate_periods(rows: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """One row for each (key, period). Of several, the one on the scale of the key's single periods (their upper median); none if there is no scale."""
    per = Window.partitionBy(key, period)
    counted = rows.where(F.col(value) > 0).withColumn("_n", F.count("*").over(per))
    scales = counted.where("_n = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.col(value))).alias("_v")).select(key, F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int")).alias("_scale"))
    judged = counted.join(scales, key, "left").where((F.col("_n") == 1) | F.col("_scale").isNotNull())
    off = F.abs(F.log10(F.col(value) / F.coalesce("_scale", F.col(value))))
    return judged.withColumn("_r", F.row_number().over(per.orderBy(off, value))).where("_r = 1").select(*rows.columns)


def readiness(latest: DataFrame, counted: DataFrame, as_of: Column, stale_days: int, least: int) -> DataFrame:
    """isin, status: ABSENT without rows, PARTIAL when stale or too few, else PRESENT. latest: isin, last; counted: isin, n."""
    rows = latest.join(counted, "isin", "full_outer")
    return rows.select("isin", F.when(F.coalesce("n", F.lit(0)) == 0, "ABSENT").when((F.datediff(as_of, "last") > stale_days) | (F.col("n") < least), "PARTIAL").otherwise("PRESENT").alias("status"))


def unrepeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that they repeat fails."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", F.when(times > 1, F.raise_error(F.lit(f"the source repeats a key of {keys}")).cast("long")).otherwise(times)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows in place of those with equal keys; an empty source changes nothing. A key that the source repeats fails."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(unrepeated(source, keys).select(*target.columns))


def fill_from_index(rows: DataFrame, index: DataFrame, keys: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """Rows whose columns take the index's values where it has any; the first index row by ``order`` counts."""
    best = index.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(best, keys, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def pending(work: DataFrame, done: DataFrame, refused: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is neither done nor refused."""
    return work.join(done.select(*keys), keys, "left_anti").join(refused.select(*keys), keys, "left_anti")


def disagreements(values: DataFrame, keys: list[str], value: str, limit: float = 0.01) -> DataFrame:
    """keys, low, high where models differ by more than ``limit``."""
    spread = values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return spread.where((F.col("n") > 1) & (relative_difference(F.col("low"), F.col("high")) > limit)).select(*keys, "low", "high")


def page_ranges(pages: DataFrame, key: str, page: str) -> DataFrame:
    """key, ranges: pages as "12-18,140"."""
    rows = pages.select(key, page).distinct().withColumn("_g", F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page)))
    spans = rows.groupBy(key, "_g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return spans.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def page_order(scores: DataFrame, key: str, page: str, score: str, strong: float = 8, weak: float = 4, after: int = 6) -> DataFrame:
    """Adds _r: the rank from the best on of pages that score ``weak``, and those up to ``after`` pages past a ``strong`` one; NULL for others."""
    near = Window.partitionBy(key).orderBy(page).rangeBetween(-after, 0)
    rows = scores.withColumn("_m", F.max(score).over(near)).withColumn("_k", F.coalesce((F.col(score) >= weak) | (F.col("_m") >= strong), F.lit(False)))
    best = Window.partitionBy(key).orderBy(F.desc("_k"), F.desc(score), page)
    return rows.withColumn("_r", F.when(F.col("_k"), F.row_number().over(best))).drop("_m", "_k")


def select_pages(scores: DataFrame, key: str, page: str, score: str, strong: float = 8, weak: float = 4, after: int = 6, budget: int = 60) -> DataFrame:
    """Pages that score ``weak``, and those up to ``after`` pages past a ``strong`` one; the best ``budget`` of each document."""
    return page_order(scores, key, page, score, strong, weak, after).where(F.col("_r") <= budget).select(*scores.columns)


def statement_frame(annual: DataFrame, keys: list[str], items: list[str], years: list[int]) -> DataFrame:
    """keys, item and a column fy{year} for each year: statements with items down and years across. Items without any amount have no row."""
    rows = annual.withColumn("_y", F.year("period_end_date")).unpivot([*keys, "_y"], items, "item", "amount").where("amount is not null")
    wide = rows.groupBy(*keys, "item").pivot("_y", years).agg(F.max("amount"))
    return wide.select(*keys, "item", *(F.col(str(y)).alias(f"fy{y}") for y in years))
