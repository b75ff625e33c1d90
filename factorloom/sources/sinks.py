"""What is stored: keyed tables, memberships, runs, exports and reviews. Each function maps the stored rows to the new ones."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.news import resolution_changes
from factorloom.operators.statements import unrepeated, upsert
from factorloom.sources.store import KeyedTable


def backfill_start(membership: DataFrame, index_name: str, start: Column) -> DataFrame:
    """Memberships of an index that begin after ``start`` begin there. This assumes a past that no list tells, so no coverage is recorded."""
    moved = (F.col("index_name") == index_name.upper()) & (F.col("from_date") > start)
    return membership.withColumn("from_date", F.when(moved, start).otherwise(F.col("from_date")))


def load_history(membership: DataFrame, coverage: DataFrame, index_name: str, history: DataFrame, verified_from: Column, verified_to: Column, source: str) -> tuple[DataFrame, DataFrame]:
    """Memberships with a verified history put in, and coverage with a row for it. history: isin, from_date, to_date."""
    missing = {"isin", "from_date", "to_date"} - set(history.columns)
    if missing:
        raise ValueError(f"the history lacks {sorted(missing)}")
    named = history.select(F.lit(index_name.upper()).alias("index_name"), "isin", "from_date", "to_date")
    row = history.sparkSession.range(1).select(F.lit(index_name.upper()).alias("index_name"), verified_from.alias("verified_from"), verified_to.alias("verified_to"), F.lit(source).alias("source"))
    return upsert(membership, named, ["index_name", "isin", "from_date"]), upsert(coverage, row, ["index_name", "verified_from"])


def last_of_each(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One record of each key: the last in ``order``."""
    newest = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return records.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def rebuild(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of all that the table has; rows must not be read from it."""
    rows.write.mode("overwrite").parquet(path)


def run_id(config: dict) -> str:
    """A name for a configuration: equal settings in any order have equal names."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


def run_ids(rows: DataFrame, columns: list[str], out: str = "run_id") -> DataFrame:
    """Adds ``run_id`` of the settings in ``columns`` (texts, numbers and truth values) for each row."""
    value = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}), r"^\[|\]$", ""), F.lit("null"))
    parts = [F.concat(F.lit(f"{json.dumps(c)}: "), value(c)) for c in sorted(columns)]
    return rows.withColumn(out, F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 8))


def backtest_tables(config: dict, curve: DataFrame, weights: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """Tables of a backtest: its run (run_id, config, metrics as JSON), nav and positions, each with run_id."""
    name = F.lit(run_id(config)).alias("run_id")
    run = metrics.select(name, F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"), F.to_json(F.struct(*metrics.columns)).alias("metrics"))
    return {"runs": run, "nav": curve.select(name, "date", "nav", "gross_nav", "costs"), "positions": weights.select(name, F.col("as_of").alias("date"), "isin", "weight")}


def export_rows(signals: DataFrame, flags: str = "red_flags") -> DataFrame:
    """Rows for a spreadsheet: names of flags joined by semicolons, nothing where there is none."""
    return signals.withColumn(flags, F.regexp_replace(F.coalesce(flags, F.lit("")), ",", ";"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def decide(reviews: DataFrame, fundamentals: DataFrame, decisions: DataFrame, attempts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reviews and fundamentals after decisions (attempt_id, status, notes, force).

    REJECTED takes the attempt's rows out of fundamentals, and no others; ACCEPTED with
    ``force`` puts the attempt's row in for its key. A decision of another status, or on an
    attempt that is not under review, fails when the reviews are made.
    """
    known = F.col("status").isin("ACCEPTED", "REJECTED")
    checked = decisions.withColumn("status", F.upper("status")).withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.lit("status must be ACCEPTED or REJECTED")).cast("string")))
    listed = reviews.select("attempt_id", F.lit(True).alias("_listed"))
    checked = checked.join(listed, "attempt_id", "left").withColumn("attempt_id", F.when(F.col("_listed"), F.col("attempt_id")).otherwise(F.raise_error(F.lit("no review of this attempt")).cast(decisions.schema["attempt_id"].dataType))).drop("_listed")
    told = checked.select("attempt_id", F.col("status").alias("_s"), F.col("notes").alias("_n"))
    after = reviews.join(told, "attempt_id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("notes", F.coalesce("_n", "notes")).select(reviews.columns)
    kept = fundamentals.join(checked.where("status = 'REJECTED'").select("attempt_id"), "attempt_id", "left_anti")
    forced = attempts.join(checked.where("status = 'ACCEPTED' and force").select("attempt_id"), "attempt_id", "left_semi").select(fundamentals.columns)
    return after, upsert(kept, forced, keys)


def reresolve(news: KeyedTable, scores: KeyedTable, new: DataFrame, id_col: str) -> None:
    """Puts a new resolution in place of the stored one; scores of (id, isin) that it no longer holds go first, so that no reader finds a score without its row's reason.

    A row of ``new`` without id or isin is not stored; a key that ``new`` repeats fails.
    """
    keys = [id_col, "isin"]
    named = unrepeated(new.dropna(subset=keys), keys)
    changes = news.stage(resolution_changes(news.read(), named, id_col, [c for c in new.columns if c not in keys]))
    gone = F.col("change") == "REMOVED"
    scores.delete(changes.where(gone).select(*keys))
    news.change(changes, gone, ["change"])
