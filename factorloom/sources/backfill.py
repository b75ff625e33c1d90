"""News of past months, window by window: a queue that a log of results drives, so that a run that dies goes on where it stopped.

A window is a company and a month. Fetched, it is OK, also with no article at all; a
window that failed is an ERROR and comes again with the next run, as does one that the
provider throttled. Windows are taken in commits: what a commit fetched is stored first,
then the log, so a window is never logged before its articles are kept; one that is
fetched twice stores its articles once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalar import article_id, ist_from_utc, normalise_text, strip_legal_suffix, truncated
from factorloom.operators.serving import month_windows
from factorloom.shipping import ship
from factorloom.sources.store import KeyedTable

#: windows (isin, query, window_start, window_end) to the same with payload and error
Fetch = Callable[[DataFrame], DataFrame]
LOG_KEYS, ARTICLE_KEYS = ["provider", "isin", "window_start"], ["article_id", "isin"]
_ARTICLES = "struct<articles:array<struct<title:string,url:string,domain:string,seendate:string>>>"
_FETCHED = "isin {}, window_start date, payload string, error string"
#: letters of an error that the log keeps
DETAIL = 200


class Throttled(Exception):
    """The provider asks to slow down: the window has no result yet."""


@dataclass
class Backfill:
    """Articles of a provider with the log of its windows."""

    log: KeyedTable
    articles: KeyedTable
    provider: str
    fetch: Fetch
    #: no window begins before it
    epoch: str = "2017-01-01"

    def pending(self, companies: DataFrame, first: Column, last: Column) -> DataFrame:
        """isin, query, window_start, window_end without a result yet. companies: isin, name."""
        spark = companies.sparkSession
        if self.log.versions():
            done = self.log.read().where((F.col("provider") == self.provider) & (F.col("status") == "OK")).select(F.col("isin"), "window_start")
        else:
            done = spark.createDataFrame([], companies.select("isin", F.lit(None).cast("date").alias("window_start")).schema)
        windows = month_windows(companies, first, last, done, self.epoch)
        return windows.join(companies.select("isin", search_phrase(F.col("name")).alias("query")), "isin").select("isin", "query", "window_start", "window_end")

    def run(self, companies: DataFrame, first: Column, last: Column, at: Column, limit: int | None = None, commit: int = 10_000) -> tuple[int, int]:
        """Fetches what is pending, ``limit`` windows at most, ``commit`` at a time; how many are OK now, and how many failed. at: the time that the log tells."""
        ok = failed = 0
        pending = self.pending(companies, first, last).orderBy("isin", "window_start")
        todo = pending.limit(limit) if limit is not None else pending
        path = f"{self.log.path}/queue/{uuid.uuid4().hex}"
        todo.coalesce(1).withColumn("n", F.monotonically_increasing_id()).write.parquet(path)  # one row a company and month, numbered
        queue = companies.sparkSession.read.parquet(path)
        for start in range(0, queue.count(), commit):
            part = self.take(queue.where(F.col("n").between(start, start + commit - 1)).drop("n"), at)
            ok, failed = ok + part[0], failed + part[1]
        return ok, failed

    def take(self, windows: DataFrame, at: Column) -> tuple[int, int]:
        """Fetches these windows and commits what came of them: articles, then the log."""
        path = f"{self.log.path}/fetched/{uuid.uuid4().hex}"
        self.fetch(windows).select("isin", "window_start", "payload", "error").join(windows.select("isin", "window_start", "window_end"), ["isin", "window_start"]).write.parquet(path)  # asked once
        fetched = windows.sparkSession.read.parquet(path)
        rows = parse_articles(fetched)
        self.articles.upsert(rows.dropDuplicates(ARTICLE_KEYS))
        counted = rows.groupBy("isin", "window_start").agg(F.count("*").cast("int").alias("articles"))
        told = fetched.withColumn("error", F.coalesce("error", F.when(~readable(F.col("payload")), "throttled"))).join(counted, ["isin", "window_start"], "left")
        fine = F.col("error").isNull()
        log = told.select(
            F.lit(self.provider).alias("provider"), "isin", "window_start", "window_end",
            F.when(fine, F.coalesce("articles", F.lit(0))).otherwise(F.lit(0)).alias("articles"),
            F.when(fine, "OK").otherwise("ERROR").alias("status"), truncated(F.col("error"), DETAIL).alias("detail"), at.alias("fetched_at"),
        )
        self.log.upsert(log)
        sums = told.agg(F.count_if(fine), F.count_if(~fine)).first()
        return sums[0], sums[1]


def search_phrase(name: Column) -> Column:
    """The question for a company: its name without legal suffixes, as a phrase, in English sources."""
    return F.concat(F.lit('"'), strip_legal_suffix(normalise_text(name)), F.lit('" sourcelang:english'))


def readable(payload: Column) -> Column:
    """Whether a payload is an answer: JSON, or nothing at all. Anything else is a request to slow down."""
    return (F.coalesce(F.trim(payload), F.lit("")) == "") | F.try_parse_json(payload).isNotNull()


def parse_articles(fetched: DataFrame) -> DataFrame:
    """article_id, isin, window_start, source, url, headline, published_at (Indian time) of articles with a title, an address and a time."""
    listed = fetched.where("error IS NULL").where(readable(F.col("payload"))).select("isin", "window_start", F.explode(F.from_json("payload", _ARTICLES)["articles"]).alias("a"))
    seen = F.try_to_timestamp(F.trim("a.seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'")).cast("timestamp_ntz")
    rows = listed.select("isin", "window_start", F.coalesce("a.domain", F.lit("unknown")).alias("source"), F.trim("a.url").alias("url"), F.trim("a.title").alias("headline"), ist_from_utc(seen).alias("published_at"))
    rows = rows.where("headline <> '' AND url <> '' AND published_at IS NOT NULL")
    return rows.select(article_id(F.col("url"), F.col("headline"), F.col("published_at")).alias("article_id"), "*")


def per_window(ask: Callable[[str, object, object], str], lanes: int = 1, attempts: int = 4, delay: float = 5.0) -> Fetch:
    """A ``Fetch`` that asks window by window, in ``lanes`` tasks at a time, each with ``delay`` seconds between requests.

    ``ask`` takes the query and the window's days and returns a payload. A throttled window
    is asked again after twice the delay, then four times; what still fails is an error.
    Spark may run a task twice, and a window is then asked twice.
    """

    def one(query: str, start: object, end: object) -> tuple[str | None, str | None]:
        for attempt in range(attempts):
            if attempt:
                time.sleep(delay * 2**attempt)
            try:
                payload = ask(query, start, end)
                if payload.strip():
                    try:
                        json.loads(payload)
                    except ValueError as text:
                        raise Throttled(payload) from text
                return payload, None
            except Throttled:
                continue
            except Exception as failed:  # whatever a network or a provider does is this window's error alone
                return None, str(failed) or type(failed).__name__
        return None, "throttled"

    def fetch(windows: DataFrame) -> DataFrame:
        ship(windows.sparkSession)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries, starts, ends = (batch[c].to_pylist() for c in ("query", "window_start", "window_end"))
                for k in range(batch.num_rows):
                    payload, error = one(queries[k], starts[k], ends[k])
                    yield pa.RecordBatch.from_arrays([batch["isin"].slice(k, 1), batch["window_start"].slice(k, 1), pa.array([payload], pa.string()), pa.array([error], pa.string())], names=["isin", "window_start", "payload", "error"])
                    time.sleep(delay)

        return windows.repartition(lanes).mapInArrow(asked, _FETCHED.format(windows.schema["isin"].dataType.simpleString()))

    return fetch
