"""The work queue of past news: what is asked again, what is not, and what survives a run that dies."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from factorloom.sources import backfill as H
from factorloom.sources.store import KeyedTable

JANUARY = {"articles": [{"url": "https://x.com/a", "title": "Tata Motors Q1 profit", "seendate": "20240110T200000Z", "domain": "x.com"}, {"url": "https://x.com/b", "title": " ", "seendate": "20240110T100000Z"}, {"url": "https://x.com/c", "title": "no time", "seendate": "soon"}]}


@pytest.fixture
def queue(spark, tmp_path):
    def make(fetch):
        return H.Backfill(KeyedTable(spark, str(tmp_path / "log"), H.LOG_KEYS, 2), KeyedTable(spark, str(tmp_path / "articles"), H.ARTICLE_KEYS, 2), "p", fetch)

    return make


@pytest.fixture
def companies(spark):
    return spark.createDataFrame([("TM", "Tata Motors Ltd"), ("X", "The X & Co. Limited")], "isin string, name string")


def run(queue, companies, day=1, **more):
    return queue.run(companies, F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"), F.lit(f"2024-03-0{day}").cast("date"), **more)


def asking(folder, answer):
    """A provider whose calls are noted in ``folder``, whichever process makes them."""

    def ask(query, start, end):
        path = pathlib.Path(folder, f"{start}{query}".replace('"', ""))
        n = len(path.read_text()) if path.exists() else 0
        path.write_text("x" * (n + 1))
        return answer(query, start, n)

    return H.per_window(ask, lanes=2, attempts=2, delay=0.0)


def calls(folder):
    return {p.name.split()[0][:10] + p.name[10:12]: len(p.read_text()) for p in pathlib.Path(folder).iterdir()}


def test_windows_are_asked_until_they_have_a_result(spark, queue, companies, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def answer(query, start, n):
        if start.month == 2:
            return "Please limit requests to one every 5 seconds" if query.startswith('"tata') and n < 3 else ""
        if query.startswith('"tata'):
            return json.dumps(JANUARY)
        raise OSError("no route " + "x" * 300)

    q = queue(asking(folder, answer))
    assert {(r.isin, r.query, r.window_end) for r in q.pending(companies, F.lit("2024-01-05").cast("date"), F.lit("2024-02-10").cast("date")).where("month(window_start) = 2").collect()} == {("TM", '"tata motors" sourcelang:english', dt.date(2024, 2, 10)), ("X", '"x" sourcelang:english', dt.date(2024, 2, 10))}
    assert run(q, companies) == (2, 2)
    log = {(r.isin, r.window_start.month): r for r in q.log.read().collect()}
    assert [(log[k].status, log[k].articles, log[k].detail) for k in (("TM", 1), ("TM", 2), ("X", 2))] == [("OK", 1, None), ("ERROR", 0, "throttled"), ("OK", 0, None)]
    assert log["X", 1].status == "ERROR" and log["X", 1].detail == ("no route " + "x" * 300)[:200]
    assert [tuple(r) for r in q.articles.read().select("isin", "headline", "source", F.col("published_at").cast("string")).collect()] == [("TM", "Tata Motors Q1 profit", "x.com", "2024-01-11 01:30:00")]
    # a throttled window is asked twice in a run, and again in the next one; windows with a result are not
    assert run(q, companies, 2) == (1, 1) and run(q, companies, 3) == (0, 1)
    assert sorted(calls(folder).values()) == [1, 1, 3, 4]
    assert {r.status for r in q.log.read().where("isin = 'TM'").collect()} == {"OK"} and q.articles.read().count() == 1


def test_a_run_that_dies_between_articles_and_log_goes_on(spark, queue, companies, monkeypatch):
    q = queue(H.per_window(lambda query, start, end: json.dumps(JANUARY), lanes=1, delay=0.0))
    with monkeypatch.context() as m:
        m.setattr(q.log, "upsert", lambda rows: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(q, companies)
    assert q.log.versions() == [] and q.articles.read().count() == 2
    # one commit at a time: what is logged stays, although the second commit dies
    committed = []
    whole = q.log.upsert
    with monkeypatch.context() as m:
        m.setattr(q.log, "upsert", lambda rows: whole(rows) if not committed and not committed.append(1) else (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run(q, companies, commit=3)
    assert q.log.read().count() == 3
    assert run(q, companies, 2) == (1, 0) and q.log.read().count() == 4 and q.articles.read().count() == 2
    assert run(q, companies, 3) == (0, 0)


def test_limits_and_no_companies(spark, queue, companies):
    q = queue(H.per_window(lambda query, start, end: "", lanes=1, delay=0.0))
    assert run(q, companies, limit=1) == (1, 0) and run(q, companies, limit=10) == (3, 0)
    assert run(q, companies.limit(0)) == (0, 0)
