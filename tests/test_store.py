"""Kept tables: versions, dying and competing writers, keys, changing schemas."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.sources import sinks as K
from factorloom.sources.evolution import changes, evolved
from factorloom.sources.store import Conflict, KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    t.replace(spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k int, v string"))
    return t


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, table):
    before = table.manifest()["folders"]
    assert table.upsert(spark.createDataFrame([(3, "new")], "k int, v string")) == 2
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 4
    assert rows(table.read()) == sorted((i, "new" if i == 3 else f"v{i}") for i in range(40))
    assert rows(table.read(1)) == sorted((i, f"v{i}") for i in range(40))


def test_a_writer_that_dies_before_the_manifest_changes_nothing(spark, table, monkeypatch):
    pinned = table.read()

    def die(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", die)
        for change in (lambda: table.upsert(spark.createDataFrame([(1, "x"), (99, "y")], "k int, v string")), lambda: table.replace(table.read().limit(0)), lambda: table.delete(spark.createDataFrame([(2,)], "k int"))):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert table.versions() == [1] and rows(table.read()) == rows(pinned) and len(rows(pinned)) == 40
    # its files are in no version, and go with the next clearing
    assert table.delete(spark.createDataFrame([(2,)], "k int")) == 2
    assert len(table.vacuum(keep=1)) >= 3 and table.read().count() == 39 and table.versions() == [2]


def test_the_second_of_two_writers_is_refused(spark, table, monkeypatch):
    other = KeyedTable(spark, table.path, ["k"])
    base = other.manifest()
    table.upsert(spark.createDataFrame([(1, "first")], "k int, v string"))
    with monkeypatch.context() as m:
        m.setattr(other, "manifest", lambda version=None: base)
        with pytest.raises(Conflict):
            other.upsert(spark.createDataFrame([(1, "second")], "k int, v string"))
    assert table.read().where("k = 1").first().v == "first"
    other.upsert(spark.createDataFrame([(1, "second")], "k int, v string"))
    assert table.read().where("k = 1").first().v == "second" and table.versions() == [1, 2, 3]


def test_keys_that_repeat_or_are_missing_fail(spark, table):
    for bad, what in (([(1, "a"), (1, "b")], "repeats a key"), ([(None, "a")], "lacks its key: k")):
        for write in (table.upsert, table.replace):
            with pytest.raises(Exception, match=what):
                write(spark.createDataFrame(bad, "k int, v string"))
    assert table.versions() == [1]
    with pytest.raises(ValueError, match="not among the keys"):
        table.delete(spark.createDataFrame([("v1",)], "v string"))


def test_parts_of_a_key_and_empty_changes(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["run", "day"])
    with pytest.raises(ValueError, match="no version"):
        t.read()
    t.upsert(spark.createDataFrame([(r, d, r * d) for r in (1, 2) for d in range(5)], "run int, day int, x int"))
    t.delete(spark.createDataFrame([(1,), (1,)], "run int"))
    t.upsert(t.read().limit(0))
    t.delete(t.read().limit(0).select("run", "day"))
    assert rows(t.read()) == [(2, d, 2 * d) for d in range(5)]
    t.replace(t.read().limit(0))
    assert t.read().columns == ["run", "day", "x"] and t.read().count() == 0


def test_evolution():
    parse = lambda s: StructType.fromDDL(s)
    old, new = parse("a int, b double, c string, d decimal(10,2), e date"), parse("a bigint, b float, d decimal(12,3), e timestamp, f array<int>")
    assert changes(old, new) == [("a", "WIDENED", "int -> bigint"), ("b", "NARROWED", "double -> float"), ("c", "MISSING", "string"), ("d", "WIDENED", "decimal(10,2) -> decimal(12,3)"), ("e", "WIDENED", "date -> timestamp"), ("f", "ADDED", "array<int>")]
    assert evolved(old, new).simpleString() == "struct<a:bigint,b:double,c:string,d:decimal(12,3),e:timestamp,f:array<int>>"
    with pytest.raises(ValueError, match="c .string -> int."):
        evolved(old, parse("c int"))


def test_rows_of_several_schemas(spark, table):
    table.upsert(spark.createDataFrame([(1, 0.5)], "k bigint, w double"))
    table.upsert(spark.createDataFrame([(10**12, "big")], "k bigint, v string"))
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert got[1] == (None, 0.5) and got[2] == ("v2", None) and got[10**12] == ("big", None) and len(got) == 41
    assert table.schema_changes(1, 3) == [("k", "WIDENED", "int -> bigint"), ("w", "ADDED", "double")]
    assert table.read(1).schema["k"].dataType.simpleString() == "int"


def test_scores_go_with_the_rows_that_a_resolution_removes(spark, tmp_path):
    news, scores = KeyedTable(spark, str(tmp_path / "n"), ["id", "isin"]), KeyedTable(spark, str(tmp_path / "s"), ["id", "isin"])
    old = [("a", 1, "HEADLINE", 0.9), ("b", 1, "HEADLINE", 0.9), ("c", 2, "BODY", 0.7)]
    schema = "id string, isin int, method string, confidence double"
    news.replace(spark.createDataFrame(old, schema))
    scores.replace(news.read().select("id", "isin", F.lit(1.0).alias("score")))
    K.reresolve(news, scores, spark.createDataFrame([old[0], ("b", 2, "BODY", 0.6), ("c", 2, "HEADLINE", 0.9)], schema), "id")
    assert rows(news.read()) == [("a", 1, "HEADLINE", 0.9), ("b", 2, "BODY", 0.6), ("c", 2, "HEADLINE", 0.9)]
    assert [r[:2] for r in rows(scores.read())] == [("a", 1), ("c", 2)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "50kb")
    try:
        t.replace(spark.range(0, 60_000, 1, 4).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.unset(size)
    for folder in t.manifest()["folders"].values():
        assert len(list((tmp_path / "t" / folder["at"]).glob("*.parquet"))) > 1
    assert t.read().count() == 60_000
    t.delete(spark.range(30_000).withColumnRenamed("id", "k"))
    assert rows(t.read().agg(F.min("k"), F.count("*"))) == [(30_000, 30_000)]


def test_a_resolution_is_stored_in_one_version_and_a_replacement_is_written_once(spark, tmp_path):
    news, scores = KeyedTable(spark, str(tmp_path / "n"), ["id", "isin"]), KeyedTable(spark, str(tmp_path / "s"), ["id", "isin"])
    schema = "id string, isin int, method string, confidence double"
    news.replace(spark.createDataFrame([("a", 1, "HEADLINE", 0.9), ("b", 1, "HEADLINE", 0.9)], schema))
    assert len(list((tmp_path / "n" / "data").iterdir())) == 1  # no copy beside the version's own files
    scores.replace(news.read().select("id", "isin", F.lit(1.0).alias("score")))
    new = [("a", 1, "BODY", 0.6, "x"), ("d", 4, "HEADLINE", 0.9, "y"), ("e", None, "HEADLINE", 0.9, "z")]
    K.reresolve(news, scores, spark.createDataFrame(new, schema + ", why string"), "id")
    assert news.versions() == [1, 2] and rows(news.read()) == new[:2]  # what goes and what comes is one change
    assert [r[:2] for r in rows(scores.read())] == [("a", 1)]
    with pytest.raises(Exception, match="repeats a key"):
        K.reresolve(news, scores, spark.createDataFrame([new[0][:4], ("a", 1, "HEADLINE", 0.9)], schema), "id")
    assert news.versions() == [1, 2] and scores.versions() == [1, 2]
