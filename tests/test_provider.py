"""The data source of companies and months: what is read for a filter, and that batch and stream agree."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorloom.sources import provider


@pytest.fixture
def source(spark, tmp_path):
    provider.register(spark)
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "until").write_text("2024-04-15")

    def read(stream=False):
        reader = spark.readStream if stream else spark.read
        return reader.format(provider.NAME).option("provider", "tests.file_provider:Noted").option("folder", str(folder)).load()

    def taken():
        names = sorted(p.name[5:] for p in folder.glob("read-*"))
        for p in folder.glob("read-*"):
            p.unlink()
        return names

    return read, taken, folder


def test_filters_choose_partitions(spark, source):
    read, taken, _ = source
    assert read().count() == 3 * 97 and len(taken()) == 12
    rows = read().where((F.col("isin") == "B") & (F.col("date") > "2024-01-30") & (F.col("date") <= "2024-02-03"))
    assert sorted((r.isin, str(r.date), r.value) for r in rows.collect()) == [("B", "2024-01-31", 31), ("B", "2024-02-01", 1), ("B", "2024-02-02", 2), ("B", "2024-02-03", 3)]
    assert taken() == ["B-2024-01-31-2024-01-31", "B-2024-02-01-2024-02-03"]
    rows = read().where(F.col("isin").isin("A", "C") & (F.col("date") == "2024-03-05") & (F.col("value") < 10))
    assert rows.count() == 2 and taken() == ["A-2024-03-05-2024-03-05", "C-2024-03-05-2024-03-05"]
    assert read().where("isin = 'A' AND isin = 'B'").count() == 0 and taken() == []
    assert read().where("date > '2025-01-01'").count() == 0 and taken() == []
    # what the source does not know is Spark's
    assert read().where("month(date) = 2 AND value = 29").count() == 3


def test_a_stream_tells_each_month_once(spark, source, tmp_path):
    read, taken, folder = source

    def run():
        query = read(stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return taken()

    assert len(run()) == 9 and run() == []  # April is not over
    (folder / "until").write_text("2024-04-30")
    assert run() == ["A-2024-04-01-2024-04-30", "B-2024-04-01-2024-04-30", "C-2024-04-01-2024-04-30"]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read().collect()))


def test_a_provider_must_be_named(spark):
    provider.register(spark)
    with pytest.raises(Exception, match="module:Class"):
        spark.read.format(provider.NAME).load().count()


class Many:
    schema, day = "isin int, date date", "date"

    def __init__(self, n):
        self.n = n

    def companies(self):
        return range(self.n)

    def read(self, isin, first, last):
        yield isin, first


def test_partitions_do_not_grow_with_companies():
    first, last = dt.date(2024, 1, 10), dt.date(2024, 6, 15)
    assert len(provider.shares(Many(20), None, first, last)) == 20 * 6
    parts = provider.shares(Many(50_000), None, first, last)
    assert len(parts) <= provider.MOST
    rows = [r for p in parts for r in provider._rows(Many(0), p)]
    assert sorted(rows) == [(c, a) for c in range(50_000) for a, _ in provider.months(first, last)]


def test_files_hold_groups_of_companies(spark, tmp_path):
    rows = spark.sql("SELECT id % 40 - 2 AS isin, date_add(DATE '2024-01-01', CAST(id DIV 40 AS INT)) AS date, id AS x FROM range(40 * 100) UNION ALL SELECT NULL, DATE '2024-02-02', -1L")
    path = str(tmp_path / "prices")
    rows.withColumn("group", F.pmod(F.coalesce("isin", F.lit(0)), F.lit(3))).repartition("group").write.partitionBy("group").parquet(path)
    provider.register(spark)
    options = {"provider": "factorloom.sources.provider:DailyFiles", "path": path, "groups": "3", "columns": "date date, x bigint", "first": "2024-01-10", "last": "2024-03-15"}
    got = spark.read.format(provider.NAME).options(**options).load()
    told = rows.where("date BETWEEN '2024-01-10' AND '2024-03-15'")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(told) and got.rdd.getNumPartitions() == 3
    few = F.col("isin").isin(-2, 1, 4, 997) & (F.col("date") > "2024-02-01")
    assert key(got.where(few)) == key(told.where(few)) and got.where(few).rdd.getNumPartitions() == 1
    stream = spark.readStream.format(provider.NAME).options(**options).load()
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(told.where("date < '2024-03-01'"))
