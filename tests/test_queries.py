"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from factorloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))


def test_every_query_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
    assert registry.queries()["b2_backtest"](spark, SF).count() > 0


def test_a_page_is_cut_however_little_is_left(spark, tmp_path):
    rows = [(1, "a" * 19_900, "en", "web"), (2, "b" * 500, "en", "web"), (3, "c", "en", "web"), (4, "d" * 30_000, "de", "web")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    from factorloom.plans import more

    got = more.e8_page_budget(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("web-de", 4, 20_000), ("web-en", 1, 19_900), ("web-en", 2, 100)]
