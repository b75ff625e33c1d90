import random
import time

from factorloom.llm.components import FREEING, connected_components, fresh, saved
from factorloom.llm.jaccard_groups import keep_one


def test_components_with_a_hub(spark):
    rng = random.Random(2)
    pairs = [(7, i) for i in range(100, 2100)] + [(i, i + 1) for i in range(3000, 3060)] + [(5000, 5000), (None, 4)] + [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_saved_rows_leave_no_shuffle_files(spark):
    def shuffled():
        return {b for b in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}

    setting, before = spark.conf.get(FREEING, None), shuffled()
    rows = spark.range(5000).selectExpr("id % 700 AS k", "id").groupBy("k").sum("id")
    kept = saved(rows)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(FREEING, None) == setting
    assert kept.count() == rows.count() == 700 and rows.count() == 700


def test_fresh():
    assert fresh("node", ["a"]) == "node" and fresh("node", ["Node", "node_"]) == "node__"


def test_keep_one_judges_rows_without_an_id(spark, docs, empty):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "other")
    rows = [(3, long, 1), (1, near, 2), (None, long, 3), (None, long, 4), (None, "quite another text of its own", 5), (8, None, 6), (9, "", 7), (4, "a text that is alone here", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "1 AS node", "'x' AS component_id")
    kept = keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.row for r in kept.collect()) == [2, 5, 6, 7, 8]
    assert keep_one(empty).count() == 0
