"""The pipeline's stages against brute force, and over odd rows."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from factorloom.llm import secret_scan
from factorloom.llm.subwords import Subwords
from factorloom.llm.toxicity import toxicity_scores
from tests.llm.test_decontamination import brute as brute_overlap
from tests.llm.test_secret_scan import brute as brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets, and the last one's result."""
    rows = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, rows[-1], SF).write.parquet(path)
        rows.append(spark.read.parquet(path))
    return rows


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_toxicity_stage(spark, stages):
    scores = toxicity_scores(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(stages[1]) == {r.doc_id for r in scores if r.score < 0.3} and stages[1].columns == stages[0].columns


def test_jaccard_stage(stages):
    sets = {}
    for r in stages[1].select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and least[a] != least[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, changed = min(least[a], least[b]), True
                    least[a] = least[b] = low
    assert ids(stages[2]) == {d for d in sets if least[d] == d}


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect() if not any(brute_overlap(r.text or "", t) for t in items)}
    assert ids(stages[3]) == want


def test_secret_stage(stages):
    before = [(r.doc_id, r.text, r.lang, r.source) for r in stages[3].collect()]
    spans = brute_spans(before)
    want = {d: secret_scan.masked(t, spans[d, t], "[secret]") if spans[d, t] else t for d, t, _, _ in before}
    assert {r.doc_id: r.text for r in stages[4].collect()} == want


def test_packing_stage(stages):
    encoder = Subwords().tokenizer
    want = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in stages[5].collect():
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == want
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048


def test_odd_rows_and_empty_tables(spark, docs, empty):
    rows = docs.selectExpr("*", "'x' AS _h", "1 AS node", "2 AS key", "3 AS spans", "4 AS none", "5 AS _id")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, rows, SF)
        if name != "packing":
            assert out.columns == rows.columns, name
        assert out.count() > 100, name
