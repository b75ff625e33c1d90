import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import decontamination, embedding_dedup, html_text, language_model, secret_scan, toxicity
from factorloom.llm.components import connected_components
from factorloom.llm.packing import pack_documents, plan_bins
from factorloom.llm.subwords import Subwords

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want.update((r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = pack_documents(docs, size=256, keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert all(b[0] == a[0] + a[1] for a, b in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert pack_documents(empty).count() == 0


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = [1, 1, 0]
    counts[[2]] = 3
    assert sum(n for _, n in plan_bins(counts, 10)) == 2
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 15]] = 1
    # 60 and 30 leave 10; 25 and 15 fill the gap of 40 that 30 leaves
    assert plan_bins(counts, 100)[0] == ([60, 25, 15], 1)


def test_secret_spans(docs, empty):
    rows = secret_scan.scan_secrets(docs).collect()
    assert len(rows) == docs.count()
    by_text = {(r.doc_id, r.h): r for r in rows}
    for r in docs.withColumn("hh", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text", "hh").collect():
        spans = []
        for k, (p, group, least) in enumerate(((secret_scan.ASSIGN, 2, 6), (secret_scan.ACCESS, 0, 20), (secret_scan.HEX, 0, 24))):
            spans += [(m.start(), k, m.end()) for m in p.finditer(r.text or "") if len(m[group]) >= least]
        want = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        got = by_text[r.doc_id, r.hh]
        assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in got.spans.split(",") if not x.startswith("owned")] == want.split(",") or (not got.spans and not want) or got.spans.startswith("owned")
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
    assert secret_scan.scan_secrets(empty).count() == 0


def test_failing_matches_are_consumed():
    assert secret_scan.base_spans("secret: token : abcdefgh") == []
    assert [s[:3] for s in secret_scan.base_spans("Api_Key = 'abcdef' ſecret=abcdefg")] == [(0, 17, "assign")]


def test_ownership_separates_copied_examples(spark):
    live, copied = "Zx9" + "kQ7pLm2Wv8Rt4Yb1Nc6", "Ab3dEf6hIj9lMn2pQr5t"
    rows = [(i, f"see {copied} here", "en", f"s{i}", 1) for i in range(8)] + [(100, f"see {live} here", "en", "s1", 1)]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[100] == f"owned:4:{4 + len(live)}" and not any(got[i] for i in range(8))


def test_redact(spark, docs):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.text for r in out.where("doc_id = 10008").collect()}
    assert texts == {"[secret] [secret]"}


def test_lm_base_scores(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(repr((r.doc_id, held(r.doc_id), len(words(r.text)), sum(w in counts for w in words(r.text)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r.text)), 5))) for r in rows)
    got = language_model.lm_scores(docs).collect()
    assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    test = [r for r in got if r.held_out]
    assert -sum(r.score for r in test) * math.log2(10) / sum(r.n_ids for r in test) < 10  # bits an id; 50,257 ids would take 15.6
    assert language_model.lm_scores(empty).count() == 0


def test_attention_gradients_and_odds():
    rng = np.random.default_rng(0)
    model = language_model.Attention(np.log(rng.dirichlet(np.ones(language_model.CLASSES), language_model.CLASSES + 1)))
    ids = rng.integers(0, language_model.CLASSES, 400).astype(np.uint8)
    windows, text, real = language_model.windows_of(ids, np.array([330, 70]), np.array([0, 330]))
    assert real.sum() == 400 and (np.bincount(text[np.repeat(np.arange(len(text)), real.sum(axis=1))]) == [330, 70]).all()
    before = model.score(windows)[real].mean()
    for _ in range(30):
        model.learn(windows, real)
    assert model.score(windows)[real].mean() > before
    # a class's odds add up to 1
    one = np.repeat(windows[:1], language_model.CLASSES, axis=0)
    one[:, language_model.CONTEXT] = np.arange(language_model.CLASSES)
    assert abs(np.exp(model.score(one)[:, 0].astype(float)).sum() - 1) < 1e-3


def test_attention_learns_from_all_windows(spark):
    # after each "a", what comes next depends on what stood before it: pairs of classes cost 0.5 bits an id
    frame = spark.createDataFrame([(i, " a b a c" * 400 + f" {'d' * (i % 7)}") for i in range(100)], "doc_id long, text string").repartition(8)
    test = language_model.lm_scores(frame).where("held_out").collect()
    assert -sum(r.score for r in test) * math.log2(10) / sum(r.n_ids for r in test) < 0.4
    # fewer windows than a step has
    classes, packed = language_model.Classes(np.arange(1 << 16, dtype=float)), [language_model.pack_ids(np.arange(n, dtype=np.uint16)) for n in (70, 1)]
    model = language_model.Attention(np.zeros((language_model.CLASSES + 1, language_model.CLASSES)), of=classes.of)
    language_model.teach(model, [pa.RecordBatch.from_pydict({"h": [3, 5], "ids": packed})])
    assert model.n == 4
    assert np.abs(model.w["out"]).max() > 0


def test_attention_tells_ids_of_a_class_apart():
    rng = np.random.default_rng(1)
    of = np.append(np.arange(40), np.full(60, 40)).astype(np.uint8)  # ids 40 to 99 are of one class
    lead = rng.integers(60, 100, 4000)
    ids = np.stack([lead, np.full(4000, 7), lead % 2], axis=1).ravel().astype(np.uint16)  # an odd one has 1 behind it, an even one 0
    follow = np.full((language_model.CLASSES + 1, language_model.CLASSES), 0.01)
    np.add.at(follow, (np.append(language_model.CLASSES, of[ids][:-1]), of[ids]), 1)
    model = language_model.Attention(np.log(follow / follow.sum(axis=1, keepdims=True)), of=of)
    windows, _, real = language_model.windows_of(ids, np.array([len(ids)]), np.array([0]), model.before)
    for _ in range(30):
        for a in range(0, len(windows), 64):
            model.learn(windows[a : a + 64], real[a : a + 64])
    scores = model.score(windows)[real][2::3]
    assert -scores.mean() < 0.3  # log(2) if the ids were alike


def test_a_step_of_learning_takes_no_new_memory_and_texts_are_encoded_whole():
    rng = np.random.default_rng(2)
    model = language_model.Attention(np.log(rng.dirichlet(np.ones(language_model.CLASSES), language_model.CLASSES + 1)))
    windows, _, real = language_model.windows_of(rng.integers(0, language_model.CLASSES, 6000).astype(np.uint8), np.array([6000]), np.array([0]))
    model.learn(windows, real)
    held = dict(model._held)
    # gradients by hand, of the rows that odds are worked out from; a smaller step works in the same arrays
    few, weight = windows[:20], np.full(20 * language_model.STEP, 1 / (20 * language_model.STEP), np.float32)
    loss = lambda: -model.score(few).mean(dtype=float)
    grad = {n: g.copy() for n, g in model.gradients(few, weight)[0].items()}
    assert all(model._held[n] is x for n, x in held.items())
    for name, at in (("out", (3, 5)), ("qkv", (2, 7)), ("qkv", (4, 20)), ("qkv", (1, 40)), ("near", (2,))):
        was, told = model.w[name][at], []
        for step in (0.05, -0.05):
            model.w[name][at], model._known = was + step, None
            told.append(loss())
        model.w[name][at], model._known = was, None
        assert abs((told[0] - told[1]) / 0.1 - grad[name][at]) < 0.05 * max(abs(float(g)) for g in grad[name].ravel())
    # every text is a word that comes once
    subwords = Subwords()
    texts = ["a word's  two\n\nlines\t", "", " \x1cx \x00", "中文 ab\u00a0 c\x85", "<|endoftext|> x <|endoftext|>", " " * 250_000 + "b", *("".join(rng.choice(list("ab c\n1é-'"), 30)) for _ in range(300))]
    got = subwords.each(texts)
    assert not any(t in subwords._index for t in texts[6:]) and len(subwords._index) < 60  # no chunk is kept of those that are encoded whole
    ids, at = subwords.encode(texts)
    assert [g.tolist() for g in got] == [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_toxicity(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxic_wording_in_long_runs():
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefghiklmnoprstu", k=6)) for _ in range(300)]
    bad = ["vexmordul", "zaptrinok", "毒恶辱骂语句"]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (bad if i % 4 < 1 + i % 2 and i % 3 == 0 else [])), int(i % 4 < 1 + i % 2 and i % 3 == 0)) for i in range(800)]
    gains = toxicity.Gains(toxicity.fit(rows))
    for sep in (" ", "-", "_", ""):
        clean = sep.join(plain[:60])
        assert gains.score(clean) < 0.3 <= gains.score(sep.join([clean, *bad])), sep
    assert gains.score("天地玄黄宇宙洪荒" * 20) < 0.3 <= gains.score("天地玄黄宇宙洪荒" * 20 + "毒恶辱骂语句" + "日月盈昃辰宿列张" * 9)
    for n in (1, 64, 65, 96, 97, 1000):
        word = "".join(rng.choices("abcdef", k=n))
        windows = toxicity.windows_of(word)
        assert all(0 < len(w) <= 64 for w in windows) and all(any(word[a : a + 32].encode() in w for w in windows) for a in range(n))


def test_toxicity_keeps_the_odds_of_a_sample(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdefghiklmnoprstu", k=6)) for _ in range(300)]
    # one text in ten is toxic, and nothing in its wording shows it
    frame = spark.createDataFrame([(i, " ".join(rng.choices(plain, k=20)), int(i % 10 == 0)) for i in range(2000)], "doc_id long, text string, toxic int")
    for sample in (3000, 400, 60):
        scored = toxicity.toxicity_scores(frame.drop("toxic"), frame.drop("text"), sample=sample)
        assert abs(scored.agg(F.avg("score")).first()[0] - 0.1) < 0.08, sample


def test_toxicity_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8


def test_main_text(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>x<b>y</b></p><div class="ad">buy</div><section class="comments"><p>I like it</p></section></article><script>var t="</p>";</script><footer>end</footer></body></html>'
    assert html_text.main_text(page) == "A & B\none two three\nxy"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, None, "<p>" + "word " * 5000)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 22, 22, 24_999]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.vstack([base, base[:20] + 0.12 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, axis=0), base[:5] * 3])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, [1.0] * 8, 0), (None, [1.0] * 16, 0), (906, [float("inf")] + [1.0] * 15, 0)]
    rows += [(907, [1e-200] * 4, 0), (908, [1e200] * 4, 0), (909, [1e-310, -1e-310, 0.0, 0.0], 0), (910, [1e308, -1e308, 0.0, -0.0], 0)]  # squares out of range
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS vec")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(frame).collect()}
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.95
    i, j = np.nonzero(near)
    label = embedding_dedup.least_labels(len(x), i, j)
    want = {k: (int(near[k].sum()) - 1, int(label[k]), bool(label[k] == k)) for k in range(len(x))}
    want |= {k: (0, k, True) for k in (900, 901, 902, 903, 904, 905, 906)} | {None: (0, None, False)}
    want |= {907: (1, 907, True), 908: (1, 907, False), 909: (1, 909, True), 910: (1, 909, False)}
    assert got == want


def test_embedding_recall_on_a_table(spark):
    """Against all pairs of the whole table."""
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect() if r.embedding is not None and None not in r.embedding]
    x = np.array([v for _, v in rows], float)
    fine = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
    ids, x = np.array([i for i, _ in rows])[fine], x[fine]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = {int(i): 0 for i in ids}
    for a in range(0, len(x), 1000):
        for i, n in zip(ids[a : a + 1000], (unit[a : a + 1000] @ unit.T >= 0.95).sum(axis=1) - 1):
            want[int(i)] += int(n)
    got = {r.vec_id: r.n_links for r in embedding_dedup.embedding_near_dedup(frame).collect()}
    found = sum(min(got[i], n) for i, n in want.items())
    assert found >= 0.999 * sum(want.values()) and all(got[i] <= n for i, n in want.items())


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(16) + 0.05 * rng.standard_normal((60, 16))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = embedding_dedup.embedding_near_dedup(frame).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(59, 0)}


def test_decontamination_equals_sql(spark):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, item_id, doc_start, item_start, n_words, n_matched FROM ({decontamination.ORACLE_SQL})").fetchall())
    got = decontamination.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched")
    assert sorted(map(tuple, got.collect())) == want and want


def test_decontamination_tolerates_substitutions(spark, docs, empty):
    words = [f"w{i}" for i in range(30)]
    changed = [w if i % 7 else "z" for i, w in enumerate(words)]
    rows = [(1, "a b c " + " ".join(changed).upper() + " d e"), (2, " ".join(words[:9]) + " " + " ".join("xyz" * 10)), (3, "short one here"), (None, " ".join(words))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS w")
    bench = spark.createDataFrame([(5, " ".join(words)), (6, "Short  one"), (7, None), (None, "a b c d e f g h i j")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == {(1, 5), (3, 6)}
    assert {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()} == {2}  # a row without an id is judged by its text
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["entry"])
def test_pipeline(spark, name):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.columns
    for stage, (label, f) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), f(spark, docs, SF).schema)
        if stage < 4:
            assert docs.columns == seen and docs.count() > 100, label
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
