import random
import re

from factorloom.llm import jaccard_groups as J


def shingles(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def brute(rows, percent=85):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(100 * len(x & y) >= percent * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted(repr((d, len(shingles(t)), None if d is None else root(d))) for d, t in rows)


def near_copies(count):
    rng = random.Random(3)
    rows = []
    for n in (6, 12, 25, 60, 150):
        base = [rng.choice("abcdefghijk") + rng.choice("xyz") for _ in range(n)]
        for _ in range(count):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                words[rng.randrange(n)] = f"q{rng.randrange(10**6)}"
            rows.append((50_000 + len(rows), " ".join(words)))
    return rows


def test_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + near_copies(12)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in J.shingle_components(frame).collect()) == brute(rows)


def test_large_families_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "LEADERS", 4)
    rows = near_copies(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in J.shingle_components(frame).collect()) == brute(rows)


def test_extra_columns_and_empty_table(docs, empty):
    assert J.shingle_components(docs).count() == docs.count()
    assert J.shingle_components(empty).count() == 0


def test_keep_one_leaves_one_of_each_group(docs):
    kept = J.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = {r.component_id for r in J.shingle_components(docs, 5, 80).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids


def test_passages_that_many_documents_quote_chain_no_families(spark, monkeypatch):
    """Pairs of near copies; every document also quotes one passage, which no two pairs are alike for."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(len(rows), " ".join(own + passage)), (len(rows) + 1, " ".join(own + passage[:-1]))]
    sizes = []

    def seen(edges, found=J.connected_components):
        out = found(edges)
        sizes.append(max((r["count"] for r in out.groupBy("component").count().collect()), default=0))
        return out

    monkeypatch.setattr(J, "connected_components", seen)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in J.shingle_components(frame).collect()) == brute(rows)
    assert sizes == [2]
