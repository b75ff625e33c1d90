import random

from factorloom.llm import decontamination


def brute(document, item, least=10, share=0.8):
    """matched, words, document's place and item's place of the best stretch, over all diagonals."""
    w, b = document.lower().split(), item.lower().split()
    best = None
    for shift in range(-len(b) + 1, len(w)):
        m = [k for k in range(len(b)) if 0 <= k + shift < len(w) and b[k] == w[k + shift]]
        for i in range(len(m)):
            for j in range(i + min(least, len(b)) - 1, len(m)):
                n, size = j - i + 1, m[j] - m[i] + 1
                if n >= share * size:
                    best = max(best or (), (n, -size, -m[i] - shift, -m[i]))
    return best and (best[0], -best[1], -best[2], -best[3])


def test_passages_with_a_gap_between_them(spark):
    words = [f"w{i}" for i in range(54)]
    other = [f"x{i}" for i in range(54)]
    rows = [
        (1, " ".join(words[:15] + other[:10] + words[25:40])),
        (2, " ".join(words[:20] + other[:14] + words[34:])),
        (3, " ".join(words[:15])),
        (4, " ".join(words[:9] + other[:9] + words[18:26])),
        (5, " ".join(words[:12] + other + words[40:])),
    ]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.n_matched, r.n_words, r.doc_start, r.item_start) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {d: found for d, t in rows if (found := brute(t, " ".join(words)))} and set(got) == {1, 2, 3, 5}


def test_substituted_overlaps_against_brute_force(spark):
    """Overlaps of 80 % and more, at random places: nine in ten are found, and what is found is the best."""
    rng = random.Random(5)
    item = [f"w{i}" for i in range(50)]
    rows, want = [], {}
    for d in range(600):
        size = rng.choice([10, 11, 12, 13, 15, 20, 25, 30, 40, 50])
        at = rng.randint(0, 50 - size)
        part = item[at : at + size]
        for k in rng.sample(range(1, size - 1), min(size // 5, max(0, size - 10))):
            part[k] = f"y{d}"
        text = " ".join([f"z{d}a"] * rng.randint(0, 5) + part + [f"z{d}b"] * 3)
        rows.append((d, text))
        want[d] = brute(text, " ".join(item))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.n_matched, r.n_words, r.doc_start, r.item_start) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert all(want.values()) and all(want[d] == x for d, x in got.items())
    assert len(got) >= 0.97 * len(want)


def test_rows_are_judged_one_by_one(spark, empty):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(None, item, 1), (None, "clean text", 2), (4, item, 3), (4, "another text of that id", 4), (5, None, 5), (6, "", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "'x' AS key0", "'y' AS _h", "1 AS h")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontamination.decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(r.key for r in kept.collect()) == [2, 4, 5, 6]
    assert decontamination.decontaminate(empty, bench).count() == 0 and decontamination.decontaminate(frame, bench.limit(0)).count() == 6


def test_a_very_long_item_and_text(spark):
    words = [f"w{i % 997}x{i // 997}" for i in range(6000)]
    changed = [w if i % 11 else "z" for i, w in enumerate(words)]
    frame = spark.createDataFrame([(1, " ".join(["a"] * 50_000 + changed))], "doc_id long, text string")
    got = decontamination.contaminated(frame, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).first()
    assert (got.n_words, got.doc_start, got.item_start) == (5999, 50_001, 1) and got.n_matched == sum(w != "z" for w in changed)
