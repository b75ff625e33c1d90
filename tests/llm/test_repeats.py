import hashlib
import random

import numpy as np
import pytest

from factorloom.llm.recompression import substring_dedup, word_runs
from factorloom.llm.suffix_dedup import PLACE_BITS, sliding_argmin, suffix_dedup


def ordered(docs):
    rows = docs.select("doc_id", "text").collect()
    return sorted(((r.doc_id, (r.text or "").encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def brute_bytes(rows, length):
    seen, out = set(), []
    for doc, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, size):
    first = {}
    for doc, data in rows:
        words = data.split()
        key = float("inf") if doc is None else doc
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            first[w] = min(first.get(w, key), key)
    out = []
    for doc, data in rows:
        words = data.split()
        key = float("inf") if doc is None else doc
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < key:
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def text(row):
    return sorted(map(repr, row))


def test_suffix_dedup_equals_brute_force(docs):
    got = [tuple(r) for r in suffix_dedup(docs).collect()]
    assert text(got) == text(brute_bytes(ordered(docs), 100))


def test_substring_dedup_equals_brute_force(docs):
    got = [tuple(r) for r in substring_dedup(docs).collect()]
    assert text(got) == text(brute_words(ordered(docs), 13))


def test_empty_tables(empty):
    assert suffix_dedup(empty).count() == 0 and substring_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert text(map(tuple, suffix_dedup(frame, 20, 8).collect())) == text(brute_bytes(ordered(frame), 20))
    assert text(map(tuple, substring_dedup(frame, 6, 2).collect())) == text(brute_words(ordered(frame), 6))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(7)
    shared = " ".join(rng.choice("abcdefg") for _ in range(13)).encode()
    texts = [b" ".join([*[rng.choice([b"x", b"y", b"a", b"b"]) for _ in range(rng.randint(0, 9))], shared, *[rng.choice([b"x", b"a", b"g"]) for _ in range(rng.randint(0, 9))]]) for _ in range(50)]
    runs = word_runs(texts, 13)
    hashes = {}
    for first, last, anchor in zip(runs.first, runs.last, runs.anchor):
        for s in range(first, last + 1):
            hashes.setdefault(int(runs.hash_windows(np.array([s]))[0]), set()).add(int(anchor))
    assert all(len(a) == 1 for a in hashes.values())


def test_sliding_argmin():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    got = sliding_argmin(keys, 17)
    assert [int(x) for x in got] == [i + int(np.argmin(keys[i : i + 17] // np.uint64(1 << PLACE_BITS))) for i in range(500 - 16)]


def test_a_third_of_the_rows_are_copies_and_many_have_no_id(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    copied, passage = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(20))
    rows = [(i, copied) for i in range(0, 900, 3)]
    rows += [(i, " ".join(word() for _ in range(20)) + " " + passage + " " + word()) for i in range(1, 900, 3)]
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(2, 900, 3)]
    rows += [(None, copied + " and more " + passage)] * 3000
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert text(map(tuple, suffix_dedup(frame).collect())) == text(brute_bytes(ordered(frame), 100))
    assert text(map(tuple, substring_dedup(frame).collect())) == text(brute_words(ordered(frame), 13))
