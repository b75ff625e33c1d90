"""The trie against its SQL, and against a version that keeps whole sequences in a dictionary."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from factorloom.llm import prefix_trie, registered

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    ordered = {c: [(x[2], x[4]) for x in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = ordered.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += own
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def trie(frame):
    return Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(frame).collect())


def test_trie_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = Counter(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE_SQL})").fetchall())
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert want == brute(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in registered.op12_prefix_trie(spark, SF).collect()) == want


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    rows = []
    for c in [*range(70), 399, 400, 401, 1_000_003, None]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, ("user", "assistant", None)[turn % 3 if turn < 5 else 0], rng.choice(["a b", "a b c", "", None, "é x\ty\u000b z"])))
    rows += [(3, None, "system", "first of all"), (3, None, None, None), (5, 0, "user", "a b"), (5, 0, "user", "a b"), (7, 2**40, "user", "late"), (8, 1, "b", "tie"), (8, 1, "a", "tie")]
    rows += [(c, t, "user", "same words here") for c in range(2000, 2040) for t in range(3)]  # copies
    rows += [(c, t, "user", f"turn {t}") for c in (3000, 3001) for t in range(150)] + [(3001, 150, "user", "x " * 50_000)]
    rows += [(-5, 0, "user", "a b"), (-5, 1, "user", "a b"), (-5, 2, "user", "c"), (-5, 3, "user", "d")]
    rng.shuffle(rows)
    return rows


def test_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rows = [r for r in odd if r[0] is None or r[0] >= 0]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS pos", "'clash' AS k1", "'clash' AS words", "'clash' AS h").repartition(6)
    assert trie(frame) == brute(rows)


def test_negative_ids_take_remainders_as_sql_does(spark):
    turns = prefix_trie.turns_in_order(spark.createDataFrame([(-6, 0, "u", "own"), (0, 0, "u", "base's"), (-20, 0, "u", "another")], SCHEMA))
    digest = {r.conv_id: (r.d1, r.d2) for r in turns.collect()}
    (row,) = prefix_trie.rebuilt(turns).where("conv_id = -6 AND pos > 0").collect()
    assert (row.pos, row.d1, row.d2) == (1, *digest[0])


def test_empty_and_absent(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0
    for rows in ([(1, 0, "u", "x")], [(c, 0, "u", "x") for c in range(21, 29)]):  # some of these lose all their turns
        assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
