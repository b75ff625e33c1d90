import hashlib
import math
import re
import time
from collections import Counter, defaultdict

from factorloom.llm import secret_scan


def brute(rows):
    """spans of each (doc_id, text): base spans, and candidates that few owners and repositories hold."""
    held, found = defaultdict(lambda: (set(), set())), {}
    for doc, text, lang, source in rows:
        base, extra = [], []
        for k, (p, group, least) in enumerate(((secret_scan.ASSIGN, 2, 6), (secret_scan.ACCESS, 0, 20), (secret_scan.HEX, 0, 24))):
            for m in p.finditer(text or ""):
                if len(m[group]) >= least:
                    base.append((m.start(), m.end(), k, m[group]))
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or ""):
            counts = Counter(m[0])
            bits = -sum(n / len(m[0]) * math.log2(n / len(m[0])) for n in counts.values())
            mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
            if mixed and bits >= 3.5 and all(b <= m.start() or a >= m.end() for a, b, _, _ in base):
                extra.append((m.start(), m.end(), 3, m[0]))
        for *_, value in base + extra:
            held[value][0].add(source or "")
            held[value][1].add((source or "", lang or ""))
        found[doc, text] = (base, extra)
    live = lambda v: len(held[v][0]) <= 2 and len(held[v][1]) <= 4
    return {key: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, b, k, v in sorted(base + [x for x in extra if live(x[3])], key=lambda x: (x[0], x[2]))) for key, (base, extra) in found.items()}


def test_all_spans_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    copied = "Qw3rTy9uIo2pAs5dFg7h"
    rows += [(90_000 + i, f"a {copied} b mYt0kenVal9ue8xyz7w{i:02d}", "en", f"o{i % 5}") for i in range(20)]
    want = brute(rows)
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, docs.schema)).select("doc_id", "spans", "base_sha256").collect()
    assert sorted((r.doc_id, r.spans) for r in got) == sorted((d, s) for (d, _), s in want.items())
    assert {r.doc_id: r.base_sha256 for r in got} == {d: hashlib.sha256(",".join(x for x in s.split(",") if not x.startswith("owned")).encode()).hexdigest() for (d, _), s in want.items()}


def test_long_texts_take_time_in_proportion(spark):
    text = "password=abcdef1 Zx9kQ7pLm2Wv8Rt4Yb1Nc6 " * 50_000
    start = time.time()
    spans = secret_scan.base_spans(text)
    assert len(spans) == 50_000 and len(secret_scan.candidates(text, spans)) == 50_000
    masked = secret_scan.masked(text, ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans), "#")
    assert masked == "# Zx9kQ7pLm2Wv8Rt4Yb1Nc6 " * 50_000 and time.time() - start < 20


def test_redacted_rows_keep_their_columns(spark, empty):
    rows = [(1, "token: abcdefgh1 x", 1), (None, "token: abcdefgh1 y", 2), (None, None, 3), (1, "", 4), (1, "token: abcdefgh1 x", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "1 AS _h", "2 AS id", "'s' AS spans", "4 AS hash", "5 AS _id", "6 AS none")
    out = secret_scan.redact(frame)
    assert out.columns == frame.columns and {r.row: r.text for r in out.collect()} == {1: "[secret] x", 2: "[secret] y", 3: None, 4: "", 5: "[secret] x"}
    assert secret_scan.redact(empty).count() == 0
