"""Secrets in texts: pattern spans, and long tokens that the whole corpus shows to be one owner's.

Patterns give the base spans. Beside them every long mixed token is a candidate. Hashes
of all candidates (and of the values inside base spans) are aggregated over the corpus
by distinct repositories and owners: a value that many owners hold is a copied example,
one that stays with its owner looks live. Owner-specific candidates become spans too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import fresh, saved
from factorloom.shipping import ship

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: the same matches as HEX's of 24 and more characters, found without stopping at shorter ones
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: characters that every assignment has; texts without them need no slower search
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: candidates: tokens of these characters, this long and this mixed
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_BITS = 3.5
#: a value held by more owners or repositories is a copied example
MAX_OWNERS, MAX_REPOS = 2, 4
KINDS = ("assign", "access", "hex", "owned")
SALT = 16
_FOUND = "doc_id long, h long, owner string, repo string, n_assign long, n_access long, n_hex long, base array<string>, cand array<struct<kind:string,s:int,e:int,key:string>>"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and value of the base spans, by start, then kind as listed."""
    out: list[tuple[int, int, str, str]] = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def looks_random(token: str) -> bool:
    """Letters and digits in it, and enough bits a character."""
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return False
    shares = [token.count(c) / len(token) for c in set(token)]
    return -sum(p * math.log2(p) for p in shares) >= MIN_BITS


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """start, end and token of long mixed tokens outside base spans."""
    out = []
    k, reach = 0, 0  # base spans that begin before the candidate's end, and the furthest end of them
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][0] < e:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= s and looks_random(m[0]):
            out.append((s, e, m[0]))
    return out


def _key(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def scan_secrets(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied, h.

    docs: doc_id, text and the columns of owner and repository; a missing or null owner
    counts as one owner. Null and empty texts have no spans (the hash of nothing, an empty
    string). ``n_live`` base spans hold a value of few owners, ``n_copied`` of many. Rows
    are told apart by doc_id and text (``h`` is the text's hash): equal rows have equal
    results, and each is returned. Spans are kind:start:end in code points, by start, then
    kind, joined by commas. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    owner_col = F.col(owner).cast("string") if owner in docs.columns else F.lit(None).cast("string")
    repo_cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo if c in docs.columns] or [F.lit("")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(owner_col, F.lit("")).alias("owner"), F.concat_ws("\x00", *repo_cols).alias("repo"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.string())), ("cand", pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("key", pa.string())])))])
        for batch in batches:
            base, cand, counts = [], [], {k: [] for k in KINDS[:3]}
            for text in batch["text"].to_pylist():
                spans = base_spans(text or "")
                base.append([f"{k}:{s}:{e}" for s, e, k, _ in spans])
                for k, n in counts.items():
                    n.append(sum(x[2] == k for x in spans))
                cand.append([{"kind": k, "s": s, "e": e, "key": _key(v)} for s, e, k, v in spans] + [{"kind": "owned", "s": s, "e": e, "key": _key(v)} for s, e, v in candidates(text or "", spans)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["owner"], batch["repo"], *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(base, schema.field("base").type), pa.array(cand, schema.field("cand").type)], schema=schema)

    found = saved(rows.mapInArrow(scan, _FOUND))
    held = found.select("doc_id", "h", "owner", "repo", F.explode("cand").alias("c")).select("doc_id", "h", "owner", "repo", "c.*")
    # distinct owners and repositories of a value are few or many, but each is one row after the first step
    pairs = held.groupBy("key", "owner", "repo").agg(F.lit(1).alias("one"))
    stats = pairs.groupBy("key").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    judged = stats.select("key", ((F.col("owners") <= MAX_OWNERS) & (F.col("repos") <= MAX_REPOS)).alias("live"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = held.select("doc_id", "h", "kind", "s", "e", "key").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALT)).cast("int"))
    known = salted.join(judged.hint("merge"), ["key", "salt"])  # values are many: no broadcast
    of_row = known.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "h").agg(
        F.sort_array(F.collect_set(F.when((F.col("kind") == "owned") & F.col("live"), F.struct("s", "e")))).alias("owned"),
        F.count_if((F.col("kind") != "owned") & F.col("live")).alias("n_live"),
        F.count_if((F.col("kind") != "owned") & ~F.col("live")).alias("n_copied"),
    )
    keyed = found.select("*", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    out = keyed.join(of_row, ["id", "no_id", "h"], "left")
    none = F.array().cast("array<struct<s:int,e:int>>")

    def parsed(spans):
        return F.transform(spans, lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("span")))

    extra = F.transform(F.coalesce("owned", none), lambda x: F.concat(F.lit("owned:"), x["s"], F.lit(":"), x["e"]))
    every = F.transform(F.array_sort(parsed(F.concat("base", extra))), lambda x: x["span"])
    return out.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size(F.coalesce("owned", none)).cast("long").alias("n_owned"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        "h",
    )


def masked(text: str, spans: str, mask: str) -> str:
    """The text with each span replaced; spans that overlap are one."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with each span replaced by ``mask``, with all their columns whatever their names.

    Rows without spans, null and empty texts stay as they are; overlapping spans get one
    mask. Rows are told apart by doc_id (or its lack) and text, so equal rows fare alike. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    names = [fresh(n, docs.columns) for n in ("id", "none", "hash")]
    found = fresh("spans", docs.columns)
    keys = lambda h: (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), h)
    spans = scan_secrets(docs).where("spans <> ''").select(*(c.alias(n) for c, n in zip(keys(F.col("h")), names)), F.col("spans").alias(found)).distinct()
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(keys(F.xxhash64(F.coalesce("text", F.lit("")))), names)))
    columns = docs.columns
    joined = keyed.join(spans, names, "left").select(*columns, found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch[found].to_pylist()
            if any(told):
                texts = [masked(t, s, mask) if s else t for t, s in zip(batch["text"].to_pylist(), told)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select(columns)

    return joined.mapInArrow(cut, docs.schema)
